import json
import math

import pytest
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions import features as X
from nearvote.functions import parse as P
from nearvote.functions import rules as R

REQUEST = {
    "merchant": {"avg_amount": 400, "mcc": "7801", "id": "m-001"},
    "terminal": {"km_from_home": 500, "card_present": False, "is_online": True},
    "last_transaction": {"timestamp": "2026-01-04T12:00:00Z", "km_from_current": 250},
    "customer": {"known_merchants": ["m-001", "m-002"], "tx_count_24h": 10.0, "avg_amount": 100},
    "transaction": {"requested_at": "2026-01-05T12:00:00Z", "installments": 6, "amount": 250.0},
    "other": {"x": 1},
}
FEATURES = [0.025, 0.5, 0.25, 12 / 23, 0, 1, 0.25, 0.5, 0.5, 1, 0, 0, 0.8, 0.04]


def features(spark, *bodies):
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "id int, body string")
    got = P.parse(rows).select("id", "ok", *P.request_vector()).orderBy("id").collect()
    return [(r.ok, [r[v] for v in S.V]) for r in got]


def changed(**parts):
    body = json.loads(json.dumps(REQUEST))
    for k, v in parts.items():
        if isinstance(v, dict):
            body[k] = body[k] | v
        else:
            body[k] = v
    return json.dumps(body)


def without(*path):
    body = json.loads(json.dumps(REQUEST))
    at = body
    for k in path[:-1]:
        at = at[k]
    del at[path[-1]]
    return json.dumps(body)


def test_golden_request(spark):
    (ok, got), (ok_b, b) = features(spark, json.dumps(REQUEST), changed(customer={"known_merchants": ["m-002", "m-003"]}, last_transaction=None))
    assert ok and got == pytest.approx(FEATURES, abs=1e-4)
    assert ok_b and b[5] == b[6] == -1 and b[11] == 1


def test_merchant_codes(spark):
    want = S.MCC_RISK | {"0000": 0.5}
    got = features(spark, *[changed(merchant={"mcc": m}) for m in want])
    assert [x[12] for _, x in got] == pytest.approx(list(want.values()), abs=1e-6)


def test_malformed_requests(spark):
    bad = ['{"transaction":{}}', json.dumps(REQUEST)[:-30], "{}", "", "null", without("last_transaction"), without("merchant", "id"), without("terminal", "is_online"), changed(transaction={"requested_at": "bad"}), changed(last_transaction={"timestamp": "2026-01-04 12:00:00Z"}), '{"last_transaction":{}}']
    for ok, got in features(spark, *bad, None):
        assert not ok and got == [None] * 14


def test_optional_and_bounded_known_merchants(spark):
    many = [f"x{k}" for k in range(32)] + ["m-001"]
    a, b = features(spark, without("customer", "known_merchants"), changed(customer={"known_merchants": many}))
    assert a[0] and a[1][11] == 1 and b[0] and b[1][11] == 1


def test_timestamps(spark):
    cases = ["1970-01-01T00:00:00Z", "2026-01-05T12:34:56Z", "2026/01/05 12:34:56", "20x6-01-05T12:34:56Z", "2026-0x-05T12:34:56Z", "short", None, "2024-02-29T23:59:59+05:00", "2023-13-01T99:00:00Z"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, t string")
    got = [r.x for r in rows.select("id", X.parse_iso(F.col("t")).alias("x")).orderBy("id").collect()]
    assert tuple(got[0]) == (0, 0, 3)
    assert got[1].hour == 12 and got[1].weekday == 0 and got[1].epoch_s == 1767616496
    assert got[2:7] == [None] * 5
    assert got[7].epoch_s == 1709251199  # the offset is not applied
    assert got[8].hour == 99 and got[8].epoch_s == 1704067200 + 99 * 3600  # fields are not range-checked


def test_fixed_point(spark):
    cases = [-2.0, -1.0, -0.00005, 0.0, 0.00005, 0.12345, 1.0, 2.0]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, x float")
    got = [tuple(r)[1:] for r in rows.select("id", X.quantize(F.col("x")), X.bin_clamped(F.col("x"), 4), X.clamp01(F.col("x"))).orderBy("id").collect()]
    assert [g[0] for g in got] == [-10000, -10000, -1, 0, 1, 1235, 10000, 10000]
    assert [g[1] for g in got] == [0, 0, 0, 0, 0, 0, 3, 3]
    assert got[0][2] == 0 and got[-1][2] == 1
    assert [r[0] for r in spark.range(1).select(X.sqdiff(F.lit(-10000), F.lit(10000))).collect()] == [400_000_000]


def test_ratio_without_average(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (5.0, -1.0), (5.0, 2.0)], "n double, d double")
    assert [r[0] for r in rows.select(X.ratio(F.col("n"), F.col("d"), 10.0)).collect()] == [0, 1, 1, 0.25]


def test_rules(spark):
    flat = [F.lit(0.0).cast("float")] * 14
    full = [F.lit(1.0).cast("float")] * 14
    low = [F.lit(0.02).cast("float")] * 14
    high = [*low[:2], F.lit(0.08).cast("float"), *low[3:]]
    r = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate((R.fast_path_votes(flat), R.fast_path_votes(full), R.heuristic_votes(low), R.heuristic_votes(high)))]).first()
    assert tuple(r) == (0, 5, 0, 5)


def test_repair_rules_by_branch(spark):
    def q(**x):
        return [x.get(f"q{k}", 5000) for k in range(14)]

    small = dict(q0=600, q2=2000, q7=2000, q8=2500, q10=10000, q12=2000)
    cases = [
        (4, q(**small), True, False),
        (3, q(**small), False, False),
        (5, q(q0=3500, q7=1200, q9=0, q10=10000, q12=2000), True, False),
        (5, q(q0=3000, q2=5500, q7=600, q8=3200, q11=10000, q12=4500, q13=150), True, False),
        (5, q(q0=2700, q1=5000, q13=300), True, False),
        (5, q(), False, False),
        (1, q(q10=10000, q2=4500, q7=3000, q8=3000, q12=2000), False, True),
        (0, q(q10=10000, q2=2000, q8=1500, q12=4000), False, True),
        (0, q(q13=250, q7=1000, q8=1800, q2=2500), False, True),
        (0, q(q5=-1, q6=-1, q0=1200, q2=3000, q7=1300, q8=2500, q12=2500), False, True),
        (1, q(q0=1200, q8=3500, q12=2500), False, True),
        (2, q(q0=1200, q8=3500, q12=2500), False, False),
    ]
    rows = spark.createDataFrame([(k, v, *x) for k, (v, x, _, _) in enumerate(cases)], "id int, votes int, " + ", ".join(f"{c} int" for c in S.Q))
    cols = [F.col(c) for c in S.Q]
    got = rows.select("id", R.low_risk_denial(F.col("votes"), cols).alias("a"), R.high_risk_approval(F.col("votes"), cols).alias("b")).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, _, a, b in cases]


def test_responses(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 2, 3, 5, None)], "n int")
    got = [json.loads(r[0]) for r in rows.select(R.response_json(F.col("n"))).collect()]
    assert got == [{"approved": a, "fraud_score": s} for a, s in ((True, 0.0), (True, 0.4), (False, 0.6), (False, 1.0), (True, 0.0))]
    assert math.isclose(spark.range(1).select(R.fraud_score(F.lit(3))).first()[0], 0.6)


def test_half_round_trip(spark):
    from nearvote.functions.half import from_half, to_half

    cases = [0.0, 1.0, -2.5, 0.1, 65504.0, 6e-8]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, x float")
    got = [r.y for r in rows.select("id", from_half(to_half("x")).alias("y")).orderBy("id").collect()]
    assert got == pytest.approx(cases, rel=1e-3, abs=4e-8)

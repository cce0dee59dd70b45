"""History features: values against the SQL on awkward events, and a plan that deals the events out once."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from nearvote.functions import features as X
from nearvote.operators import ivf
from nearvote.plans import suite
from nearvote.sources import transactions as T

DAY = 86_400_000_000


def awkward(path) -> str:
    """Equal times of one user, gaps of exactly a day and of several, a first visit at each shop on any day, an event a user."""
    r = np.random.default_rng(3)
    n = 600
    us = 1_704_067_200_000_000 + r.choice([0, 1, DAY - 1, DAY, DAY + 1, 2 * DAY, 2 * DAY + 1, 5 * DAY, 9 * DAY + 7], n)
    user = np.where(np.arange(n) % 50 == 0, np.arange(n) + 1000, r.integers(0, 6, n))
    kind = r.choice(["click", "view", "purchase", "error"], n)
    rows = pd.DataFrame({"event_id": r.permutation(n), "ts": pd.to_datetime(us, unit="us"), "user_id": user, "event_type": kind, "value": r.integers(1, 30000, n) / 100, "props": [f'{{"k": {k}}}' for k in r.integers(0, 100, n)]})
    rows.to_parquet(f"{path}/events.parquet", coerce_timestamps="us")
    return str(path)


def test_values(spark, tmp_path):
    path = awkward(tmp_path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    got = suite.QUERIES["q02_features"](spark, path).toPandas().sort_values("event_id").reset_index(drop=True)
    want = con.execute(suite.ORACLE_SQL["q02_features"]).df().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, check_exact=True)


def test_events_are_dealt_out_once(spark):
    rows = T.vectors(T.transactions(T.events(spark, "/root/testdata/sf0.001")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 3 and not any("event_id" in line for line in joins)


def test_fixed_point_at_its_ends(spark):
    x = [0.0, -0.0, 1.0, -1.0, 1.5, -7.0, float("inf"), float("-inf"), float("nan"), 0.00005, -0.00005, 0.12345, 0.99995, 1e-42]
    rows = spark.createDataFrame(list(enumerate(x)), "id int, x float")
    got = [r[0] for r in rows.orderBy("id").select(X.quantize(F.col("x"))).collect()]
    scaled = np.clip(np.nan_to_num(np.array(x, np.float32), nan=1.0), -1, 1).astype(np.float32) * np.float32(10000)
    assert got == np.trunc(scaled + np.where(scaled >= 0, np.float32(0.5), np.float32(-0.5))).astype(int).tolist()


def test_tables_are_written_with_methods_that_compile(spark):
    before = spark.conf.get(ivf.HUGE_METHOD)
    with ivf.compiled(spark):
        assert spark.conf.get(ivf.HUGE_METHOD) == "8000"
    assert spark.conf.get(ivf.HUGE_METHOD) == before


def test_variances_are_summed_in_longs(spark):
    rows = spark.createDataFrame([(0, 32767, 1), (0, -32768, 2), (1, 5, 5), (1, 5, 5)], "node int, a short, b short")
    wide = ivf.widest(rows, "node", ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(0, 2, 0), (1, 2, 0)]
    aggregates = [line for line in wide._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert aggregates and "decimal" not in aggregates[0]


def test_stream_makes_the_history_once(spark, tmp_path, monkeypatch):
    """Its requests are written with the feature table, and are those that the table's rows give."""
    path, made, make = awkward(tmp_path), [], T.transactions
    monkeypatch.setattr(T, "transactions", lambda ev: made.append(1) or make(ev))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    got = suite.QUERIES["q34_streaming_score"](spark, path).toPandas().sort_values("qid").reset_index(drop=True)
    assert len(made) == 1
    want = con.execute(suite.ORACLE_SQL["q34_streaming_score"]).df().sort_values("qid").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, check_exact=True)
    asked = T.payloads(make(T.events(spark, path))).filter("event_id % 20 = 0")
    assert sorted(map(tuple, suite.bodies(spark, path).collect())) == sorted(map(tuple, asked.collect()))
    assert "body" not in suite.table(spark, path).columns

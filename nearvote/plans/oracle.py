"""SQL building blocks that state the same results over the same tables."""

from __future__ import annotations

from .. import schema as S

DIMS = range(S.DIMS)


def f32(x: object) -> str:
    return f"cast({x} as float)"


def clamp(x: str) -> str:
    return f"case when {x} < 0 then {f32(0)} when {x} > 1 then {f32(1)} else {x} end"


def tx() -> str:
    mcc = "[" + ", ".join(f"'{m}'" for m in [*S.MCC_RISK, "0000", "9999"]) + "]"
    return f"""base AS MATERIALIZED (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec,
    cast(round(value * 100) AS bigint) AS cents, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events),
tx AS MATERIALIZED (SELECT event_id, us, sec, k, cast(cents * 20 AS double) / cast(100 AS double) AS amount, cast(k % 12 + 1 AS int) AS installments,
    cast(sec % 86400 // 3600 AS int) AS hour, cast((us // 86400000000 + 3) % 7 AS int) AS weekday,
    cast(sum(cents) OVER (PARTITION BY user_id) * 20 AS double) / cast(100 AS double) / cast(count(*) OVER (PARTITION BY user_id) AS double) AS customer_avg,
    cast(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS int) AS count_24h,
    lag(sec) OVER (PARTITION BY user_id ORDER BY us, event_id) AS last_sec, cast((event_id * 53) % 1100 AS double) AS last_km,
    concat('M-', k % 20) AS merchant_id, {mcc}[cast(k % 12 + 1 AS int)] AS mcc,
    cast(sum(cents) OVER (PARTITION BY k % 20) * 20 AS double) / cast(100 AS double) / cast(count(*) OVER (PARTITION BY k % 20) AS double) AS merchant_avg,
    row_number() OVER (PARTITION BY user_id, k % 20 ORDER BY us, event_id) > 1 AS known,
    event_type IN ('click', 'view') AS is_online, event_type = 'purchase' AS card_present, cast((event_id * 37) % 1200 AS double) AS home_km,
    cast(CASE WHEN (event_id * 37) % 1200 >= 700 OR cents >= 12000 THEN 1 ELSE 0 END AS tinyint) AS label FROM base)"""


def vec() -> str:
    risk = "CASE mcc " + " ".join(f"WHEN '{k}' THEN {f32(v)}" for k, v in S.MCC_RISK.items()) + f" ELSE {f32(S.MCC_DEFAULT)} END"
    d = lambda x: f"cast({x} AS double)"
    raw = {
        0: f32(f"amount / {d(10000)}"),
        1: f"{f32('installments')} / {f32(12)}",
        2: f32(f"amount / customer_avg / {d(10)}"),
        3: f"{f32('hour')} / {f32(23)}",
        4: f"{f32('weekday')} / {f32(6)}",
        5: f"{f32('greatest(0, sec - last_sec)')} / {f32(60)} / {f32(1440)}",
        6: f32(f"last_km / {d(1000)}"),
        7: f32(f"home_km / {d(1000)}"),
        8: f"{f32('count_24h')} / {f32(20)}",
        9: f32("CASE WHEN is_online THEN 1 ELSE 0 END"),
        10: f32("CASE WHEN card_present THEN 1 ELSE 0 END"),
        11: f32("CASE WHEN known THEN 0 ELSE 1 END"),
        12: risk,
        13: f32(f"merchant_avg / {d(10000)}"),
    }
    parts = [f"{x} AS r{k}" for k, x in raw.items()]
    final = []
    for k in DIMS:
        x = f"r{k}"
        if k in (0, 1, 2, 5, 6, 7, 8, 13):
            x = clamp(x)
        if k == 2:
            x = f"CASE WHEN customer_avg <= 0 THEN CASE WHEN amount > 0 THEN {f32(1)} ELSE {f32(0)} END ELSE {x} END"
        if k in (5, 6):
            x = f"CASE WHEN last_sec IS NULL THEN {f32(-1)} ELSE {x} END"
        final.append(f"{x} AS v{k}")
    return f"{tx()},\nraw AS (SELECT *, {', '.join(parts)} FROM tx),\nfeat AS MATERIALIZED (SELECT event_id, label, {', '.join(final)} FROM raw),\nvec AS MATERIALIZED (SELECT *, {', '.join(f'{quantize(f"v{k}")} AS q{k}' for k in DIMS)} FROM feat)"


def quantize(v: str) -> str:
    x = f"(CASE WHEN {v} < -1 THEN {f32(-1)} WHEN {v} > 1 THEN {f32(1)} ELSE {v} END * {f32(10000)})"
    x = f"({x} + CASE WHEN {x} >= 0 THEN {f32(0.5)} ELSE {f32(-0.5)} END)"
    return f"cast(trunc(greatest(least({x}, {f32(10000)}), {f32(-10000)})) AS smallint)"


def distance(a: str, b: str, dims: int = S.DIMS) -> str:
    return " + ".join(f"(cast({a}.q{k} AS bigint) - {b}.q{k}) * (cast({a}.q{k} AS bigint) - {b}.q{k})" for k in range(dims))


def votes(name: str, top: str) -> str:
    """CTE of qid, votes, d5 from a CTE of (qid, dist, label, rank)."""
    return f"{name} AS MATERIALIZED (SELECT q.event_id AS qid, cast(CASE WHEN count(t.dist) >= 5 THEN coalesce(sum(t.label), 0) ELSE 0 END AS int) AS votes, CASE WHEN count(t.dist) >= 5 THEN max(t.dist) END AS d5 FROM queries q LEFT JOIN {top} t ON t.qid = q.event_id AND t.rank <= 5 GROUP BY q.event_id)"


def flat() -> str:
    return f"""queries AS MATERIALIZED (SELECT * FROM vec WHERE event_id % 20 = 0),
flat_top AS MATERIALIZED (SELECT * FROM (SELECT q.event_id AS qid, r.event_id AS orig_id, r.label, {distance('q', 'r')} AS dist,
    row_number() OVER (PARTITION BY q.event_id ORDER BY {distance('q', 'r')}, r.event_id) AS rank FROM queries q CROSS JOIN vec r) WHERE rank <= 5),
{votes('flat', 'flat_top')}"""


def tree(depth: int, source: str = "vec", p: str = "") -> str:
    """Balanced lists: the widest dimension by exact integer variance, lower half by (value, id). ``p`` goes before
    the names of its tables."""
    out, last = [], f"(SELECT *, 0 AS node FROM {source})"
    for level in range(depth):
        wide = ", ".join(f"count(*) * sum(cast(q{k} AS hugeint) * q{k}) - sum(cast(q{k} AS hugeint)) * sum(cast(q{k} AS hugeint)) AS w{k}" for k in DIMS)
        best = "greatest(" + ", ".join(f"w{k}" for k in DIMS) + ")"
        pick = "CASE " + " ".join(f"WHEN w{k} = {best} THEN {k}" for k in DIMS) + " END"
        value = "CASE dim " + " ".join(f"WHEN {k} THEN q{k}" for k in DIMS) + " END"
        src = last if level == 0 else f"{p}t{level}"
        out.append(f"{p}w{level} AS MATERIALIZED (SELECT node, n, {pick} AS dim FROM (SELECT node, count(*) AS n, {wide} FROM {src} GROUP BY node))")
        cols = ", ".join(["event_id", "label", *S.V, *S.Q])
        child = f"s.node * 2 + CASE WHEN w.n > 1 AND row_number() OVER (PARTITION BY s.node ORDER BY {value}, event_id) > w.n // 2 THEN 1 ELSE 0 END"
        out.append(f"{p}t{level + 1} AS MATERIALIZED (SELECT {child} AS node, {cols} FROM {src} s JOIN {p}w{level} w ON s.node = w.node)")
    cents = ", ".join(f"coalesce(cast(sum(cast(v{k} AS double)) * (cast(1 AS double) / count(event_id)) AS float), {f32(0)}) AS c{k}" for k in DIMS)
    out.append(f"{p}lists AS MATERIALIZED (SELECT node AS list_id, * EXCLUDE (node) FROM {p}t{depth})")
    out.append(f"{p}cents AS MATERIALIZED (SELECT cast(i AS int) AS list_id, count(event_id) AS n, {cents} FROM range({1 << depth}) r(i) LEFT JOIN {p}lists ON list_id = i GROUP BY i)")
    return ",\n".join(out)


def nearest(rows: str, cents: str) -> str:
    """Each row's nearest centroid, in single precision, dimension by dimension."""
    gap = " + ".join(f"(l.v{k} - c.c{k}) * (l.v{k} - c.c{k})" for k in DIMS)
    return f"SELECT * FROM (SELECT l.*, c.list_id, row_number() OVER (PARTITION BY l.event_id ORDER BY {gap}, c.list_id) AS place FROM {rows} l CROSS JOIN {cents} c) WHERE place = 1"


def kmeans(nlist_depth: int, sample: int, rounds: int) -> str:
    """Lloyd's rounds, one after the other, on a stride sample, from balanced lists; an empty list keeps its centroid."""
    out = [f"few AS MATERIALIZED (SELECT vec.* FROM vec JOIN (SELECT i * n // least(n, {sample}) AS event_id FROM (SELECT count(*) AS n FROM vec), range({sample}) r(i) WHERE i < n) USING (event_id))", tree(nlist_depth, "few", "s_"), "k0 AS MATERIALIZED (SELECT * FROM s_cents)"]
    for r in range(rounds):
        mean = ", ".join(f"coalesce(cast(m.c{k} AS float), o.c{k}) AS c{k}" for k in DIMS)
        sums = ", ".join(f"sum(cast(v{k} AS double)) * (cast(1 AS double) / count(*)) AS c{k}" for k in DIMS)
        out.append(f"k{r + 1} AS MATERIALIZED (SELECT o.list_id, {mean} FROM k{r} o LEFT JOIN (SELECT list_id, {sums} FROM ({nearest('few', f'k{r}')}) GROUP BY list_id) m ON m.list_id = o.list_id)")
    return ",\n".join(out)


def probe(name: str, nprobe: int) -> str:
    """CTE of votes after reading the nearest lists. Needs queries, lists and cents."""
    gap = lambda k: f"({f32(f'q.q{k}')} / {f32(10000)} - c.c{k})"
    dist = " + ".join(f"{gap(k)} * {gap(k)}" for k in DIMS)
    return f"""{name}_near AS MATERIALIZED (SELECT * FROM (SELECT q.event_id AS qid, c.list_id, row_number() OVER (PARTITION BY q.event_id ORDER BY {dist}, c.list_id) AS place FROM queries q CROSS JOIN cents c) WHERE place <= {nprobe}),
{name}_top AS MATERIALIZED (SELECT * FROM (SELECT q.event_id AS qid, r.event_id AS orig_id, r.label, {distance('q', 'r')} AS dist, row_number() OVER (PARTITION BY q.event_id ORDER BY {distance('q', 'r')}, r.event_id) AS rank
    FROM queries q JOIN {name}_near n ON n.qid = q.event_id JOIN lists r ON r.list_id = n.list_id) WHERE rank <= 5),
{votes(name, f'{name}_top')}"""


def low_risk(v: str, q: str = "") -> str:
    small = f"({q}q0 <= 600 AND {q}q2 <= 2000 AND {q}q7 <= 2000 AND {q}q8 <= 2500 AND {q}q10 >= 10000 AND {q}q12 <= 2000)"
    return f"""(({v} = 4 AND {small}) OR ({v} = 5 AND ({small} OR ({q}q0 <= 3500 AND {q}q7 <= 1200 AND {q}q9 = 0 AND {q}q10 >= 10000 AND {q}q12 <= 2000)
    OR ({q}q0 BETWEEN 2800 AND 3200 AND {q}q2 >= 5500 AND {q}q7 <= 600 AND {q}q8 <= 3200 AND {q}q11 >= 10000 AND {q}q12 >= 4500 AND {q}q13 <= 150) OR ({q}q0 <= 2700 AND {q}q1 <= 5000 AND {q}q13 <= 300))))"""


def high_risk(v: str, q: str = "") -> str:
    return f"""({v} <= 1 AND (({q}q10 >= 10000 AND {q}q2 >= 4500 AND {q}q7 >= 3000 AND {q}q8 >= 3000 AND {q}q12 <= 2000) OR ({q}q10 >= 10000 AND {q}q2 >= 2000 AND {q}q8 >= 1500 AND {q}q12 >= 4000)
    OR ({q}q13 <= 250 AND {q}q7 BETWEEN 1000 AND 1800 AND {q}q8 BETWEEN 1800 AND 2600 AND {q}q2 >= 2500)
    OR ({q}q5 < 0 AND {q}q6 < 0 AND {q}q0 <= 1200 AND {q}q2 >= 3000 AND {q}q7 <= 1300 AND {q}q8 <= 2500 AND {q}q12 BETWEEN 2500 AND 3500) OR ({q}q0 <= 1200 AND {q}q8 >= 3500 AND {q}q12 >= 2500)))"""


def gate(v: str, q: str = "") -> str:
    return f"({v} BETWEEN 1 AND 4 OR {low_risk(v, q)} OR {high_risk(v, q)})"


def fast_path() -> str:
    s = f"({f32(5)} * v2 + {f32(5)} * v7 + {f32(2)} * v8 + v9 + v11 + v12 + v0)"
    steps = [(f"{s} < {f32(1.95)}", 0), (f"{s} > {f32(11.1)}", 5), (f"v0 <= {f32(0.0387315)}", 0), (f"v3 <= {f32(0.23913044)}", 5), (f"v5 > {f32(0.08368056)}", 0), (f"v0 > {f32(0.322186)}", 5), (f"v1 <= {f32(0.20833334)}", 0), (f"v1 > {f32(0.625)}", 5), (f"v7 <= {f32(0.02350026)}", 0), (f"v8 <= {f32(0.175)}", 0), (f"v8 > {f32(0.575)}", 5)]
    return "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n in steps) + " ELSE -1 END"


def decision(v: str) -> str:
    return f"{v} < 3 AS approved, cast({v} AS double) / cast(5 AS double) AS fraud_score"


def values(prefix: str = "v") -> str:
    return ", ".join(f"round(cast({prefix}{k} AS double), 6) AS {prefix}{k}" for k in DIMS)

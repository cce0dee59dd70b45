"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

Searches take as queries every event whose id is divisible by 20, against all events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import features as X
from ..functions import half
from ..functions import parse as P
from ..functions import rules as R
from ..operators import ivf, knn, search, validate
from ..sources import readers
from ..sources import transactions as T
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEPTH = 5
_made: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    """Derived tables and indexes are written once a session and input, and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vectors(T.transactions(T.events(spark, sf_dir)))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "vectors", lambda: ivf.cut(vectors(spark, sf_dir), "vectors"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label and request of the query set. Where the feature table is still to be written, they are written
    with it, so that the history is made once."""
    asked = F.col("event_id") % 20 == 0

    def make() -> DataFrame:
        tx = T.transactions(T.events(spark, sf_dir))
        if (spark.sparkContext.applicationId, sf_dir, "vectors") in _made:
            return T.payloads(tx.filter(asked))
        rows = ivf.cut(T.vectors(tx.withColumn("body", F.when(asked, T.body())), "body"), "vectors")
        _once(spark, sf_dir, "vectors", lambda: rows.drop("body"))
        return rows.filter(asked).select("event_id", "label", "body")

    return _once(spark, sf_dir, "bodies", make)


def query_set(rows: DataFrame, id_col: str = "event_id") -> DataFrame:
    return rows.filter(F.col(id_col) % 20 == 0).withColumnRenamed(id_col, "qid")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).withColumnRenamed("event_id", "orig_id")


def index(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> ivf.Index:
    return _once(spark, sf_dir, f"index{depth}", lambda: ivf.build(refs(spark, sf_dir), 1 << depth))


def rounded(prefix: str = "v") -> list:
    return [F.round(F.col(f"{prefix}{k}").cast("double"), 6).alias(f"{prefix}{k}") for k in range(S.DIMS)]


def v() -> list:
    return [F.col(c) for c in S.V]


def q() -> list:
    return [F.col(c) for c in S.Q]


def answer(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.col("votes").cast("int").alias("votes"), "approved", F.col("fraud_score").cast("double").alias("fraud_score"))


BASE, FLAT, TREE = f"WITH {O.vec()}", f"WITH {O.vec()},\n{O.flat()}", f"WITH {O.vec()},\n{O.tree(DEPTH)}"
FULL = f"{FLAT},\n{O.tree(DEPTH)},\n{O.probe('p2', 2)},\n{O.probe('p4', 4)}"
VOTED = f"qid, votes, {O.decision('votes')}"


@query("q01_knn_flat_vote", f"{FLAT} SELECT {VOTED} FROM flat")
def q01(spark, sf_dir):
    rows = table(spark, sf_dir)
    return answer(search.flat_search(query_set(rows), rows.withColumnRenamed("event_id", "orig_id")))


@query("q02_features", f"{BASE} SELECT event_id, label, {O.values()} FROM vec")
def q02(spark, sf_dir):
    return vectors(spark, sf_dir).select("event_id", "label", *rounded())


@query("q03_quantize", f"{BASE} SELECT event_id, {', '.join(S.Q)} FROM vec")
def q03(spark, sf_dir):
    return vectors(spark, sf_dir).select("event_id", *S.Q)


@query("q04_dequantize", f"{BASE} SELECT event_id, {', '.join(f'round(cast({O.f32(c)} / {O.f32(10000)} AS double), 6) AS {c}' for c in S.Q)} FROM vec")
def q04(spark, sf_dir):
    return vectors(spark, sf_dir).select("event_id", *[F.round(X.dequantize(F.col(c)).cast("double"), 6).alias(c) for c in S.Q])


@query("q05_mcc_join", f"WITH {O.tx()} SELECT mcc, count(*) AS n, round(sum(CASE mcc {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {int(r * 100)}' for k, r in S.MCC_RISK.items())} ELSE 50 END) / 100.0, 2) AS risk FROM tx GROUP BY mcc")
def q05(spark, sf_dir):
    lookup = spark.createDataFrame([(k, round(r * 100)) for k, r in S.MCC_RISK.items()], "mcc string, risk int")  # ten rows
    tx = T.transactions(T.events(spark, sf_dir)).select("mcc").join(F.broadcast(lookup), "mcc", "left")
    return tx.groupBy("mcc").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("risk", F.lit(50))) / 100.0, 2).alias("risk"))


@query("q06_json_roundtrip", f"{BASE} SELECT event_id, true AS ok, {O.values()} FROM vec")
def q06(spark, sf_dir):
    bodies = T.payloads(T.transactions(T.events(spark, sf_dir)))
    return P.parse(bodies).select("event_id", "ok", *P.request_vector()).select("event_id", "ok", *rounded())


@query("q07_timestamp_parse", f"WITH {O.tx()} SELECT event_id, sec AS epoch_s, hour, weekday FROM tx")
def q07(spark, sf_dir):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return T.events(spark, sf_dir).select("event_id", X.parse_iso(text).alias("t")).select("event_id", "t.epoch_s", "t.hour", "t.weekday")


@query("q08_heuristic", f"{BASE} SELECT event_id, CASE WHEN v2 >= {O.f32(R.HEURISTIC_RATIO)} THEN 5 ELSE 0 END AS votes FROM vec")
def q08(spark, sf_dir):
    return vectors(spark, sf_dir).select("event_id", R.heuristic_votes(v()).alias("votes"))


@query("q09_fast_path", f"{BASE} SELECT event_id, {O.fast_path()} AS votes FROM vec")
def q09(spark, sf_dir):
    return vectors(spark, sf_dir).select("event_id", R.fast_path_votes(v()).alias("votes"))


def _crossed(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rows.select("event_id", *S.Q, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("votes"))


CROSSED = f"{BASE} SELECT event_id, cast(i AS int) AS votes, {{}} AS hit FROM vec CROSS JOIN range(6) r(i)"


@query("q10_low_risk_denial", CROSSED.format(O.low_risk("i")))
def q10(spark, sf_dir):
    return _crossed(spark, sf_dir).select("event_id", "votes", R.low_risk_denial(F.col("votes"), q()).alias("hit"))


@query("q11_high_risk_approval", CROSSED.format(O.high_risk("i")))
def q11(spark, sf_dir):
    return _crossed(spark, sf_dir).select("event_id", "votes", R.high_risk_approval(F.col("votes"), q()).alias("hit"))


@query("q12_balanced_assign", f"WITH {O.vec()},\n{O.tree(3)} SELECT event_id, cast(list_id AS int) AS list_id FROM lists")
def q12(spark, sf_dir):
    return index(spark, sf_dir, 3).refs.select(F.col("orig_id").alias("event_id"), "list_id")


@query("q13_centroids", f"{TREE} SELECT list_id, n, {', '.join(f'round(cast(c{k} AS double), 5) AS c{k}' for k in O.DIMS)} FROM cents")
def q13(spark, sf_dir):
    return index(spark, sf_dir).centroids.select("list_id", "n", *[F.round(F.col(f"c{k}").cast("double"), 5).alias(f"c{k}") for k in range(S.DIMS)])


@query("q14_bboxes", f"{TREE} SELECT cast(list_id AS int) AS list_id, count(*) AS n, {', '.join(f'min(q{k}) AS mn{k}, max(q{k}) AS mx{k}' for k in O.DIMS)} FROM lists GROUP BY list_id")
def q14(spark, sf_dir):
    return index(spark, sf_dir).boxes


SIZE_AT = "list_extract(list_sort(list(n)), cast(floor({} * (count(*) - 1)) AS int) + 1)"


@query("q15_list_histogram", f"{TREE} SELECT cast(sum(n) AS bigint) AS vectors, count(*) AS lists, count(*) FILTER (n > 0) AS non_empty, count(*) FILTER (n = 0) AS empty, {SIZE_AT.format(0.5)} AS p50, {SIZE_AT.format(0.95)} AS p95, {SIZE_AT.format(0.99)} AS p99, max(n) AS max FROM cents")
def q15(spark, sf_dir):
    return ivf.histogram(index(spark, sf_dir).centroids).select("vectors", "lists", F.col("non_empty").cast("long").alias("non_empty"), F.col("empty").cast("long").alias("empty"), "p50", "p95", "p99", "max")


@query("q16_csr_offsets", f"{TREE} SELECT list_id, cast(coalesce(sum(n) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS \"begin\", n FROM cents")
def q16(spark, sf_dir):
    return ivf.offsets(index(spark, sf_dir).centroids)


GAP = "(cast(greatest(b.mn{0} - cast(q.q{0} AS int), cast(q.q{0} AS int) - b.mx{0}, 0) AS bigint))"
BOXES = f"b AS MATERIALIZED (SELECT cast(list_id AS int) AS list_id, {', '.join(f'min(q{k}) AS mn{k}, max(q{k}) AS mx{k}' for k in O.DIMS)} FROM lists GROUP BY list_id)"


@query("q17_bbox_lower_bound", f"{TREE}, {BOXES} SELECT q.event_id AS qid, b.list_id, {' + '.join(f'{GAP.format(k)} * {GAP.format(k)}' for k in O.DIMS)} AS bound FROM vec q CROSS JOIN b WHERE q.event_id % 20 = 0")
def q17(spark, sf_dir):
    made = index(spark, sf_dir)
    pairs = query_set(table(spark, sf_dir)).select("qid", *S.Q, F.explode(F.sequence(F.lit(0), F.lit(made.nlist - 1))).alias("list_id"))
    cols = [[F.col(f"{side}{k}") for k in range(S.DIMS)] for side in ("mn", "mx")]
    return pairs.join(made.boxes, "list_id").select("qid", "list_id", search.lower_bound(q(), *cols).alias("bound"))


@query("q18_nearest_centroids", f"{FULL} SELECT qid, list_id FROM p4_near")
def q18(spark, sf_dir):
    return search.probes(query_set(table(spark, sf_dir)).select("qid", *S.Q), index(spark, sf_dir), 4).select("qid", "list_id")


NEAR_ONE = " + ".join(f"(l.v{k} - c.c{k}) * (l.v{k} - c.c{k})" for k in O.DIMS)


@query("q19_nearest_list", f"{TREE} SELECT event_id, list_id FROM (SELECT l.event_id, c.list_id, row_number() OVER (PARTITION BY l.event_id ORDER BY {NEAR_ONE}, c.list_id) AS place FROM vec l CROSS JOIN cents c) WHERE place = 1")
def q19(spark, sf_dir):
    cents = ivf.as_matrix(index(spark, sf_dir).centroids, S.DIMS)
    return ivf.nearest_list(table(spark, sf_dir), cents).select("event_id", "list_id")


@query("q20_ivf_probe_vote", f"{FULL} SELECT {VOTED} FROM p4")
def q20(spark, sf_dir):
    return answer(search.probe(query_set(table(spark, sf_dir)), index(spark, sf_dir), 4))


@query("q21_ivf_repair_equals_flat", f"{FLAT} SELECT {VOTED} FROM flat")
def q21(spark, sf_dir):
    return answer(search.probe(query_set(table(spark, sf_dir)), index(spark, sf_dir), 2, True))


PICKED = "FROM queries q JOIN p2 ON p2.qid = q.event_id JOIN p4 ON p4.qid = q.event_id JOIN flat ON flat.qid = q.event_id"


def staged(expr: str) -> str:
    return f"{FULL} SELECT qid, votes, {O.decision('votes')} FROM (SELECT q.event_id AS qid, {expr} AS votes {PICKED})"


@query("q22_conditional_repair", staged(f"CASE WHEN {O.gate('p4.votes', 'q.')} THEN flat.votes ELSE p4.votes END"))
def q22(spark, sf_dir):
    return answer(search.search(query_set(table(spark, sf_dir)), index(spark, sf_dir), S.SearchParams(4, 4, "ambiguous-only")))


def two_phase(expr: str) -> str:
    return staged(f"CASE WHEN {O.gate('p2.votes', 'q.')} THEN {expr} ELSE p2.votes END")


def _mode(mode: str, exact: bool = False):
    def run(spark, sf_dir):
        return answer(search.search(query_set(table(spark, sf_dir)), index(spark, sf_dir), S.SearchParams(2, 4, mode, exact)))

    return run


query("q23_two_phase_off", two_phase("p4.votes"))(_mode("off"))
query("q23_two_phase_ambiguous", two_phase("flat.votes"))(_mode("ambiguous-only"))
query("q23_two_phase_always", f"{FLAT} SELECT {VOTED} FROM flat")(_mode("always"))
query("q23_two_phase_boundary", two_phase(f"CASE WHEN p4.votes IN (2, 3) OR {O.low_risk('p4.votes', 'q.')} OR {O.high_risk('p4.votes', 'q.')} THEN flat.votes ELSE p4.votes END"))(_mode("boundary-only"))
query("q24_exact_fallback", two_phase("CASE WHEN (p4.votes < 3) <> (p2.votes < 3) THEN flat.votes ELSE p4.votes END"))(_mode("off", True))


def _validated(spark, sf_dir):
    rows, made = query_set(table(spark, sf_dir)), index(spark, sf_dir)
    got = search.search(rows, made, S.SearchParams(4, 4, "off"))
    expected = rows.select("qid", (F.col("label") == 0).alias("expected_approved"), validate.expected_votes(F.col("label").cast("double")).alias("expected_votes"))
    return got.join(expected, "qid").withColumn("ok", F.lit(True)), made


EXPECTED = f"{FULL}, e AS MATERIALIZED (SELECT q.event_id AS qid, p4.votes, p4.votes < 3 AS approved, q.label = 0 AS expected_approved, q.label * 5 AS expected_votes FROM queries q JOIN p4 ON p4.qid = q.event_id), a AS (SELECT count(*) AS validated, count(*) FILTER (approved <> expected_approved) AS mismatches, count(*) FILTER (approved <> expected_approved AND expected_approved) AS fp, count(*) FILTER (approved <> expected_approved AND NOT expected_approved) AS fn, count(*) FILTER (votes <> expected_votes) AS diff, count(*) FILTER (approved AND expected_approved) AS tn, count(*) FILTER (NOT approved AND NOT expected_approved) AS tp FROM e)"


@query("q25_confusion", f"{EXPECTED} SELECT validated, mismatches, fp AS false_positive, fn AS false_negative, fp + 3 * fn AS weighted_errors, cast(0 AS bigint) AS parse_errors, diff AS fraud_count_diff, validated AS expanded, (SELECT cast(sum(c.n) AS double) FROM p4_near x JOIN cents c ON c.list_id = x.list_id) / validated AS avg_candidates, cast(100 AS double) * mismatches / validated AS mismatch_rate FROM a")
def q25(spark, sf_dir):
    rows, made = _validated(spark, sf_dir)
    return validate.report(rows, S.SearchParams(4, 4, "off"), made).select("validated", "mismatches", "false_positive", "false_negative", "weighted_errors", "parse_errors", "fraud_count_diff", "expanded", "avg_candidates", "mismatch_rate")


@query("q26_score_formula", f"{EXPECTED}, s AS (SELECT *, fp + 3 * fn AS e, cast(fp + fn AS double) / validated AS failure FROM a) SELECT e AS weighted_errors, round(cast(e AS double) / validated, 6) AS epsilon, round(failure, 6) AS failure_rate, round(1000 * log10(cast(1000 AS double) / 2.5), 4) AS p99_score, round(CASE WHEN failure > 0.15 THEN -3000 ELSE 1000 * log10(1 / greatest(cast(e AS double) / validated, 0.001)) - 300 * log10(1.0 + e) END, 4) AS detection_score FROM s")
def q26(spark, sf_dir):
    rows, _ = _validated(spark, sf_dir)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    a, x = F.col("approved"), F.col("expected_approved")
    counts = rows.agg(n(~a & ~x).alias("tp"), n(a & x).alias("tn"), n(~a & x).alias("fp"), n(a & ~x).alias("fn"), F.lit(0).alias("err"), F.lit(2.5).alias("p99"))
    r = lambda c, k: F.round(c, k).alias(c)
    return validate.load_score(counts).select("weighted_errors", r("epsilon", 6), r("failure_rate", 6), r("p99_score", 4), r("detection_score", 4))


@query("q27_dataset_stats", f"{BASE} SELECT count(*) AS total, count(*) FILTER (label <> 0) AS fraud_count, count(*) FILTER (label = 0) AS legit_count, count(*) FILTER (v5 < 0) AS edge_case_count, round(cast(count(*) FILTER (label <> 0) AS double) / count(*), 6) AS fraud_rate FROM vec")
def q27(spark, sf_dir):
    s = validate.dataset_stats(table(spark, sf_dir), edge=F.col("v5") < 0)
    return s.select("total", "fraud_count", "legit_count", "edge_case_count", F.round("fraud_rate", 6).alias("fraud_rate"))


@query("q28_stride_sample", "SELECT i * n // 777 AS orig_id FROM range(777) r(i) CROSS JOIN (SELECT count(*) AS n FROM events)")
def q28(spark, sf_dir):
    return ivf.stride_sample(refs(spark, sf_dir), 777).select("orig_id")


@query("q29_bin_clamped", f"{BASE} SELECT event_id, {', '.join(f'cast(least(floor({O.clamp(c)} * {O.f32(16)}), 15) AS int) AS {c}' for c in S.V)} FROM vec")
def q29(spark, sf_dir):
    return vectors(spark, sf_dir).select("event_id", *[X.bin_clamped(F.col(c), 16).alias(c) for c in S.V])


@query("q30_kmeans_assign", f"{BASE},\n{O.kmeans(4, 2048, 3)} SELECT event_id AS orig_id, list_id FROM ({O.nearest('vec', 'k3')})")
def q30(spark, sf_dir):
    rows, _ = ivf.kmeans(refs(spark, sf_dir), 16, 2048, 3)
    return rows.select("orig_id", "list_id")


EMB = "e AS MATERIALIZED (SELECT vec_id, label, {} FROM embeddings)".format(", ".join(f"{O.quantize(f'embedding[{k + 1}]')} AS q{k}" for k in range(64)))


@query("q31_embeddings_knn", f"WITH {EMB} SELECT qid, orig_id, dist, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS orig_id, {O.distance('a', 'b', 64)} AS dist, cast(row_number() OVER (PARTITION BY a.vec_id ORDER BY {O.distance('a', 'b', 64)}, b.vec_id) AS int) AS rank FROM e a CROSS JOIN e b WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def q31(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select("vec_id", F.col("label").cast("byte").alias("label"), *[X.quantize(F.element_at("embedding", k + 1)).alias(f"q{k}") for k in range(64)])
    dims = [f"q{k}" for k in range(64)]
    return knn.flat(query_set(rows, "vec_id"), rows.withColumnRenamed("vec_id", "orig_id"), dims, 5).select("qid", "orig_id", "dist", "rank")


@query("q32_mismatch_dump", f"{EXPECTED} SELECT e.qid, e.votes, flat.votes AS exact_votes, expected_approved, {', '.join(f'q.q{k}' for k in O.DIMS)} FROM e JOIN flat ON flat.qid = e.qid JOIN queries q ON q.event_id = e.qid WHERE approved <> expected_approved")
def q32(spark, sf_dir):
    rows, made = _validated(spark, sf_dir)
    wrong = ivf.cut(validate.mismatches(rows).select("qid", "votes", "expected_approved"), "wrong")
    asked = query_set(table(spark, sf_dir)).select("qid", *S.Q).join(wrong.select("qid"), "qid", "left_semi")
    exact = search.probe(asked, made, 4, True).select("qid", F.col("votes").alias("exact_votes"))
    return wrong.join(exact, "qid").join(asked, "qid").select("qid", "votes", "exact_votes", "expected_approved", *S.Q)


@query("q33_response_json", f"{FLAT} SELECT qid, concat('{{\"approved\":', CASE WHEN votes < 3 THEN 'true' ELSE 'false' END, ',\"fraud_score\":', ['0.0', '0.2', '0.4', '0.6', '0.8', '1.0'][votes + 1], '}}') AS response FROM flat")
def q33(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return search.flat_search(query_set(table(spark, sf_dir)), rows).select("qid", R.response_json(F.col("votes")).alias("response"))


@query("q34_streaming_score", f"{FLAT} SELECT {VOTED} FROM flat")
def q34(spark, sf_dir):
    import uuid

    from ..streaming import score

    root = f"{ivf.scratch(spark)}/stream-{uuid.uuid4().hex}"
    bodies(spark, sf_dir).select(F.col("event_id").alias("qid"), "body").write.parquet(f"{root}/in")
    source = spark.readStream.schema("qid bigint, body string").parquet(f"{root}/in")
    score.score_stream(source, index(spark, sf_dir), f"{root}/out", f"{root}/state", S.SearchParams(2, 4, "always")).awaitTermination()
    return answer(spark.read.parquet(f"{root}/out").drop("batch"))


MISFIT = "q.event_id % 100 IN (0, 20)"  # requests without a merchant
CHECKED = f"{FULL}, e AS MATERIALIZED (SELECT q.event_id AS qid, NOT ({MISFIT}) AS ok, CASE WHEN {MISFIT} THEN 0 ELSE p4.votes END AS votes, q.label = 0 AS expected_approved, q.label * 5 AS expected_votes FROM queries q JOIN p4 ON p4.qid = q.event_id), a AS (SELECT count(*) AS validated, count(*) FILTER ((votes < 3) <> expected_approved) AS mismatches, count(*) FILTER (votes >= 3 AND expected_approved) AS fp, count(*) FILTER (votes < 3 AND NOT expected_approved) AS fn, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (votes <> expected_votes) AS diff FROM e)"


@query("q35_validate_files", f"{CHECKED} SELECT cast(32 AS bigint) AS nlist, 'off' AS bbox_mode, validated, mismatches, fp AS false_positive, fn AS false_negative, fp + 3 * fn + 5 * bad AS weighted_errors, bad AS parse_errors, diff AS fraud_count_diff, validated - bad AS expanded, cast(0 AS bigint) AS repaired_clusters, (SELECT cast(sum(c.n) AS double) FROM p4_near x JOIN cents c ON c.list_id = x.list_id JOIN e ON e.qid = x.qid WHERE ok) / validated AS avg_candidates, cast(100 AS double) * mismatches / validated AS mismatch_rate FROM a")
def q35(spark, sf_dir):
    """Labelled queries as JSON lines, some malformed, against a saved and reopened index; the report's file is read."""
    import uuid

    root = f"{ivf.scratch(spark)}/validate-{uuid.uuid4().hex}"
    index(spark, sf_dir).save(f"{root}/index")
    label = table(spark, sf_dir).select("event_id", "label")
    bodies = T.payloads(T.transactions(T.events(spark, sf_dir))).filter(F.col("event_id") % 20 == 0).select("event_id", "body").join(label, "event_id")
    body = F.when((F.col("event_id") % 100).isin(0, 20), F.replace("body", F.lit('"merchant":'), F.lit('"seller":'))).otherwise(F.col("body"))
    line = F.concat(F.lit('{"idx":'), F.col("event_id"), F.lit(',"request":'), body, F.lit(',"expected_approved":'), F.when(F.col("label") == 0, "true").otherwise("false"), F.lit(',"expected_fraud_score":'), F.col("label").cast("double"), F.lit("}"))
    bodies.select(line.alias("value")).write.text(f"{root}/queries.jsonl")
    settings = S.validate_settings(["--index", f"{root}/index", "--queries", f"{root}/queries.jsonl", "--base-nprobe", "4", "--ambig-nprobe", "4", "--bbox-mode", "off", "--out-json", f"{root}/report"])
    validate.validate(spark, settings)
    names = ["validated", "mismatches", "false_positive", "false_negative", "weighted_errors", "parse_errors", "fraud_count_diff", "expanded", "repaired_clusters"]
    return spark.read.schema(", ".join(["nlist bigint", "bbox_mode string", *[f"{n} bigint" for n in names], "avg_candidates double", "mismatch_rate double"])).json(f"{root}/report")


def _folder(spark, name: str) -> str:
    import uuid

    return f"{ivf.scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _as_json(rows: DataFrame) -> DataFrame:
    """References as their JSON text, with the label's two words."""
    word = F.when(F.col("label") != 0, "fraud").otherwise("legit")
    return rows.select("orig_id", F.array(*v()).alias("vector"), word.alias("label"))


@query("q36_reference_lines", f"{BASE} SELECT event_id AS orig_id, label, {', '.join(S.Q)} FROM vec")
def q36(spark, sf_dir):
    """All references through gzipped JSON lines."""
    path = _folder(spark, "lines")
    _as_json(refs(spark, sf_dir)).write.option("compression", "gzip").json(path)
    return readers.read_reference_lines(spark, path).select("orig_id", "label", *S.Q)


def _centroid_q(k: int) -> str:
    return f"{O.quantize(f'c{k}')} AS q{k}"


@query("q37_reference_array", f"{TREE} SELECT cast(list_id AS bigint) AS orig_id, cast(list_id % 2 AS tinyint) AS label, {', '.join(_centroid_q(k) for k in O.DIMS)} FROM cents")
def q37(spark, sf_dir):
    """One gzipped JSON array in one file: the centroids, of which there are 16384 at most."""
    path = _folder(spark, "array")
    cents = index(spark, sf_dir).centroids.select(F.col("list_id").alias("orig_id"), (F.col("list_id") % 2).alias("label"), *[F.col(f"c{k}").alias(f"v{k}") for k in range(S.DIMS)])
    items = F.array_sort(F.collect_list(F.struct("orig_id", "vector", "label")))
    bare = F.transform(items, lambda x: F.struct(x["vector"].alias("vector"), x["label"].alias("label")))
    _as_json(cents).agg(F.to_json(bare).alias("value")).coalesce(1).write.option("compression", "gzip").text(path)
    return readers.read_references(spark, path).select("orig_id", "label", *S.Q)


@query("q38_entry_limit", f"{BASE} SELECT event_id AS idx, label = 0 AS expected_approved, CASE WHEN event_id % 40 = 0 THEN cast(label AS double) * 0.8 ELSE cast(label AS double) END AS expected_fraud_score, {O.values()} FROM vec WHERE event_id % 20 = 0 ORDER BY event_id LIMIT 300")
def q38(spark, sf_dir):
    """The first 300 labelled queries of a file of lines (the reader's limit), parsed; a score left out follows from the
    expected decision."""
    path = _folder(spark, "entries")
    label = table(spark, sf_dir).select("event_id", "label")
    bodies = T.payloads(T.transactions(T.events(spark, sf_dir))).filter(F.col("event_id") % 20 == 0).select("event_id", "body").join(label, "event_id")
    given = F.when(F.col("event_id") % 40 == 0, F.concat(F.lit(',"expected_fraud_score":'), (F.col("label") * F.lit(0.8)).cast("double"))).otherwise("")
    line = F.concat(F.lit('{"idx":'), F.col("event_id"), F.lit(',"request":'), F.col("body"), F.lit(',"expected_approved":'), F.when(F.col("label") == 0, "true").otherwise("false"), given, F.lit("}"))
    bodies.select(line.alias("value")).write.text(path)
    return P.parse(readers.read_entry_lines(spark, path, 300)).select("idx", "expected_approved", "expected_fraud_score", *P.request_vector()).select("idx", "expected_approved", "expected_fraud_score", *rounded())


@query("q39_saved_lists", f"{TREE} SELECT cast(list_id AS int) AS list_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, cast(sum(label) AS bigint) AS frauds, cast(0 AS bigint) AS out_of_order FROM lists GROUP BY list_id")
def q39(spark, sf_dir):
    """A saved index opened, warmed and closed again. Rows out of order: those with a smaller (list, id) than the row
    before them in their file."""
    path = _folder(spark, "index")
    index(spark, sf_dir).save(path)
    made = ivf.load(spark, path)
    rows = ivf.warm(made)
    ivf.close(made)
    here = Window.partitionBy("file").orderBy("row")
    key = F.struct("list_id", "orig_id")
    laid = made.refs.select("list_id", "orig_id", "label", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    bad = laid.withColumn("bad", F.coalesce(key < F.lag(key).over(here), F.lit(False)) | (F.lit(rows) != F.lit(made.refs.count())))
    return bad.groupBy("list_id").agg(F.count("*").alias("n"), F.min("orig_id").alias("first_id"), F.max("orig_id").alias("last_id"), F.sum("label").cast("long").alias("frauds"), F.sum(F.col("bad").cast("long")).alias("out_of_order"))


HALF_SIZE = "CASE WHEN abs({0}) < 0.00006103515625 THEN round_even(abs(cast({0} AS double)) * 16777216, 0) ELSE (floor(log2(abs(cast({0} AS double)))) + 14) * 1024 + round_even(abs(cast({0} AS double)) / pow(2, floor(log2(abs(cast({0} AS double)))) - 10), 0) END"
HALF = "(cast(CASE WHEN {0} = 0 THEN 0 ELSE " + HALF_SIZE + " END AS int) + CASE WHEN {0} < 0 THEN 32768 ELSE 0 END)"


@query("q40_half_bits", f"{BASE} SELECT event_id, {', '.join(f'{HALF.format(c)} AS {c}' for c in S.V)} FROM vec")
def q40(spark, sf_dir):
    return table(spark, sf_dir).select("event_id", *[half.to_half(F.col(c)).alias(c) for c in S.V])


@query("q41_half_round_trip", f"{BASE} SELECT event_id, greatest({', '.join(f'abs(cast({c} AS double))' for c in S.V)}) <= 1 AS within FROM vec")
def q41(spark, sf_dir):
    """Whether each value comes back from its bits within half a step of its size, and within the range of features."""
    near = lambda c: F.abs(half.from_half(half.to_half(F.col(c))) - F.col(c)) <= F.greatest(F.abs(F.col(c)) / 2048, F.lit(2.0**-25))
    within = F.lit(True)
    for c in S.V:
        within = within & near(c) & (F.abs(F.col(c)) <= 1)
    return table(spark, sf_dir).select("event_id", within.alias("within"))


SQ = " + ".join(f"(cast(q{k} AS bigint) - {O.quantize(f'c{k}')}) * (cast(q{k} AS bigint) - {O.quantize(f'c{k}')})" for k in O.DIMS)


@query("q42_distance_to_own_centroid", f"{TREE} SELECT l.event_id, cast(l.list_id AS int) AS list_id, {SQ} AS dist FROM lists l JOIN cents c ON c.list_id = l.list_id")
def q42(spark, sf_dir):
    """Fixed-point squared distance of each reference to the centroid of its list; centroids are 16384 at most."""
    made = index(spark, sf_dir)
    cents = F.broadcast(made.centroids.select("list_id", *[X.quantize(F.col(f"c{k}")).alias(f"m{k}") for k in range(S.DIMS)]))
    total = sum((X.sqdiff(F.col(f"q{k}"), F.col(f"m{k}")) for k in range(S.DIMS)), F.lit(0).cast("long"))
    return made.refs.join(cents, "list_id").select(F.col("orig_id").alias("event_id"), "list_id", total.alias("dist"))


def _round_sql(r: int) -> str:
    gap = " + ".join(f"(cast(l.v{k} AS double) - c.c{k}) * (cast(l.v{k} AS double) - c.c{k})" for k in O.DIMS)
    moved = " + ".join(f"cast(a.c{k} <> b.c{k} AS int)" for k in O.DIMS)
    return f"SELECT {r} AS round, (SELECT cast(sum({moved}) AS bigint) FROM k{r} a JOIN k{r + 1} b USING (list_id)) > 0 AS moved, (SELECT round(sum({gap}), 3) FROM ({O.nearest('few', f'k{r}')}) l JOIN k{r} c ON c.list_id = l.list_id) AS inertia"


@query("q43_kmeans_rounds", f"{BASE},\n{O.kmeans(4, 2048, 3)} " + " UNION ALL ".join(_round_sql(r) for r in range(3)))
def q43(spark, sf_dir):
    """What each of Lloyd's rounds reports."""
    _, log = ivf.kmeans(refs(spark, sf_dir), 16, 2048, 3)
    found = [(k, x["moved_dims"] > 0, x["inertia"]) for k, x in enumerate(log)]  # a row a round
    return spark.createDataFrame(found, "round int, moved boolean, inertia double").withColumn("inertia", F.round("inertia", 3))


ALL_MEANS = ", ".join(f"round(cast(coalesce(cast(sum(cast(v{k} AS double)) * (cast(1 AS double) / count(event_id)) AS float), {O.f32(0)}) AS double), 5) AS c{k}" for k in O.DIMS)


@query("q44_kmeans_refresh", f"{BASE},\n{O.kmeans(4, 2048, 3)}, every AS MATERIALIZED ({O.nearest('vec', 'k3')}) SELECT cast(i AS int) AS list_id, count(event_id) AS n, {ALL_MEANS} FROM range(16) r(i) LEFT JOIN every ON list_id = i GROUP BY i")
def q44(spark, sf_dir):
    """Centroids of a k-means index: the means of all rows of each list, not of the sample that trained it."""
    made = ivf.build(refs(spark, sf_dir), 16, "kmeans", 2048, 3)
    return made.centroids.select("list_id", "n", *[F.round(F.col(f"c{k}").cast("double"), 5).alias(f"c{k}") for k in range(S.DIMS)])

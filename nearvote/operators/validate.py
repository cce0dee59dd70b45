"""Validation reports: confusion counts, weighted errors, rates and the load-test score."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import features as X
from ..functions import parse as P
from ..functions import rules as R
from ..sources import readers
from . import ivf, search


def expected_votes(score: Column) -> Column:
    """From a score of 0 to 1; half a vote rounds up."""
    return F.greatest(F.least((score * 5 + 0.5).cast("int"), F.lit(5)), F.lit(0))


def report(rows: DataFrame, params: S.SearchParams, index: ivf.Index | None = None) -> DataFrame:
    """One row from (ok, votes, approved, expected_approved, expected_votes, used_nprobe, used_flat, used_bbox,
    scanned_candidates, repaired_clusters). No rows give zeros."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    wrong = F.col("approved") != F.col("expected_approved")
    fp, fn = n(wrong & F.col("expected_approved")), n(wrong & ~F.col("expected_approved"))
    bad = n(~F.col("ok"))
    a = rows.agg(
        F.count("*").alias("validated"),
        n(wrong).alias("mismatches"),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
        (fp + 3 * fn + 5 * bad).alias("weighted_errors"),
        bad.alias("parse_errors"),
        n(F.col("votes") != F.col("expected_votes")).alias("fraud_count_diff"),
        n(F.col("used_nprobe") >= params.ambig_nprobe).alias("expanded"),
        n(F.col("used_flat")).alias("flat"),
        n(F.col("used_bbox")).alias("bbox"),
        F.coalesce(F.sum("repaired_clusters"), F.lit(0)).cast("long").alias("repaired_clusters"),
        F.coalesce(F.sum("scanned_candidates"), F.lit(0)).cast("long").alias("candidates"),
    )
    rate = lambda x: F.when(F.col("validated") > 0, x / F.col("validated")).otherwise(0.0)
    out = a.select("*", rate(F.col("candidates") * F.lit(1.0)).alias("avg_candidates"), rate(F.col("mismatches") * 100.0).alias("mismatch_rate")).drop("candidates")
    head = {"nlist": F.lit(index.nlist if index else 0), "base_nprobe": F.lit(params.base_nprobe), "ambig_nprobe": F.lit(params.ambig_nprobe), "bbox_mode": F.lit(params.bbox_mode), "exact_fallback": F.lit(params.exact_fallback)}
    return out.select(*[c.alias(k) for k, c in head.items()], *out.columns)


def score_entries(entries: DataFrame, index: ivf.Index, params: S.SearchParams, flat_only: bool = False) -> DataFrame:
    """Labelled queries (idx, body, expected_approved, expected_fraud_score) with their answers, as ``report`` reads
    them. A malformed body counts as approved without votes, and as a parse error; rule shortcuts scan nothing."""
    parsed = P.parse(entries).select(F.col("idx").alias("qid"), "ok", "expected_approved", expected_votes(F.col("expected_fraud_score")).alias("expected_votes"), *P.request_vector())
    v = [F.col(c) for c in S.V]
    rule = R.heuristic_votes(v) if params.heuristic_only else R.fast_path_votes(v) if params.fast_path else F.lit(-1)
    rows = ivf.cut(parsed.withColumn("rule", F.when(F.col("ok"), rule).otherwise(0)), "entries")
    asked = rows.filter("rule < 0").select("qid", *[X.quantize(c).alias(q) for c, q in zip(v, S.Q)])
    found = (search.flat_search(asked, index.refs) if flat_only else search.search(asked, index, params)).select(*search.RESULT)
    votes = F.coalesce(F.col("votes"), F.col("rule")).cast("int")
    out = rows.join(found.drop("approved", "fraud_score"), "qid", "left").withColumn("votes", votes)
    return out.withColumn("approved", R.approved(F.col("votes"))).drop("rule")


def validate(spark: SparkSession, settings: S.ValidateSettings) -> tuple[DataFrame, DataFrame | None]:
    """The whole validation of a saved index on a file of labelled queries (``entries`` as one JSON document, or JSON
    lines where the path ends in .jsonl): the report, written to ``out_json`` where that is set, and the mismatches
    with the answers of a repaired search, where they are asked for."""
    index = ivf.load(spark, settings.index)
    read = readers.read_entry_lines if settings.queries.rstrip("/").endswith(".jsonl") else readers.read_entries
    rows = ivf.cut(score_entries(read(spark, settings.queries, settings.limit), index, settings.params, settings.flat_only), "scored")
    out = report(rows, settings.params, index)
    if settings.out_json:
        readers.write_report(out, settings.out_json)
    if not settings.dump_mismatches:
        return out, None
    wrong = mismatches(rows)
    again = wrong.filter("ok").select("qid", *[X.quantize(F.col(c)).alias(q) for c, q in zip(S.V, S.Q)])
    repaired = search.search(again, index, replace(settings.params, bbox_mode="always")).select("qid", F.col("votes").alias("repaired_votes"), F.col("approved").alias("repaired_approved"), F.col("scanned_candidates").alias("repaired_candidates"))
    return out, wrong.join(repaired, "qid", "left")


def mismatches(rows: DataFrame) -> DataFrame:
    """The rows whose decision differs from the expected one."""
    return rows.filter(F.col("approved") != F.col("expected_approved"))


def load_score(counts: DataFrame) -> DataFrame:
    """(tp, tn, fp, fn, err, p99) to the load test's scores; latency in milliseconds."""
    # Fixed values of the score: 1000 a decade, best at 1 ms, cut beyond 2000 ms or 15 % failures.
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("err")
    e = F.col("fp") + 3 * F.col("fn") + 5 * F.col("err")
    rate = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    rows = counts.select("*", e.alias("weighted_errors"), rate(e).alias("epsilon"), rate(F.col("fp") + F.col("fn") + F.col("err")).alias("failure_rate"))
    p99 = F.when(F.col("p99") <= 0, 0.0).when(F.col("p99") > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest("p99", F.lit(1.0))))
    part = 1000 * F.log10(1 / F.greatest("epsilon", F.lit(0.001)))
    penalty = -300 * F.log10(1.0 + F.col("weighted_errors"))
    cut = F.col("failure_rate") > 0.15
    rows = rows.select("*", p99.alias("p99_score"), F.when(~cut, part).alias("rate_component"), F.when(~cut, penalty).alias("absolute_penalty"), F.when(cut, -3000.0).otherwise(part + penalty).alias("detection_score"))
    return rows.withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def dataset_stats(rows: DataFrame, label: str = "label", edge: Column | None = None) -> DataFrame:
    """total, fraud and legit counts and rates, and those of edge cases."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    a = rows.agg(F.count("*").alias("total"), n(F.col(label) != 0).alias("fraud_count"), n(F.col(label) == 0).alias("legit_count"), n(F.lit(False) if edge is None else edge).alias("edge_case_count"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return a.select("*", rate("fraud_count").alias("fraud_rate"), rate("legit_count").alias("legit_rate"), rate("edge_case_count").alias("edge_case_rate"))

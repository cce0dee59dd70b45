"""Sources and sinks: reference vectors, labelled queries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import features as X


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {vector, label} objects, plain or gzip: orig_id (position), label (1 for fraud...), v.., q.. Raises
    on an element whose vector is missing or not of 14 numbers. One file is one split; the rows are dealt out after
    it. JSON lines with an explicit ``orig_id`` column are read by any number of tasks with ``read_reference_lines``."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<struct<{S.REFERENCES.replace(' array', ': array').replace(' string', ': string')}>>")
    rows = text.select(F.posexplode(items).alias("pos", "e")).select(F.col("pos").cast("long").alias("orig_id"), F.col("e.vector").alias("vector"), F.col("e.label").alias("label"))
    return _references(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def read_reference_lines(spark: SparkSession, path: str) -> DataFrame:
    return _references(spark.read.schema("orig_id bigint, " + S.REFERENCES).json(path))


def _references(rows: DataFrame) -> DataFrame:
    good = F.col("vector").isNotNull() & (F.size("vector") == S.DIMS) & ~F.exists("vector", lambda x: x.isNull()) & F.col("label").isNotNull()
    checked = rows.withColumn("vector", F.when(good, F.col("vector")).otherwise(F.raise_error(F.lit("malformed reference"))))
    out = checked.select("orig_id", F.startswith("label", F.lit("fraud")).cast("byte").alias("label"), *[F.element_at("vector", k + 1).alias(v) for k, v in enumerate(S.V)])
    return out.select("*", *[X.quantize(F.col(v)).alias(q) for v, q in zip(S.V, S.Q)])


def read_entries(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Labelled queries: idx, body (request as JSON), expected_approved, expected_fraud_score; ``limit`` 0 takes all."""
    text = spark.read.text(path, wholetext=True)  # one file is one row; see read_entry_lines
    items = F.from_json("value", "entries array<struct<request: string, expected_approved: boolean, expected_fraud_score: double>>")
    rows = text.select(F.posexplode(items["entries"]).alias("idx", "e"))
    return _entries(rows.select("idx", "e.*"), limit)


def read_entry_lines(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The same from JSON lines, each an entry with its ``idx``: read by any number of tasks."""
    return _entries(spark.read.schema("idx bigint, request string, expected_approved boolean, expected_fraud_score double").json(path), limit)


def _entries(rows: DataFrame, limit: int) -> DataFrame:
    score = F.coalesce("expected_fraud_score", F.when(F.col("expected_approved"), 0.0).otherwise(1.0))
    rows = rows.select(F.col("idx").cast("long").alias("idx"), F.col("request").alias("body"), "expected_approved", score.alias("expected_fraud_score"))
    return rows.orderBy("idx").limit(limit) if limit else rows


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)

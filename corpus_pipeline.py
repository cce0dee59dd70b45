"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet in the shared folder and read
back as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearvote.llm import common, decontam, langid, near_dedup, packing, secret_scan

LEAST_SCORE, LEAST_LEAD = 0.4, 0.05  # cosine, and its lead over the next language, of texts with 200 n-grams or more


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: no letter, or, beyond a few dozen words, too little likeness
    to any prototype (noise, repetition of few strings) or as much to two of them (mixtures).

    The model learns from the labelled part of this stage's own input. Where nothing can be learned, only texts
    without a letter go. Decisions are per text, so rows that share a doc_id are judged each for itself.
    """
    names, prototypes = langid.learn(docs.filter(~langid.held_out(docs["doc_id"])))
    return langid.keep(docs, names, prototypes, LEAST_SCORE, LEAST_LEAD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.representatives(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, and cuts secrets out of its text."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids: a row a piece. Workers share executors with what earlier stages
    left in the JVM, so they keep fewer encoded chunks."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, cache_entries=150_000).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES:
        docs, new = common.stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            common.drop_path(spark, path)
        path = new
    return docs

"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontam, langid, license_scan, near_dedup, oracle, packing, quality, secret_scan, substring_dedup, token_store


TRICKY = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)
    return pieces.drop("ids")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"), length=50)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark))
    return found.select("doc_id", "template_id", "license", "containment")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paths = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    measured, _ = common.stage_table(quality.measure(docs, paths), "quality")
    return quality.judge(measured, quality.bands(measured, table(spark, sf_dir, "labels").filter("quality = 1")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    rows = common.pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(extra)
    blocks, _ = common.stage_table(chat.render(rows, path), "chat")
    return chat.read_back(blocks, path).drop("n_tokens", "loss_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_store(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_near_dedup": op6_near_dedup,
    "op7_chat": op7_chat,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_store": op10_token_store,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracle.substrings(),
    "op4_license_scan": oracle.licenses(),
    "op6_near_dedup": oracle.near_copies(),
    "op7_chat": oracle.conversations(TRICKY),
}

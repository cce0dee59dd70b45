"""Requests as JSON text: strict parsing, and the step from a parsed request to its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import features as X


def parse(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``request`` (null if malformed) and ``ok``. Every scalar but ``known_merchants`` is required, and the key
    ``last_transaction`` must be there, with null or an object that has both of its fields. Numbers are read as
    doubles; counts are truncated. Unknown keys are ignored."""
    keys = F.from_json(F.col(body), "map<string,string>")
    r = F.from_json(F.col(body), "struct<" + S.REQUEST.replace(" struct", ": struct") + ">")
    rows = df.withColumn("_r", r).withColumn("_k", keys)
    needed = ["transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"]
    ok = F.col("_r").isNotNull()
    for name in needed:
        ok = ok & F.col(f"_r.{name}").isNotNull()
    last = F.col("_r.last_transaction")
    whole = F.col("_r.last_transaction.timestamp").isNotNull() & F.col("_r.last_transaction.km_from_current").isNotNull()
    ok = ok & F.coalesce(F.map_contains_key("_k", F.lit("last_transaction")), F.lit(False)) & (F.element_at("_k", F.lit("last_transaction")).isNull() | whole)
    ok = ok & X.timestamp_ok(F.col("_r.transaction.requested_at")) & (last.isNull() | X.timestamp_ok(F.col("_r.last_transaction.timestamp")))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("request", F.when(F.col("ok"), F.col("_r"))).drop("_r", "_k")


def request_vector(r: str = "request") -> list[Column]:
    """Features of a parsed request column; null where it is null."""
    now, last = X.parse_iso(F.col(f"{r}.transaction.requested_at")), X.parse_iso(F.col(f"{r}.last_transaction.timestamp"))
    has_last = F.col(f"{r}.last_transaction").isNotNull()
    out = X.vector(
        F.col(f"{r}.transaction.amount"),
        F.col(f"{r}.transaction.installments").cast("int"),
        F.col(f"{r}.customer.avg_amount"),
        now["hour"],
        now["weekday"],
        F.greatest(F.lit(0).cast("long"), now["epoch_s"] - last["epoch_s"]),
        F.col(f"{r}.last_transaction.km_from_current"),
        has_last,
        F.col(f"{r}.terminal.km_from_home"),
        F.col(f"{r}.customer.tx_count_24h").cast("int"),
        F.col(f"{r}.terminal.is_online"),
        F.col(f"{r}.terminal.card_present"),
        X.is_known(F.col(f"{r}.customer.known_merchants"), F.col(f"{r}.merchant.id")),
        F.col(f"{r}.merchant.mcc"),
        F.col(f"{r}.merchant.avg_amount"),
    )
    return [F.when(F.col(r).isNotNull(), c).alias(n) for c, n in zip(out, S.V)]

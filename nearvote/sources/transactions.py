"""Transactions derived from the event table, and their request payloads.

Per-user history needs no user's events in one task: the 24-hour count and the previous event come from windows over
(user, day) into which the day before is copied, and all else about a user from one row a user and day, which joins
where the windows ran. So events are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import features as X

DAY_US = 86_400_000_000
MCCS = [*S.MCC_RISK, "0000", "9999"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def transactions(ev: DataFrame) -> DataFrame:
    """One typed transaction an event, with label and history features."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    base = ev.select("event_id", "user_id", "event_type", us.alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"), k.alias("k"))
    base = base.withColumns({"sec": F.expr("us div 1000000"), "day": F.expr(f"us div {DAY_US}"), "merchant": F.expr("k % 20")})
    wide = ["event_type", "cents", "k", "merchant"]
    copies = base.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    copies = copies.select("event_id", "user_id", "us", "sec", (F.col("day") + F.col("shift")).alias("day"), "shift", *[F.when(F.col("shift") == 0, F.col(c)).alias(c) for c in wide])
    line = Window.partitionBy("user_id", "day").orderBy("us", "event_id")
    span = Window.partitionBy("user_id", "day").orderBy("us").rangeBetween(-DAY_US, 0)
    near = copies.withColumn("prev", F.lag("sec").over(line)).withColumn("count_24h", F.count("*").over(span) - 1).filter("shift = 0")
    first = base.groupBy("user_id", "merchant").agg(F.min(F.struct("us", "event_id")).alias("first"))
    firsts = first.groupBy("user_id", F.expr(f"first.us div {DAY_US}").alias("day")).agg(F.collect_list("first.event_id").alias("firsts"))  # at most one a merchant
    user = Window.partitionBy("user_id")
    days = base.groupBy("user_id", "day").agg(F.max("sec").alias("last"), F.sum("cents").alias("cents"), F.count("*").alias("n"))
    days = days.select("user_id", "day", F.lag("last").over(user.orderBy("day")).alias("before"), F.sum("cents").over(user).alias("user_cents"), F.sum("n").over(user).alias("user_n"))
    by_shop = base.groupBy("merchant").agg(F.sum("cents").alias("shop_cents"), F.count("*").alias("shop_n"))  # at most 39 rows
    history = days.join(firsts, ["user_id", "day"], "left")
    rows = near.join(history, ["user_id", "day"]).join(F.broadcast(by_shop), "merchant")
    money = lambda c: F.col(c) * 20 / F.lit(100.0)
    far = F.expr("(event_id * 37) % 1200")
    return rows.select(
        "event_id",
        money("cents").alias("amount"),
        F.expr("cast(k % 12 + 1 as int)").alias("installments"),
        "sec",
        F.expr("cast(sec % 86400 div 3600 as int)").alias("hour"),
        F.expr("cast((day + 3) % 7 as int)").alias("weekday"),
        (money("user_cents") / F.col("user_n")).alias("customer_avg"),
        F.col("count_24h").cast("int").alias("count_24h"),
        F.coalesce("prev", "before").alias("last_sec"),
        F.expr("cast((event_id * 53) % 1100 as double)").alias("last_km"),
        F.concat(F.lit("M-"), F.col("merchant")).alias("merchant_id"),
        F.element_at(F.array(*map(F.lit, MCCS)), F.expr("cast(k % 12 + 1 as int)")).alias("mcc"),
        (money("shop_cents") / F.col("shop_n")).alias("merchant_avg"),
        (~F.coalesce(F.array_contains("firsts", F.col("event_id")), F.lit(False))).alias("known"),
        F.col("event_type").isin("click", "view").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        far.cast("double").alias("home_km"),
        ((far >= 700) | (F.col("cents") >= 12000)).cast("byte").alias("label"),
    )


def vectors(tx: DataFrame, *keep: str) -> DataFrame:
    """event_id, label, features v0..v13 and their fixed-point forms q0..q13."""
    has = F.col("last_sec").isNotNull()
    cols = X.vector(*map(F.col, ("amount", "installments", "customer_avg", "hour", "weekday")), F.greatest(F.lit(0).cast("long"), F.col("sec") - F.col("last_sec")), F.col("last_km"), has, *map(F.col, ("home_km", "count_24h", "is_online", "card_present", "known", "mcc", "merchant_avg")))
    out = tx.select("event_id", "label", *keep, *cols)
    return out.select("*", *[X.quantize(F.col(v)).alias(q) for v, q in zip(S.V, S.Q)])


def body() -> Column:
    """A transaction's request as JSON text. Nulls inside are written, as the parser needs the key."""
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    last = F.when(F.col("last_sec").isNotNull(), F.struct(iso("last_sec").alias("timestamp"), F.col("last_km").alias("km_from_current")))
    return F.to_json(
        F.struct(
            F.struct("amount", "installments", iso("sec").alias("requested_at")).alias("transaction"),
            F.struct(F.col("customer_avg").alias("avg_amount"), F.col("count_24h").alias("tx_count_24h"), F.when(F.col("known"), F.array("merchant_id")).otherwise(F.array(F.lit("M-none"))).alias("known_merchants")).alias("customer"),
            F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
            F.struct("is_online", "card_present", F.col("home_km").alias("km_from_home")).alias("terminal"),
            last.alias("last_transaction"),
        ),
        {"ignoreNullFields": "false"},
    )


def payloads(tx: DataFrame) -> DataFrame:
    """event_id, label and the request."""
    return tx.select("event_id", "label", body().alias("body"))

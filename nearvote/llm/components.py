"""Connected components over a distributed list of links, by alternating star contraction.

Each step hangs nodes below smaller neighbours (large star: every larger neighbour below a node's least neighbour;
small star: a node and its smaller neighbours below the least of them) until every link is (node, least node of its
component). Only minima are aggregated, so a hub's neighbours never meet in one row. Minima are tables before links
join them: both sides of a join are then plain exchanges, which adaptive execution splits where a hub makes one large.
Each round ends in a table, and the table of the round before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _below(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo")


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link that isn't its component's least: ``root`` is the least. Links with a
    null end and links of a node with itself are left out; repeated links count once."""
    spark = links.sparkSession
    edges, path = common.stage_table(_below(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("x")).select("x.*")
        least, least_path = common.stage_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        # A node that is its own least neighbour keeps its links.
        large = edges.join(least.filter("m < u").withColumnRenamed("u", "lo"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large, large_path = common.stage_table(large.distinct(), "links-large")
        down, down_path = common.stage_table(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "links-down")
        # A node with one smaller neighbour hangs below it already: only the others' neighbours move.
        several = large.join(down.filter("n > 1"), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = _below(several.unionByName(down.select("hi", F.col("m").alias("lo"))), "hi", "lo").distinct()
        edges, new = common.stage_table(small, "links")
        after = _state(edges)
        for old in (path, least_path, large_path, down_path):
            common.drop_path(spark, old)
        path = new
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))

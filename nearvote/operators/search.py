"""Staged search over the inverted-file index.

Which lists a query reads is decided in stages, as in an adaptive plan: probe the nearest lists, look at the vote,
and read more only where the gate asks for it. Each stage is a distributed plan over the queries that reached it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import rules as R
from . import ivf, knn

RESULT = ["qid", "votes", "approved", "fraud_score", "d5", "used_nprobe", "used_flat", "used_bbox", "scanned_candidates", "repaired_clusters"]


def probes(queries: DataFrame, index: ivf.Index, nprobe: int) -> DataFrame:
    """queries (qid, q0..q13) with a row for each of the nearest ``nprobe`` lists, by (distance of the fixed-point
    query read back as single precision, list_id). The centroid table, at most 16384 rows, goes with the plan."""
    n = min(max(nprobe, 1), S.MOST_PROBE, index.nlist)
    cents = ivf.as_matrix(index.centroids, index.dims)
    schema = queries.select("*", F.lit(0).alias("list_id")).schema

    def run(batches):
        for batch in batches:
            q = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in S.Q], axis=1).astype(np.float32) / np.float32(S.SCALE)
            for a in range(0, len(q), 1024):
                dist = ivf.centroid_distances(q[a : a + 1024], cents)
                near = np.argsort(dist, axis=1, kind="stable")[:, :n]
                rows = batch.take(pa.array(np.repeat(np.arange(a, a + len(near)), n)))
                yield rows.append_column("list_id", pa.array(near.reshape(-1).astype(np.int32)))

    return queries.mapInArrow(run, schema)


def lower_bound(q: list[Column], mn: list[Column], mx: list[Column]) -> Column:
    """Least squared distance from a query to a box."""
    total = F.lit(0).cast("long")
    for x, a, b in zip(q, mn, mx):
        gap = F.greatest(a.cast("int") - x.cast("int"), x.cast("int") - b.cast("int"), F.lit(0)).cast("long")
        total = total + gap * gap
    return total


def repair_probes(queries: DataFrame, index: ivf.Index, nprobe: int) -> DataFrame:
    """queries (qid, q.., worst) with a row for each unprobed, non-empty list whose box is within ``worst``, equality
    included; a null ``worst`` (fewer than five neighbours) takes every list."""
    n = min(max(nprobe, 1), S.MOST_PROBE, index.nlist)
    cents = ivf.as_matrix(index.centroids, index.dims)
    rows = index.boxes.orderBy("list_id").collect()  # at most 16384
    mn = np.array([[r[f"mn{k}"] for k in range(index.dims)] for r in rows], np.int64)
    mx = np.array([[r[f"mx{k}"] for k in range(index.dims)] for r in rows], np.int64)
    filled = np.array([r["n"] > 0 for r in rows])
    schema = queries.select("*", F.lit(0).alias("list_id")).schema

    def run(batches):
        for batch in batches:
            q = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in S.Q], axis=1).astype(np.int64)
            worst = batch.column("worst").to_pandas().fillna(np.iinfo(np.int64).max).to_numpy(np.float64)
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                dist = ivf.centroid_distances(part.astype(np.float32) / np.float32(S.SCALE), cents)
                skip = np.zeros(dist.shape, bool)
                np.put_along_axis(skip, np.argsort(dist, axis=1, kind="stable")[:, :n], True, axis=1)
                bound = np.zeros(dist.shape, np.int64)
                for d in range(q.shape[1]):
                    gap = np.maximum(np.maximum(mn[None, :, d] - part[:, d : d + 1], part[:, d : d + 1] - mx[None, :, d]), 0)
                    bound += gap * gap
                at, lists = np.nonzero(~skip & filled[None, :] & (bound <= worst[a : a + 256, None]))
                yield batch.take(pa.array(at + a)).append_column("list_id", pa.array(lists.astype(np.int32)))

    return queries.mapInArrow(run, schema)


def _blocks(index: ivf.Index) -> DataFrame:
    """The index's references in blocks, written at its first search."""
    if index.blocks is None:
        index.blocks = ivf.cut(knn.pack(index.refs, "orig_id", S.Q, "label"), "blocks")
    return index.blocks


def _counts(probed: DataFrame, index: ivf.Index, name: str) -> DataFrame:
    sizes = index.centroids.select("list_id", "n")
    return probed.select("qid", "list_id").join(sizes, "list_id").groupBy("qid").agg(F.sum("n").alias(f"{name}_rows"), F.count("*").alias(f"{name}_lists"))


def _answer(top: DataFrame, queries: DataFrame, nprobe: int, counts: DataFrame, repaired: DataFrame | None, bbox: bool) -> DataFrame:
    out = knn.vote(top, queries, S.K).join(counts, "qid", "left")
    more, lists = F.lit(0), F.lit(0)
    if repaired is not None:
        out = out.join(repaired, "qid", "left")
        more, lists = F.coalesce("more_rows", F.lit(0)), F.coalesce("more_lists", F.lit(0))
    return out.select("qid", "votes", "approved", "fraud_score", "d5", F.lit(nprobe).alias("used_nprobe"), F.lit(False).alias("used_flat"), F.lit(bbox).alias("used_bbox"), (F.coalesce("base_rows", F.lit(0)) + more).cast("long").alias("scanned_candidates"), lists.cast("long").alias("repaired_clusters"))


def probe(queries: DataFrame, index: ivf.Index, nprobe: int, repair: bool = False) -> DataFrame:
    """One probe of the index, with or without repair. With repair the neighbours are exact: every list left out lies
    beyond the fifth. The repair bound is the fifth distance after the probe, so its counters may exceed those of a
    scan that tightens as it goes; the neighbours are the same. Inside the repaired lists nothing beyond it is read."""
    near = ivf.cut(probes(queries, index, nprobe).select("qid", "list_id", *S.Q), "probes")
    counts = _counts(near, index, "base")
    used = min(max(nprobe, 1), S.MOST_PROBE, index.nlist)
    top = knn.search_blocks(near, _blocks(index), index.centroids, S.Q, S.K)
    if not repair:
        return _answer(top, queries, used, counts, None, False)
    top = ivf.cut(top, "top")
    worst = knn.vote(top, queries, S.K).select("qid", F.col("d5").cast("double").alias("worst"))
    more = ivf.cut(repair_probes(queries.select("qid", *S.Q).join(worst, "qid"), index, nprobe).select("qid", "list_id", "worst", *S.Q), "repair")
    found = knn.search_blocks(more, _blocks(index), index.centroids, S.Q, S.K)
    both = knn.top(top.drop("rank").unionByName(found.drop("rank")), S.K)
    return _answer(both, queries, used, counts, _counts(more, index, "more"), True)


def _gated(result: DataFrame, queries: DataFrame) -> DataFrame:
    return result.join(queries.select("qid", *S.Q), "qid").filter(R.gate(F.col("votes"), [F.col(c) for c in S.Q])).select("qid")


def _replace(result: DataFrame, newer: DataFrame) -> DataFrame:
    return result.join(newer.select("qid"), "qid", "left_anti").select(*RESULT).unionByName(newer.select(*RESULT))


def probe_if_needed(queries: DataFrame, index: ivf.Index, nprobe: int) -> DataFrame:
    """A probe, repaired for the queries that the gate picks."""
    base = ivf.cut(probe(queries, index, nprobe), "base")
    picked = queries.join(_gated(base, queries), "qid", "left_semi")
    return _replace(base, probe(picked, index, nprobe, True))


def flat_search(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """The exact vote over all references."""
    got = knn.vote(knn.flat(queries.select("qid", *S.Q), refs, S.Q, S.K), queries, S.K)
    n = refs.count()
    return got.select("qid", "votes", "approved", "fraud_score", "d5", F.lit(0).alias("used_nprobe"), F.lit(True).alias("used_flat"), F.lit(False).alias("used_bbox"), F.lit(n).cast("long").alias("scanned_candidates"), F.lit(0).cast("long").alias("repaired_clusters"))


def search(queries: DataFrame, index: ivf.Index, params: S.SearchParams = S.SearchParams()) -> DataFrame:
    """The two-phase search over queries (qid, q0..q13)."""
    mode, base_n, ambig_n = params.bbox_mode, params.base_nprobe, params.ambig_nprobe
    if not params.exact_fallback and base_n == ambig_n:
        if mode == "always":
            return probe(queries, index, ambig_n, True)
        if mode == "ambiguous-only":
            return probe_if_needed(queries, index, ambig_n)
        if mode == "off":
            return probe(queries, index, ambig_n)
    base = ivf.cut(probe(queries, index, base_n, mode == "always"), "base")
    picked = ivf.cut(queries.join(_gated(base, queries), "qid", "left_semi"), "picked")
    more = probe(picked, index, ambig_n, mode in ("always", "ambiguous-only"))
    if mode == "boundary-only":
        more = ivf.cut(more, "expanded")
        q = [F.col(c) for c in S.Q]
        close = F.col("votes").isin(2, 3) | R.low_risk_denial(F.col("votes"), q) | R.high_risk_approval(F.col("votes"), q)
        edge = more.join(picked.select("qid", *S.Q), "qid").filter(close).select("qid")
        more = _replace(more, probe(picked.join(edge, "qid", "left_semi"), index, ambig_n, True))
    if params.exact_fallback:
        more = ivf.cut(more, "expanded")
        changed = more.join(base.select("qid", F.col("approved").alias("was")), "qid").filter("approved <> was").select("qid", F.col("used_nprobe").alias("np"))
        exact = flat_search(picked.join(changed, "qid", "left_semi"), index.refs).join(changed, "qid").withColumn("used_nprobe", F.col("np"))
        more = _replace(more, exact)
    return _replace(base, more)


def score(requests: DataFrame, index: ivf.Index, params: S.SearchParams = S.SearchParams()) -> DataFrame:
    """votes of parsed requests (qid, ok, v.., q..): the rule shortcuts where they are on, the search for the rest.
    A malformed request counts as approved without votes."""
    v = [F.col(c) for c in S.V]
    if params.heuristic_only:
        rule = R.heuristic_votes(v)
    elif params.fast_path:
        rule = R.fast_path_votes(v)
    else:
        rule = F.lit(-1)
    ruled = ivf.cut(requests.withColumn("rule", F.when(F.col("ok"), rule).otherwise(0)), "ruled")
    direct = ruled.filter("rule >= 0").select("qid", F.col("rule").cast("int").alias("votes"))
    searched = search(ruled.filter("rule < 0"), index, params).select("qid", F.col("votes").cast("int").alias("votes"))
    votes = direct.unionByName(searched)
    return votes.select("qid", "votes", R.approved(F.col("votes")).alias("approved"), R.fraud_score(F.col("votes")).alias("fraud_score"))

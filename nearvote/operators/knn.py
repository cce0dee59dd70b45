"""Nearest-neighbour kernels over packed blocks.

Rows travel as blocks: one row holds up to some thousand queries or references of one list as binary arrays. The blocks
of a list meet in one task, references first. There they become small leaves with boxes; a query reads a leaf only where
its box is within the query's k-th distance so far, ties included. Distances are exact integers (double-precision
products of 16-bit integers are exact), and the k least by (distance, id) are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import ivf

BLOCK = "list_id int, n int, ids binary, labels binary, worst binary, data binary"
TOP = "qid bigint, orig_id bigint, dist bigint, label tinyint, list_id int"
REF_ROWS, QUERY_ROWS, GATHER_ROWS = 8192, 1024, 65536
FIRST_ROWS, NEXT_ROWS = 512, 1024  # references of which there are two leaves, and four
LEAF_ROWS, NEAR_LEAVES = FIRST_ROWS // 2, 8  # references in a leaf at least; leaves read before the rest are looked at again
SALT_BLOCKS = 16  # reference blocks of a list that share a join key
CHUNK_ROWS = 32768  # queries of a list that share a join key
CELL_ROWS, SAMPLE_ROWS, MOST_CELLS = 32768, 65536, 16384  # exact search: references in a cell, and what its cuts are fitted on
FAR = np.int64(1) << 62


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(cols: Sequence, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, fields)], schema=fields)


def matrix(batch: pa.RecordBatch, dims: Sequence[str], kind: type = np.int16) -> np.ndarray:
    return np.stack([batch.column(d).to_numpy(zero_copy_only=False) for d in dims], axis=1).astype(kind)


def pack(rows: DataFrame, id_col: str, dims: Sequence[str], label: str | None = None) -> DataFrame:
    """Blocks of at most ``REF_ROWS`` rows of one list, made where the rows are. ``worst``, if there, is the distance
    beyond which a query wants nothing; null takes everything."""
    fields, size, gather, n_dims = arrow(BLOCK), REF_ROWS, GATHER_ROWS, len(dims)
    worst = F.coalesce(F.col("worst").cast("double"), F.lit(float("inf"))) if "worst" in rows.columns else F.lit(float("inf"))
    src = rows.select("list_id", F.col(id_col).cast("long").alias("id"), (F.col(label) if label else F.lit(0)).cast("byte").alias("label"), worst.alias("worst"), *[F.col(d).cast("short").alias(f"d{k}") for k, d in enumerate(dims)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def give() -> pa.RecordBatch:
            lists, ids, labels, worst, data = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(lists, kind="stable")
            edge = np.flatnonzero(np.diff(lists[order], prepend=lists[order[0]] - 1))
            cuts = [range(a, b, size) for a, b in zip(edge, [*edge[1:], len(lists)])]
            parts = [order[a : min(a + size, x.stop)] for x in cuts for a in x]
            return _batch([[int(lists[p[0]]) for p in parts], [len(p) for p in parts], *[[x[p].tobytes() for p in parts] for x in (ids, labels, worst, data)]], fields)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("list_id", np.int32), ("id", np.int64), ("label", np.int8), ("worst", np.float64))]
            held.append((*own, matrix(batch, [f"d{k}" for k in range(n_dims)])))
            count += batch.num_rows
            if count >= gather:
                yield give()
                held, count = [], 0
        if held:
            yield give()

    return src.mapInArrow(run, BLOCK)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, lower places first, and where each run of equal rows begins in it. A
    hash that misleads could only cut a run in two."""
    odd = np.random.default_rng(7).integers(1, 1 << 62, data.shape[1]) * 2 + 1
    order = np.argsort((data.astype(np.int64) * odd).sum(1), kind="stable")
    new = np.ones(len(data), bool)
    new[1:] = (data[order[1:]] != data[order[:-1]]).any(1)
    return order, np.flatnonzero(new)


class Leaves:
    """References (in order of id) in leaves of a tree that halves its nodes in their widest dimension. Of equal
    references only the first k can be among the k nearest of a query; the others aren't kept."""

    def __init__(self, r: np.ndarray, k: int):
        self.k, self.n = k, len(r)
        order, starts = runs(r)
        rank = np.arange(len(r)) - np.repeat(starts, np.diff(starts, append=len(r)))
        kept = np.sort(order[rank < k])
        depth = max(0, int(np.log2(max(1, len(kept) / max(LEAF_ROWS, k)))))
        size = -(-len(kept) // (1 << depth))
        place = np.concatenate([kept, np.full((size << depth) - len(kept), len(r))])
        rows = np.concatenate([r, r[-1:]])
        self.splits = []
        for level in range(depth):
            x = rows[place].reshape(1 << level, -1, r.shape[1])
            dim = x.astype(np.float32).var(1).argmax(1)
            v = np.take_along_axis(x, dim[:, None, None], 2)[:, :, 0]
            half = v.shape[1] // 2
            part = np.argpartition(v, half, axis=1)
            self.splits.append((dim, np.take_along_axis(v, part[:, :half], 1).max(1)))
            place = np.take_along_axis(place.reshape(1 << level, -1), part, 1).reshape(-1)
        x = rows[place].reshape(1 << depth, size, r.shape[1])
        self.low, self.high = x.min(1).astype(np.float32), x.max(1).astype(np.float32)
        x = x.astype(np.float64)
        self.place = place.reshape(1 << depth, size)
        self.own = np.where(self.place < len(r), (x * x).sum(2), np.inf)  # padding is nowhere near
        self.back = np.ascontiguousarray(-2 * x.transpose(0, 2, 1))

    def home(self, q: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(q), np.int64), np.arange(len(q))
        for dim, cut in self.splits:
            node = node * 2 + (q[rows, dim[node]] > cut[node])
        return node

    def search(self, q: np.ndarray, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (query, place, distance), by query and then by (distance, place): the k nearest of each query, or those
        of them that are no farther than ``worst``. Equal queries are searched once."""
        order, starts = runs(q)
        counts = np.diff(starts, append=len(q))
        only = q[order[starts]]
        limit = np.full(len(only), np.inf) if worst is None else np.maximum.reduceat(worst[order], starts)
        keys = np.empty((len(only), self.k), np.int64)
        home = self.home(only)
        near = np.argsort(home, kind="stable")
        for a in range(0, len(near), QUERY_ROWS):
            part = near[a : a + QUERY_ROWS]
            keys[part] = self._some(only[part], home[part], limit[part])
        found = np.empty((len(q), self.k), np.int64)
        found[order] = np.repeat(keys, counts, axis=0)
        row, col = np.nonzero(found < FAR)
        dist, place = np.divmod(found[row, col], self.n)
        return row, place, dist

    def _some(self, q: np.ndarray, home: np.ndarray, limit: np.ndarray) -> np.ndarray:
        single, a = np.ascontiguousarray(q.T.astype(np.float32)), q.astype(np.float64)
        own, best = (a * a).sum(1), np.full((len(q), self.k), FAR)
        bound = np.zeros((len(self.low), len(q)), np.float32)
        for d, x in enumerate(single):
            gap = np.maximum(self.low[:, d, None] - x, x - self.high[:, d, None])
            np.maximum(gap, 0, out=gap)
            gap *= gap
            bound += gap
        bound *= np.float32(1 - 1e-5)  # single precision may have rounded it up
        at, left = np.arange(len(q)), np.ones(bound.shape, bool)

        def read(some: np.ndarray) -> None:
            nonlocal best
            rows, keys, count = [], [], 0

            def merge() -> None:
                nonlocal best
                row, key = np.concatenate([np.repeat(at, self.k), *rows]), np.concatenate([best.reshape(-1), *keys])
                order = np.lexsort((key, row))
                best = key[order][np.searchsorted(row[order], at)[:, None] + np.arange(self.k)]
                np.minimum(limit, np.where(best[:, -1] < FAR, best[:, -1] // self.n, np.inf), out=limit)

            for leaf in np.flatnonzero(some.any(1)):
                asked = np.flatnonzero(some[leaf])
                dist = a[asked] @ self.back[leaf]
                dist += self.own[leaf]
                most = (limit - own)[asked, None]
                row, col = np.divmod(np.flatnonzero((dist <= most) & (dist < np.inf)), dist.shape[1])
                key = (dist[row, col] + own[asked[row]]).astype(np.int64) * self.n + self.place[leaf, col]
                if len(row) > 4 * self.k * len(asked):
                    full = np.full(dist.shape, FAR)
                    full[row, col] = key
                    full = np.partition(full, self.k - 1, axis=1)[:, : self.k]
                    row, col = np.nonzero(full < FAR)
                    key = full[row, col]
                rows.append(asked[row])
                keys.append(key)
                count += len(row)
                if count > 1 << 20:
                    merge()
                    rows, keys, count = [], [], 0
            if rows:
                merge()
            left[some] = False

        if np.isinf(limit).any():  # those with a bound begin with the rest
            start = np.zeros(bound.shape, bool)
            start[home, at] = True
            read(start & (bound <= limit))
            if len(bound) > NEAR_LEAVES:
                near = np.zeros(bound.shape, bool)
                np.put_along_axis(near, np.argpartition(bound, NEAR_LEAVES - 1, axis=0)[:NEAR_LEAVES], True, axis=0)
                read(near & left & (bound <= limit))
        read(left & (bound <= limit))
        return best


def least(q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the places of its k nearest references by (distance, place), and their distances."""
    _, place, dist = Leaves(r, k).search(q)
    return place.reshape(len(q), -1), dist.reshape(len(q), -1)


def _meet(blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """``blocks`` of a partition come by key, and in each key references (kind 0) before queries."""
    fields = arrow(TOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, refs, asked, count, leaves, ids, labels = None, [], [], 0, None, None, None

        def read(row: dict) -> tuple:
            return tuple(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("labels", np.int8), ("worst", np.float64))) + (np.frombuffer(row["data"], np.int16).reshape(-1, dims),)

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal leaves, ids, labels
            if not asked or not (refs or leaves):
                return
            if leaves is None:
                ids, labels, _, data = (np.concatenate(x) for x in zip(*refs))
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], labels[order]
                leaves = Leaves(data[order], k)
                refs.clear()
            qid, _, worst, data = (np.concatenate(x) for x in zip(*asked))
            row, place, dist = leaves.search(data, worst)
            yield _batch([qid[row], ids[place], dist, labels[place], np.full(len(row), now[0], np.int32)], fields)

        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                key = (row["list_id"], row["salt"], row["chunk"])
                if key != now or count >= CHUNK_ROWS:  # near queries of many share the reading of a leaf
                    yield from answer()
                    asked, count = [], 0
                if key != now:
                    now, refs, leaves = key, [], None
                if row["kind"] == 0:
                    refs.append(read(row))
                else:
                    asked.append(read(row))
                    count += row["n"]
        yield from answer()

    return blocks.mapInArrow(run, TOP)


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k least of each query: the window keeps k rows a task before the exchange."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "orig_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_lists(probes: DataFrame, refs: DataFrame, sizes: DataFrame, dims: Sequence[str], k: int) -> DataFrame:
    """Nearest references of each query within its lists. ``probes`` (list_id, qid, dims..., and perhaps worst: nothing
    farther is wanted), ``refs`` (list_id, orig_id, label, dims...), ``sizes`` (list_id, n), at most 16384 rows.
    Rows: qid, orig_id, dist, label, list_id, rank."""
    return search_blocks(probes, pack(refs, "orig_id", dims, "label"), sizes, dims, k)


def search_blocks(probes: DataFrame, blocks: DataFrame, sizes: DataFrame, dims: Sequence[str], k: int) -> DataFrame:
    """``search_lists`` with references packed before. A long list is split over salts, to each of which its query blocks
    are copied, and a list of many queries over chunks, to each of which its reference blocks are copied: no task holds
    a list however many rows it has, and none answers all queries of one. ``probes`` is read twice."""
    spark = probes.sparkSession
    salts = F.ceil(F.col("n") / (REF_ROWS * SALT_BLOCKS)).cast("int")
    asked = probes.groupBy("list_id").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    split = F.broadcast(sizes.select("list_id", F.greatest(salts, F.lit(1)).alias("salts")).join(F.broadcast(asked), "list_id"))
    dealt = lambda c, n: F.pmod(F.xxhash64(F.col("ids"), F.lit(c)), F.col(n)).cast("int").alias(c)
    copies = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    own = ["list_id", "n", "ids", "labels", "worst", "data"]
    q = pack(probes, "qid", dims).join(split, "list_id").select(*own, F.lit(1).alias("kind"), copies("salt", "salts"), dealt("chunk", "chunks"))
    r = blocks.join(split, "list_id").select(*own, F.lit(0).alias("kind"), dealt("salt", "salts"), copies("chunk", "chunks"))
    key = ["list_id", "salt", "chunk"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return top(_meet(r.unionByName(q).repartition(parts, *key).sortWithinPartitions(*key, "kind"), len(dims), k), k)


class Cells:
    """Halves of the widest dimension, cut at values of a bounded sample, so that near rows share a cell. Cuts decide
    which task reads a row and nothing else: each row has a cell, and boxes are those of all rows."""

    def __init__(self, sample: np.ndarray, count: int):
        self.splits, node = [], np.zeros(len(sample), np.int64)
        for level in range(count.bit_length() - 1):
            dim, cut = np.zeros(1 << level, np.int64), np.full(1 << level, 32767)
            order = np.argsort(node, kind="stable")
            ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                x = sample[order[a:b]]
                if b - a > 1:
                    dim[k] = x.astype(np.float64).var(0).argmax()
                    values, many = np.unique(x[:, dim[k]], return_counts=True)
                    if len(values) > 1:
                        cut[k] = values[np.abs(np.cumsum(many)[:-1] * 2 - (b - a)).argmin()]
            self.splits.append((dim, cut))
            node = node * 2 + (sample[np.arange(len(sample)), dim[node]] > cut[node])

    def place(self, rows: DataFrame, dims: Sequence[str]) -> DataFrame:
        """rows with their cell as ``list_id``."""
        schema, splits = rows.select("*", F.lit(0).alias("list_id")).schema, self.splits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, node = matrix(batch, dims), np.zeros(batch.num_rows, np.int64)
                for dim, cut in splits:
                    node = node * 2 + (x[np.arange(len(x)), dim[node]] > cut[node])
                yield batch.append_column("list_id", pa.array(node.astype(np.int32)))

        return rows.mapInArrow(run, schema)


def within(queries: DataFrame, low: np.ndarray, high: np.ndarray, cells: np.ndarray, dims: Sequence[str]) -> DataFrame:
    """queries (qid, dims..., worst, list_id: its own cell) with a row for each other cell whose box is within ``worst``,
    equality included; a null ``worst`` takes every cell."""
    schema = queries.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, own = matrix(batch, dims, np.float64), batch.column("list_id").to_numpy(zero_copy_only=False)
            worst = batch.column("worst").to_pandas().astype("float64").fillna(np.inf).to_numpy()
            for a in range(0, len(q), 512):
                part = q[a : a + 512]
                bound = np.zeros((len(part), len(cells)))
                for d in range(q.shape[1]):
                    gap = np.maximum(np.maximum(low[None, :, d] - part[:, d : d + 1], part[:, d : d + 1] - high[None, :, d]), 0)
                    bound += gap * gap
                at, cell = np.nonzero((bound <= worst[a : a + 512, None]) & (cells[None, :] != own[a : a + 512, None]))
                rows = batch.take(pa.array(at + a))
                yield rows.set_column(rows.schema.get_field_index("list_id"), "list_id", pa.array(cells[cell].astype(np.int32)))

    return queries.mapInArrow(run, schema)


def flat(queries: DataFrame, refs: DataFrame, dims: Sequence[str], k: int = 5) -> DataFrame:
    """Exact search of a stated query set (qid, dims...) against all references (orig_id, label, dims...). References
    are dealt to cells of near rows, whose cuts are fitted on some 65,536 rows (at most twice as many), chosen by a hash
    of the id; any cuts give the same answers. A query reads its own cell, and then every other one whose box is within
    its k-th distance there, ties included: what is left out lies beyond it.
    Rows: qid, orig_id, dist, label, rank. Fewer than k references give fewer rows."""
    dims = list(dims)
    rows, asked = refs.select("orig_id", "label", *dims), queries.select("qid", *dims)
    total = rows.count()
    count = 1 << min(MOST_CELLS.bit_length() - 1, max(0, -(-total // CELL_ROWS) - 1).bit_length())
    some = rows.filter(F.pmod(F.xxhash64("orig_id"), F.lit(max(1, total // SAMPLE_ROWS))) == 0).select(*dims).limit(2 * SAMPLE_ROWS)
    cells = Cells(some.toPandas().to_numpy(np.int16).reshape(-1, len(dims)) if count > 1 else np.zeros((0, len(dims)), np.int16), count)
    placed = cells.place(rows, dims)
    blocks = ivf.cut(pack(placed, "orig_id", dims, "label"), "blocks")
    sides = [f(d).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k, d in enumerate(dims)]
    found = placed.groupBy("list_id").agg(F.count("*").alias("n"), *sides).orderBy("list_id").collect()  # at most 16384
    sizes = refs.sparkSession.createDataFrame([(r["list_id"], r["n"]) for r in found], "list_id int, n bigint")
    own = ivf.cut(cells.place(asked, dims), "own")
    first = search_blocks(own, blocks, sizes, dims, k)
    if count == 1:
        return first.drop("list_id")
    first = ivf.cut(first, "near")
    bound = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("dist")).cast("double").alias("worst"))
    box = np.array([[float(x) for x in r[2:]] for r in found]).reshape(len(found), 2, len(dims))
    more = own.join(bound, "qid", "left").select("qid", *dims, "worst", "list_id")
    more = ivf.cut(within(more, box[:, 0], box[:, 1], np.array([r["list_id"] for r in found]), dims), "others")
    rest = search_blocks(more, blocks, sizes, dims, k)
    return top(first.drop("rank").unionByName(rest.drop("rank")), k).drop("list_id")


def vote(neighbours: DataFrame, queries: DataFrame | None = None, k: int = 5) -> DataFrame:
    """qid, votes, d5, approved, fraud_score. With fewer than k neighbours there is no vote: 0, approved."""
    got = neighbours.groupBy("qid").agg(F.sum(F.when(F.col("label") != 0, 1).otherwise(0)).alias("s"), F.max("dist").alias("d"), F.count("*").alias("n"))
    if queries is not None:
        got = queries.select("qid").join(got, "qid", "left")
    full = F.coalesce(F.col("n"), F.lit(0)) >= k
    votes = F.when(full, F.col("s")).otherwise(0).cast("int")
    return got.select("qid", votes.alias("votes"), F.when(full, F.col("d")).alias("d5"), (votes < 3).alias("approved"), (votes / F.lit(5.0)).alias("fraud_score"))

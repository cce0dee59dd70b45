"""The inverted-file index: balanced and k-means lists, centroids, boxes, histogram, save and load.

Training works on fixed-point values, whose sums are exact in any order, so a rebuild gives the same lists. Driver
loops only steer; each level or round is a distributed pass that ends in a table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import features as X

ID_BLOCK = 1 << 16
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def scratch(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``. A local one is made only where that is unset and the driver
    runs all tasks itself."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='nearvote-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Ends the lineage in a table of the shared folder."""
    return _stored(df, name)[0]


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with compiled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a stage whose generated method has more than 8,000 bytes runs as Spark's separate operators, whose code
    comes in small methods: HotSpot never compiles a larger one, and interprets it row by row. Results are the same."""
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, "8000")
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def depth_of(nlist: int) -> int:
    if nlist < 1 or nlist > S.MOST_LISTS or nlist & (nlist - 1):
        raise ValueError("the number of lists must be a power of two from 1 to 16384")
    return nlist.bit_length() - 1


def widest(rows: DataFrame, by: str, dims: list[str]) -> DataFrame:
    """Per group the dimension of the largest population variance, the lowest on ties; exact in integers. Sums of 16-bit
    values and of their squares fit a long up to 8 billion rows; only their products need decimals."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.col(d).cast("long")).alias(f"s_{d}") for d in dims], *[F.sum(F.col(d).cast("long") * F.col(d)).alias(f"r_{d}") for d in dims])
    return _widest(sums, by, dims)


def _widest(sums: DataFrame, by: str, dims: list[str]) -> DataFrame:
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    spread = [(whole("n") * whole(f"r_{d}") - whole(f"s_{d}") * whole(f"s_{d}")).cast("decimal(38,0)").alias(f"w_{d}") for d in dims]
    wide = sums.select(by, "n", *spread)
    best = F.greatest(*[F.col(f"w_{d}") for d in dims])
    pick = F.coalesce(*[F.when(F.col(f"w_{d}") == best, F.lit(k)) for k, d in enumerate(dims)])
    return wide.select(by, "n", pick.alias("dim"))


class Tree:
    """Cuts of the balanced tree, level by level and node by node: a row goes to child 2n where (value in the node's
    dimension, orig_id) is at most the cut, else to 2n + 1. At most 16384 nodes a level, so it travels with a plan."""

    def __init__(self, dims: list[str]):
        self.dims, self.cuts = list(dims), []

    def place(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(q), np.int64), np.arange(len(q))
        for dim, value, last in self.cuts:
            x = q[rows, dim[node]].astype(np.int32)
            node = node * 2 + ((x > value[node]) | ((x == value[node]) & (ids > last[node])))
        return node

    def lists(self, refs: DataFrame) -> DataFrame:
        """refs with ``list_id``, placed where they are."""
        import pyarrow as pa

        dims, place = self.dims, self.place
        schema = refs.select(F.lit(0).alias("list_id"), "*").schema

        def run(batches):
            for batch in batches:
                q = np.stack([batch.column(d).to_numpy(zero_copy_only=False) for d in dims], axis=1)
                node = place(q, batch.column("orig_id").to_numpy(zero_copy_only=False)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), *batch.columns], names=["list_id", *batch.schema.names])

        return refs.mapInArrow(run, schema)

    def grow(self, blocks: DataFrame) -> None:
        """One more level: the lower half of each node by (widest dimension, orig_id) becomes child 2n, the rest 2n + 1;
        a node of one row goes left-most.

        No node is sorted and no row moves: a pass over the blocks sums each node's variances, one counts the values of
        its widest dimension, one counts blocks of ids inside the median value, and only the ids of the block on the cut
        are ranked. What a pass gives is added up in its tasks; what reaches the driver is a row a node."""
        dims, nodes, spark = self.dims, 1 << len(self.cuts), blocks.sparkSession
        names = ["n", *[f"s_{d}" for d in dims], *[f"r_{d}" for d in dims]]

        def sums(parts):
            total = np.zeros((nodes, 1 + 2 * len(dims)), np.int64)
            for node, _, q in parts:
                order = np.argsort(node, kind="stable")
                starts = np.flatnonzero(np.diff(node[order], prepend=-1))
                q = q[order].astype(np.int64)
                total[node[order[starts]]] += np.add.reduceat(np.concatenate([np.ones((len(q), 1), np.int64), q, q * q], axis=1), starts)
            at = np.flatnonzero(total[:, 0])
            yield [at, *total[at].T]

        partial = self._pass(blocks, sums, ["node", *names])
        chosen = _widest(partial.groupBy("node").agg(*[F.sum(c).alias(c) for c in names]), "node", dims).collect()
        dim, want = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for r in chosen:
            dim[r["node"]], want[r["node"]] = r["dim"], r["n"] // 2
        value, last = np.full(nodes, 1 << 16, np.int32), np.full(nodes, np.iinfo(np.int64).max)  # all rows go left
        many = want > 0

        def values(parts):
            def some():
                for node, _, q in parts:
                    here = many[node]
                    yield node[here] << 16 | (q[here, dim[node[here]]].astype(np.int64) + 32768)

            for key, count in _counted(some()):
                yield [key >> 16, (key & 65535) - 32768, count]

        for r in self._at(self._pass(blocks, values, ["node", "x", "c"]), "x", want):
            value[r["node"]] = r["x"]
            want[r["node"]] = r["want"] if r["want"] < r["c"] else 0  # 0: all rows of the value go left
        many = want > 0
        if many.any():

            def tied(node, q):
                return many[node] & (q[np.arange(len(q)), dim[node]] == value[node])

            def ties(parts):
                for node, ids, q in parts:
                    here = tied(node, q)
                    pair, count = np.unique(np.stack([node[here], ids[here] // ID_BLOCK], axis=1), axis=0, return_counts=True)
                    yield [pair[:, 0], pair[:, 1], count]

            edge = np.zeros(nodes, np.int64)
            for r in self._at(self._pass(blocks, ties, ["node", "block", "c"]), "block", want):
                edge[r["node"]], want[r["node"]] = r["block"], r["want"]

            def inside(parts):
                for node, ids, q in parts:
                    here = tied(node, q) & (ids // ID_BLOCK == edge[node])
                    yield [node[here], ids[here], np.ones(here.sum(), np.int64)]

            for r in self._at(self._pass(blocks, inside, ["node", "orig_id", "c"]), "orig_id", want):
                last[r["node"]] = r["orig_id"]
        self.cuts.append((dim, value, last))

    def _pass(self, blocks: DataFrame, run, names: list[str]) -> DataFrame:
        """Columns of longs that ``run`` gives for the (nodes, ids, values) of each task's blocks."""
        import pyarrow as pa

        place, width = self.place, len(self.dims)

        def read(batches):
            for batch in batches:
                for ids, data in zip(batch.column("ids"), batch.column("data")):
                    ids, q = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.int16).reshape(-1, width)
                    yield place(q, ids), ids, q

        def give(batches):
            for cols in run(read(batches)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        return blocks.mapInArrow(give, ", ".join(f"{c} bigint" for c in names))

    @staticmethod
    def _at(counts: DataFrame, by: str, want: np.ndarray) -> list:
        """Per node the value of ``by`` at which its rows, counted in order, reach ``want``; the rank inside it, and its
        rows."""
        import pyarrow as pa

        some = np.flatnonzero(want)
        wanted = F.broadcast(counts.sparkSession.createDataFrame(pa.table({"node": some, "want": want[some]})))
        summed = counts.groupBy("node", by).agg(F.sum("c").alias("c")).withColumn("end", F.sum("c").over(Window.partitionBy("node").orderBy(by)))
        inside = (F.col("end") >= F.col("want")) & (F.col("end") - F.col("c") < F.col("want"))
        return summed.join(wanted, "node").filter(inside).select("node", by, (F.col("want") - F.col("end") + F.col("c")).alias("want"), "c").collect()


def _counted(keys, most: int = 1 << 20):
    """(keys, counts) of arrays of keys, added up until they are many."""
    held, count = [], 0

    def give():
        every, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

    for key in keys:
        held.append(np.unique(key, return_counts=True))
        count += len(held[-1][0])
        if count > most:
            held = [give()]
            count = len(held[0][0])
            if count > most // 2:
                yield held[0]
                held, count = [], 0
    if held:
        yield give()


def balanced_lists(refs: DataFrame, nlist: int, dims: list[str] = S.Q) -> DataFrame:
    """refs with ``list_id`` from the balanced tree. Its levels read ids and split values, packed once; then each row is
    placed where it is."""
    from . import knn

    tree, depth = Tree(dims), depth_of(nlist)
    if depth:
        blocks, path = _stored(knn.pack(refs.withColumn("list_id", F.lit(0)), "orig_id", dims), "tree")
        for _ in range(depth):
            tree.grow(blocks)
        _drop(refs.sparkSession, path)
    return cut(tree.lists(refs), "lists")


def centroids(lists: DataFrame, nlist: int, dims: list[str] = S.V) -> DataFrame:
    """Mean vector of each list in single precision, all lists; an empty one has zeros and can be probed."""
    got = lists.groupBy("list_id").agg(F.count("*").alias("n"), *[F.sum(F.col(d).cast("double")).alias(d) for d in dims])
    every = lists.sparkSession.range(nlist).select(F.col("id").cast("int").alias("list_id"))
    mean = [F.coalesce((F.col(d) * (F.lit(1.0) / F.col("n"))).cast("float"), X.f32(0.0)).alias(f"c{k}") for k, d in enumerate(dims)]
    return every.join(got, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("n"), *mean)


def boxes(lists: DataFrame, cents: DataFrame, dims: list[str] = S.Q) -> DataFrame:
    """Least and largest fixed-point value a list and dimension; an empty list has its centroid's."""
    got = lists.groupBy("list_id").agg(*[F.min(d).alias(f"mn{k}") for k, d in enumerate(dims)], *[F.max(d).alias(f"mx{k}") for k, d in enumerate(dims)])
    fill = [F.coalesce(f"{side}{k}", X.quantize(F.col(f"c{k}"))).alias(f"{side}{k}") for side in ("mn", "mx") for k in range(len(dims))]
    return cents.select("list_id", "n", *[f"c{k}" for k in range(len(dims))]).join(got, "list_id", "left").select("list_id", "n", *fill)


def histogram(cents: DataFrame) -> DataFrame:
    """Vectors, lists, empty lists, and list sizes at floor(p * (n - 1)) of their order. At most 16384 rows are in it."""
    sizes = F.array_sort(F.collect_list("n"))
    at = lambda p: F.element_at("s", F.floor(F.lit(p) * (F.col("lists") - 1)).cast("int") + 1)
    a = cents.agg(F.sum("n").alias("vectors"), F.count("*").alias("lists"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("non_empty"), sizes.alias("s"))
    return a.select("vectors", "lists", "non_empty", (F.col("lists") - F.col("non_empty")).alias("empty"), at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.element_at("s", -1).alias("max"))


def offsets(cents: DataFrame) -> DataFrame:
    """First row of each list, were all rows laid out by list."""
    before = F.sum("n").over(Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1))
    return cents.select("list_id", F.coalesce(before, F.lit(0)).cast("long").alias("begin"), F.col("n").cast("long").alias("n"))


def stride_sample(rows: DataFrame, size: int, id_col: str = "orig_id") -> DataFrame:
    """Rows at floor(i * total / size) of 0 to total - 1; ids must run without gaps."""
    total = rows.count()
    size = min(total, max(size, 1))
    ids = rows.sparkSession.range(size).select(F.expr(f"id * {total} div {max(size, 1)}").alias(id_col))
    return rows.join(ids, id_col)


def nearest_list(rows: DataFrame, cents: np.ndarray, dims: list[str] = S.V) -> DataFrame:
    """rows with the nearest centroid's list_id, the lowest on ties. ``cents``: at most 16384 rows."""
    import pyarrow as pa

    schema = rows.select("*", F.lit(0).alias("list_id")).schema
    bound = np.asarray(cents, np.float32)

    def run(batches):
        for batch in batches:
            v = np.stack([batch.column(d).to_numpy(zero_copy_only=False) for d in dims], axis=1).astype(np.float32)
            out = np.zeros(len(v), np.int32)
            for a in range(0, len(v), 1024):
                out[a : a + 1024] = centroid_distances(v[a : a + 1024], bound).argmin(axis=1)
            yield batch.append_column("list_id", pa.array(out, pa.int32()))

    return rows.mapInArrow(run, schema)


def centroid_distances(v: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Squared distances in single precision, summed dimension by dimension."""
    out = np.zeros((len(v), len(cents)), np.float32)
    for d in range(cents.shape[1]):
        gap = v[:, d : d + 1] - cents[None, :, d]
        out += gap * gap
    return out


def as_matrix(cents: DataFrame, dims: int) -> np.ndarray:
    """The centroid table on the driver: bounded by the largest number of lists."""
    rows = cents.orderBy("list_id").select(*[f"c{k}" for k in range(dims)]).collect()
    return np.array([list(r) for r in rows], np.float32).reshape(-1, dims)


def kmeans(refs: DataFrame, nlist: int, sample: int, iterations: int, dims: list[str] = S.V, start: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """Lloyd's rounds from balanced centroids on a stride sample, then all rows to their nearest centroid. An empty
    cluster keeps its centroid. Returns refs with list_id, and (moved rows, inertia) of each round."""
    some = cut(stride_sample(refs, sample), "sample")
    start = centroids(balanced_lists(some, nlist), nlist, dims) if start is None else start
    now, log = as_matrix(start, len(dims)), []
    for _ in range(iterations):
        got = nearest_list(some, now, dims)
        sums = got.groupBy("list_id").agg(F.count("*").alias("n"), *[F.sum(F.col(d).cast("double")).alias(d) for d in dims], *[F.sum(F.col(d).cast("double") * F.col(d)).alias(f"r_{d}") for d in dims]).collect()
        new = now.copy()
        inertia = 0.0
        for r in sums:  # at most nlist rows
            s = np.array([r[d] for d in dims])
            c = now[r.list_id].astype(np.float64)
            inertia += sum(r[f"r_{d}"] for d in dims) - 2 * float(s @ c) + r.n * float(c @ c)
            new[r.list_id] = (s * (1.0 / r.n)).astype(np.float32)
        log.append({"moved_dims": int((new != now).sum()), "inertia": inertia})
        now = new
    return nearest_list(refs, now, dims), log


@dataclass
class Index:
    refs: DataFrame  # list_id, orig_id, label, v..., q...
    centroids: DataFrame
    boxes: DataFrame
    nlist: int
    dims: int = S.DIMS
    blocks: DataFrame | None = None  # refs as the search reads them

    def save(self, path: str) -> None:
        """Four tables; refs laid out by list and id, so scans of a list prune by its row-group bounds."""
        refs = self.refs.repartitionByRange("list_id", "orig_id").sortWithinPartitions("list_id", "orig_id")
        refs.write.mode("overwrite").parquet(f"{path}/refs")
        self.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        self.boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")
        meta = [("IVFT", 1, self.dims, self.nlist, self.refs.count(), S.K, S.SCALE)]
        self.refs.sparkSession.createDataFrame(meta, "magic string, version int, dims int, nlist int, total bigint, k int, scale int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    """Opens a saved index; raises ValueError where it is missing or does not agree with itself."""
    try:
        meta = spark.read.parquet(f"{path}/meta").first()
        refs, cents, bounds = (spark.read.parquet(f"{path}/{t}") for t in ("refs", "centroids", "boxes"))
    except Exception as e:
        raise ValueError(f"no index at {path}") from e
    wrong = []
    if meta is None or meta["magic"] != "IVFT" or meta["version"] != 1:
        raise ValueError("not an index")
    if meta["dims"] != S.DIMS or meta["k"] != S.K or meta["scale"] != S.SCALE:
        wrong.append("dims, k or scale")
    if not 0 < meta["nlist"] <= S.MOST_LISTS or cents.count() != meta["nlist"] or bounds.count() != meta["nlist"]:
        wrong.append("lists")
    if not set(["list_id", "orig_id", "label", *S.Q]) <= set(refs.columns):
        wrong.append("schema")
    elif refs.count() != meta["total"] or not meta["total"] or (cents.agg(F.sum("n")).first()[0] or 0) != meta["total"]:
        wrong.append("rows")
    if wrong:
        raise ValueError("index disagrees in " + ", ".join(wrong))
    return Index(refs, cents, bounds, meta["nlist"], meta["dims"])


def build(refs: DataFrame, nlist: int, method: str = "balanced", sample: int = 65536, iterations: int = 8) -> Index:
    """``refs``: orig_id, label, v0.., q0.."""
    refs = refs.select("orig_id", "label", *S.V, *S.Q)
    if method == "balanced":
        lists = balanced_lists(refs, nlist)
    elif method == "kmeans":
        depth_of(nlist)
        lists = cut(kmeans(cut(refs, "refs"), nlist, sample, iterations)[0], "lists")
    else:
        raise ValueError(f"unknown method {method}")
    cents = cut(centroids(lists, nlist), "centroids")
    return Index(lists, cents, cut(boxes(lists, cents), "boxes"), nlist)


def warm(index: Index) -> int:
    return index.refs.cache().count()


def close(index: Index) -> None:
    index.refs.unpersist()

"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, connected components.

1. Every text becomes its set of word shingles, a SuperMinHash signature and band names. Equal sets are one class;
   only classes go on. A class goes by its least document, or, where that document stands on rows of several classes,
   all but one of these by a number above every doc_id, linked with the document.
2. Classes that share a band are in one bucket. Each bucket has a leader: the member that shares most with
   others over all its bands. Members are compared with their leaders on full sets; links make components.
3. Buckets that still hold several components are compared in full, in blocks of bounded size; blocks inside one
   component need no comparison. Buckets with common members make a family, which is compared once. In a family of
   more than MOST_FAMILY rows each bucket is compared for itself, in blocks that follow the distance to its leader:
   1 - Jaccard is a metric, so blocks whose distances differ by more than 1 - threshold hold no link and never meet.
4. All links make the final components.

The work in 2 is linear in a bucket's size. 3 compares only what 2 left apart, and is quadratic in that: a block of
some hundred sets, not a pair of sets, is its unit of exchange. No step lists a group's pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import WordNames, bands, shingle_set, signatures

SKETCH = "doc_id bigint, n_shingles bigint, name binary, bands array<bigint>"
LINKS = "a bigint, b bigint, same bigint, n_a bigint, n_b bigint"
BLOCK = 256
BINS = 50  # of the distance to the leader
MOST_BROADCAST = 100_000  # names of large families
MOST_FAMILY = 1 << 16  # rows (member, bucket) of a family that is compared as one


def sketch(docs: DataFrame, words: int, n_bands: int, rows: int, group: int = 16) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit name (null if empty) and its band names."""

    def make():
        names = WordNames()

        def step(batch):
            sets = [shingle_set(names.of(t.encode().lower().split()), words) for t in common.texts_of(batch)]
            band = [bands(signatures(sets[k : k + group], n_bands * rows), n_bands, rows) for k in range(0, len(sets), group)]
            flat = np.concatenate(band) if band else np.zeros((0, n_bands), np.int64)
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": [len(s) for s in sets],
                "name": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * n_bands, pa.int32()), pa.array(flat.reshape(-1), pa.int64())),
            }

        return step

    return common.map_batches(docs, make, SKETCH)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """The name of each row's set, and the whole set, as sorted unsigned 64-bit names."""

    def make():
        names = WordNames()

        def step(batch):
            sets = [shingle_set(names.of(t.encode().lower().split()), words).tobytes() for t in common.texts_of(batch)]
            return {"name": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "set": sets}

        return step

    return common.map_batches(docs, make, "name binary, set binary")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def compare(pairs: DataFrame) -> DataFrame:
    """(a, b, set_a, set_b) to (a, b, same, n_a, n_b)."""

    def make():
        def step(batch):
            out: dict[str, list] = {"same": [], "n_a": [], "n_b": []}
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                for name, v in zip(out, (_shared(x, y), len(x), len(y))):
                    out[name].append(v)
            return {"a": batch.column("a"), "b": batch.column("b"), **out}

        return step

    return common.map_batches(pairs, make, LINKS)


def links_in(ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int, step: int = 4096) -> list[tuple[int, int]]:
    """Links between members of different components, as few as connect what is linked. Intersection sizes are
    products of incidence rows, a bounded number of shingles at a time."""
    n = len(ids)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(inverse) > 1  # a shingle of one member is in no intersection
    renumber = np.cumsum(often) - 1
    owner, inverse = owner[often[inverse]], renumber[inverse[often[inverse]]]
    same = np.zeros((n, n), np.float32)
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for at in range(0, int(often.sum()), step):
        a, b = np.searchsorted(inverse, [at, at + step])
        grid = np.zeros((n, step), np.float32)
        grid[owner[a:b], inverse[a:b] - at] = 1
        same += grid @ grid.T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[:, None] + size[None, :] - same
    hit = (100 * same.astype(np.float64) >= percent * union) & (union > 0)
    comp = np.array(comps)
    hit &= comp[:, None] != comp[None, :]
    top = {c: c for c in comps}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1))):
        x, y = find(comps[i]), find(comps[j])
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    return out


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (pair, doc, comp, set) to links (a, b) inside each pair of blocks. Rows are dealt by pair and sorted, so
    a task holds one pair of blocks at a time."""
    spark = rows.sparkSession
    ordered = rows.repartition(common.shuffle_parts(spark), "pair").sortWithinPartitions("pair", "doc")
    schema = common.arrow_schema("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def give() -> pa.RecordBatch:
            found = links_in(list(held), [c for c, _ in held.values()], [s for _, s in held.values()], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for pair, doc, comp, raw in zip(*(batch.column(c).to_pylist() for c in ("pair", "doc", "comp", "set"))):
                if pair != now:
                    if held:
                        yield give()
                    now, held = pair, {}
                held[doc] = (comp, np.frombuffer(raw, np.uint64))
        if held:
            yield give()

    return ordered.mapInArrow(run, "a bigint, b bigint")


def _linked(percent: int):
    return F.expr(f"100 * same >= {percent} * (n_a + n_b - same)")


def group(docs: DataFrame, words: int = 5, percent: int = 80, n_bands: int = 24, rows: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id (least doc_id it is linked with, through any number
    of links), kept (doc_id = component_id).

    Words are lower-case (A-Z) runs without ASCII white space; a text with fewer than ``words`` words has one
    shingle. Null, empty and wordless texts have the empty set and are linked with nothing. Rows that repeat a
    doc_id each give a row, and share one component; where their texts differ, each text is linked for itself and
    the document with all of them. A row with a null doc_id links with nothing: its component is null and it is
    kept. An empty table gives no rows; further columns are not read.

    A pair at the threshold shares a band with probability 1 - (1 - (percent/100)**rows)**n_bands, 0.999997 by
    default; everything after that is exact.
    """
    spark = docs.sparkSession
    docs = common.pick(docs, "doc_id", "text")
    made: dict[str, str] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, made[name] = common.stage_table(df, name)
        return out

    marks = keep(sketch(docs, words, n_bands, rows), "near-sketch")
    some = marks.filter("name is not null and doc_id is not null")
    classes = keep(some.groupBy("name").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "near-classes")
    shared_ids = classes.groupBy("rep").agg(F.count("*").alias("n"), F.min("name").alias("first")).filter("n > 1").select("rep", "first")
    top = F.lit((marks.agg(F.max("doc_id")).first()[0] or 0) + 1)
    reps = classes.join(shared_ids, "rep", "left").withColumn("cls", F.when(F.col("first").isNull() | (F.col("first") == F.col("name")), F.col("rep")).otherwise(top + F.monotonically_increasing_id())).drop("first")
    reps = keep(reps, "near-reps")
    buckets = reps.select(F.col("cls").alias("doc"), F.explode("bands").alias("band"))
    counted = buckets.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = keep(buckets.join(counted, "band").distinct(), "near-buckets")
    weight = shared.groupBy("doc").agg(F.sum("size").alias("weight"))
    leaders = shared.join(weight, "doc").groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc")).alias("d"))).alias("top")).select("band", (-F.col("top.d")).alias("leader"))
    led = keep(shared.join(leaders, "band"), "near-led")
    wanted = led.select(F.col("doc").alias("cls")).distinct().join(reps.select("cls", "name", F.col("rep").alias("doc_id")), "cls")
    wanted = keep(wanted, "near-wanted")
    sets = full_sets(docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), words).groupBy("name").agg(F.max("set").alias("set"))
    sets = keep(sets.join(wanted.select("name", F.col("cls").alias("doc_id")), "name").select("doc_id", "set"), "near-sets")
    pairs = led.filter("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    compared = keep(compare(with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")), "near-compared")
    first = compared.filter(_linked(percent)).select("a", "b")
    roots = keep(components(first, "a", "b"), "near-roots")
    rest = _rest(led, compared, roots, sets, percent, keep)
    links = keep(first.unionByName(rest), "near-links")
    for name, path in made.items():
        if name not in ("near-sketch", "near-reps", "near-links"):  # the rows below are read from these
            common.drop_path(spark, path)
    copies = marks.select("doc_id", "n_shingles", "name").join(reps.select("name", "rep", "cls"), "name", "left")
    roots = components(links.unionByName(_several(copies)), "a", "b")
    one = copies.groupBy("doc_id").agg(F.min("rep").alias("node")).filter("doc_id is not null and node is not null")
    root_of = one.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    out = marks.select("doc_id", "n_shingles").join(root_of, "doc_id", "left").withColumn("component_id", F.coalesce("root", "doc_id")).drop("root")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _several(copies: DataFrame) -> DataFrame:
    """Links between what a document's rows stand for: its own classes, and a class's number and least document."""
    span = copies.filter("rep is not null").groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("doc_id", "low")
    one = copies.filter("cls is not null").join(span, "doc_id").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    return one.unionByName(copies.filter("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b")))


def _rest(led: DataFrame, compared: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, keep) -> DataFrame:
    """Links that comparison with leaders could not see."""
    rows = led.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
    mixed = rows.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("doc").alias("least"), F.count("*").alias("n"), *[F.sum(F.xxhash64("doc", F.lit(k)) % (1 << 40)).alias(f"m{k}") for k in (0, 1)])
    once = mixed.filter("low <> high").groupBy("m0", "m1", "n").agg(F.min_by(F.struct("band", "least"), "band").alias("x")).select("x.*")  # buckets with the same members count once
    rows = keep(rows.join(once, "band"), "near-mixed")
    families = components(rows, "least", "doc").withColumnsRenamed({"node": "doc", "root": "family"})
    rows = rows.join(families, "doc", "left").withColumn("family", F.coalesce("family", "doc"))
    large = keep(rows.groupBy("family").count().filter(F.col("count") > MOST_FAMILY).select("family"), "near-large")
    many = large.count()
    zones = rows
    if many:
        some = F.broadcast(large) if many <= MOST_BROADCAST else large
        zones = rows.join(some, "family", "left_anti")
    zones = zones.select(F.xxhash64("family").alias("zone"), F.lit(0).alias("bin"), "doc", "comp").distinct()
    if many:
        distance = compared.select(F.col("a").alias("leader"), F.col("b").alias("doc"), (1 - F.col("same") / (F.col("n_a") + F.col("n_b") - F.col("same"))).alias("far"))
        wide = rows.join(some, "family", "left_semi").join(distance, ["leader", "doc"], "left")
        zones = zones.unionByName(wide.select(F.col("band").alias("zone"), F.floor(F.coalesce("far", F.lit(0.0)) * BINS).cast("int").alias("bin"), "doc", "comp"))
    return compare_blocks(_in_blocks(keep(zones, "near-zones"), percent).join(sets.withColumnRenamed("doc_id", "doc"), "doc"), percent)


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(zone, bin, doc, comp) to (pair, doc, comp): the members of each two blocks of a zone that may hold a link.
    A component with many members in a zone has blocks of its own, which need not meet each other."""
    sizes = rows.groupBy("zone", "bin", "comp").agg(F.count("*").alias("n")).withColumn("slot", F.when(F.col("n") >= BLOCK // 2, F.col("comp")))
    parts = sizes.groupBy("zone", "bin", "slot").agg(F.ceil(F.sum("n") / (BLOCK * 3 // 4)).cast("int").alias("parts"))
    slots = sizes.alias("s").join(parts.alias("p"), F.expr("s.zone = p.zone and s.bin = p.bin and s.slot <=> p.slot")).select("s.zone", "s.bin", "s.comp", "s.slot", "p.parts")
    rows = rows.join(slots, ["zone", "bin", "comp"]).withColumn("block", F.xxhash64("bin", F.coalesce("slot", F.lit(-1)), F.pmod(F.xxhash64("doc"), F.col("parts"))))
    blocks = rows.groupBy("zone", "bin", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    x, y = (blocks.select("zone", *[F.col(c).alias(f"{side}_{c}") for c in ("bin", "block", "low", "high")]) for side in "xy")
    reach = BINS * (100 - percent) // 100 + 1
    met = x.join(y, "zone").filter(f"x_block <= y_block and abs(y_bin - x_bin) <= {reach} and not (x_low = x_high and y_low = y_high and x_low = y_low)")
    met = met.withColumn("pair", F.xxhash64("zone", "x_block", "y_block"))
    side = met.select("zone", F.explode(F.array_distinct(F.array("x_block", "y_block"))).alias("block"), "pair")
    return rows.select("zone", "block", "doc", "comp").join(side, ["zone", "block"]).select("pair", "doc", "comp")


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its group, all columns kept; one row of each document, that
    whose text sorts first (null text last), of rows with a doc_id. Rows with a null doc_id stay."""
    spark = docs.sparkSession
    kept = group(docs, **settings).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    kept, _ = common.stage_table(kept, "near-kept")
    mark = "_times"
    while mark in docs.columns:
        mark += "_"
    rows = docs.join(kept.select(F.col("doc_id"), F.col("times").alias(mark)), "doc_id").select(*[docs[c] for c in docs.columns], mark)
    again = rows.filter(F.col(mark) > 1).drop(mark)
    order = [F.col("text").asc_nulls_last(), *[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and f.dataType.typeName() != "map"]]
    if kept.filter("times > 1").isEmpty():
        return rows.drop(mark).unionByName(docs.filter("doc_id is null"))
    first = again.withColumn(mark, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col(mark) == 1).drop(mark)
    return rows.filter(F.col(mark) == 1).drop(mark).unionByName(first).unionByName(docs.filter("doc_id is null"))

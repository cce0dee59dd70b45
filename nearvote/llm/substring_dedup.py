"""Exact substring deduplication by a distributed difference-cover algorithm, cut off at the match length.

To tell which ``length``-byte strings also start in an earlier document, suffixes need to be sorted by their first
``length`` bytes only. The steps are those of a difference-cover suffix sort:

1. Sample. Positions whose offset mod 31 lies in a perfect difference set are sampled: six of 31. Of any two
   suffixes, some shift below 31 takes both to sampled positions. So if two documents share ``length`` bytes, both
   have a sampled position in them, at the same place, with ``length`` - 30 bytes to its right: the sampled tuple.
2. Sort the sampled tuples, dealt by range; equal neighbours get one name. A name that stands in one document only
   rules out every suffix that reaches it through its shifts.
3. Merge what remains: suffixes with a shared name within their shifts are sorted by their whole first ``length``
   bytes, again dealt by range. As the tuple and the shifts add up to ``length``, one recursion is enough.
4. Compare adjacent prefixes: in each run of equal prefixes the least document keeps its bytes, and all others
   lose the bytes that the prefix covers.

Tuples and prefixes are sorted as 64-bit polynomial names. Among n suffixes that step 3 sorts, n**2 / 2**65 pairs are
expected to share a name by chance: below 0.002 for 2**28 suffixes (a gigabyte of text of which a quarter repeats).

Texts are read from chunk rows of a few megabytes. A chunk sends, for each range, one sorted, difference-coded array
of its distinct names, and gets back one bit a name; every step writes a table in the shared folder. Before step 3
documents with suffixes left are regrouped by the least shared name in them: copies come into the same chunks, which
send a prefix once for all of them. Regrouping is by range of (name, hash of id), so a large group spreads over tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31  # fixed: a perfect difference set
CHUNKS = "chunk bigint, ids binary, lens binary, data binary"
MARKED = CHUNKS + ", marks binary"
SPLIT = "name bigint, doc bigint, n_bytes bigint, kept_sha256 string, data binary, marks binary"
SENT = "part int, chunk bigint, n int, names binary, docs binary"
BITS = "chunk bigint, part int, bits binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
NO_ID = np.iinfo(np.int64).max  # a null doc_id counts as the largest
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte plane by byte plane."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    planes = gaps.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueeze(data: bytes, n: int, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).reshape(-1), dtype=kind)


def mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_names(data: np.ndarray, width: int) -> np.ndarray:
    """Names of the ``width`` bytes from each position on: a polynomial mod 2**64 built by doubling. The last
    ``width`` - 1 have no meaning."""
    power, size = _TABLE[data], 1
    out, done = None, 0
    mult = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    while True:
        if width & size:
            if out is None:
                out = power.copy()
            else:  # the bytes from ``done`` on come behind those already named
                out *= mult(size)
                out[: len(out) - done] += power[done:] if done else power
            done += size
        if done == width:
            return mix(out)
        wide = power * mult(size)
        wide[: len(wide) - size] += power[size:]
        power, size = wide, size * 2


class Chunk:
    """Some whole documents: ids, lengths, their bytes joined, and each byte's place."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, data: bytes):
        self.ids, self.lens = ids, lens
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lens, dtype=np.int64)
        self.starts = self.ends - lens
        self.doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64), zstandard.decompress(row["data"]))

    def roomy(self, width: int) -> np.ndarray:
        """Whether ``width`` bytes are left from each position to its document's end."""
        out = np.ones(len(self.data), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            out[max(a, b - width + 1) : b] = False
        return out

    def sample(self, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their tuples' names, cut to ``bits`` bits."""
        if len(self.data) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pattern = np.resize(_IN_COVER, int(self.lens.max()))
        at = np.flatnonzero(np.concatenate([pattern[:n] for n in self.lens.tolist()]) & self.roomy(width))
        return at, window_names(self.data, width)[at] >> np.uint64(64 - bits)

    def candidates(self, at: np.ndarray, length: int) -> np.ndarray:
        """Positions whose ``length`` bytes hold one of ``at`` within their shifts."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, np.maximum(at - (PERIOD - 1), self.starts[self.doc[at]]), 1)
        np.add.at(edge, at + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & self.roomy(length))

    def prefixes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the prefixes at ``at``, computed over the documents that have one."""
        if not len(at):
            return np.zeros(0, np.uint64)
        has = np.zeros(len(self.lens), bool)
        has[self.doc[at]] = True
        keep = has[self.doc]
        where = np.cumsum(keep) - 1
        return window_names(self.data[keep], length)[where[at]]

    def distinct(self, names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names in order, the least and largest id of each, and each position's number among them."""
        order = np.argsort(names)
        ranked, ids = names[order], self.ids[self.doc[at]][order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.flatnonzero(new)
        number = np.empty(len(names), np.int64)
        number[order] = np.cumsum(new) - 1
        if not len(first):
            return ranked, ids, ids, number
        return ranked[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first), number


def chunks_of(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Packs the rows of each task into chunk rows, in the order they come: (doc_id, text), or (doc, data, marks) of
    documents already read. Nothing is shuffled."""
    again = "marks" in docs.columns
    schema = MARKED if again else CHUNKS
    fields = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count, held = TaskContext.get().partitionId() << 32, 0, 0
        rows: list[tuple[int, bytes, bytes | None]] = []

        def give() -> pa.RecordBatch:
            ids, parts, marks = zip(*rows)
            cols = [[base + count], [np.array(ids, np.int64).tobytes()], [np.array(list(map(len, parts)), np.int64).tobytes()], [zstandard.compress(b"".join(parts), 3)]]
            if again:
                bits = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(marks, parts)])
                cols.append([zstandard.compress(np.packbits(bits).tobytes(), 1)])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, fields)], schema=fields)

        def read(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes | None]]:
            if again:
                yield from zip(*(batch.column(c).to_pylist() for c in ("doc", "data", "marks")))
            else:
                for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch)):
                    yield NO_ID if doc is None else doc, text.encode(), None

        for batch in batches:
            for some in common.pieces(batch):
                for row in read(some):
                    if rows and held + len(row[1]) > chunk_bytes:
                        yield give()
                        rows, held, count = [], 0, count + 1
                    rows.append(row)
                    held += len(row[1])
        if rows:
            yield give()

    return docs.mapInArrow(run, schema)


def _ranges(names: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """The ranges that sorted names of ``bits`` bits fall into, each with where its names begin and end."""
    part = (names >> np.uint64(max(0, bits - 32))).astype(np.float64) * parts / float(1 << min(bits, 32))
    part = np.minimum(part.astype(np.int64), parts - 1)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(names)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield int(part[a]), a, b


def _send(chunk: int, names: np.ndarray, docs: Callable[[int, int], bytes], parts: int, bits: int) -> Iterator[dict]:
    """A row for each range of names the chunk has any of."""
    for part, a, b in _ranges(names, parts, bits):
        yield {"part": part, "chunk": chunk, "n": b - a, "names": squeeze(names[a:b]), "docs": docs(a, b)}


def _bits_back(sent: DataFrame, judge) -> DataFrame:
    """Rows dealt by range and sorted; a task judges one range at a time, and answers each row with a bit a name."""
    ordered = sent.repartition(common.shuffle_parts(sent.sparkSession), "part").sortWithinPartitions("part", "chunk")
    fields = common.arrow_schema(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def give() -> pa.RecordBatch:
            names = np.concatenate([unsqueeze(r["names"], r["n"]) for r in held])
            hit = judge(names, held)
            ends = np.cumsum([r["n"] for r in held])
            cols = [[r["chunk"] for r in held], [r["part"] for r in held], [np.packbits(hit[e - r["n"] : e]).tobytes() for r, e in zip(held, ends)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, fields)], schema=fields)

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != held[0]["part"]:
                    yield give()
                    held = []
                held.append(row)
        if held:
            yield give()

    return ordered.mapInArrow(run, BITS)


def _several(names: np.ndarray, held: list[dict]) -> np.ndarray:
    """Step 2: names of more than one document."""
    alone = np.concatenate([np.unpackbits(np.frombuffer(r["docs"], np.uint8), count=r["n"]) for r in held]) == 1
    _, number, count = np.unique(names, return_inverse=True, return_counts=True)
    more = count > 1
    more[number[~alone]] = True
    return more[number]


def _later(names: np.ndarray, held: list[dict]) -> np.ndarray:
    """Step 4: prefixes that an earlier document has as well."""
    docs = np.concatenate([_ids_back(r["docs"], r["n"]) for r in held])
    order = np.argsort(names)
    ranked, ids = names[order], docs[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(names), bool)
    out[order] = least < ids
    return out


def _ids_out(ids: np.ndarray) -> bytes:
    """Document ids of a row: the distinct ones, and 32-bit numbers into them, by planes."""
    own, number = np.unique(ids, return_inverse=True)
    planes = number.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(own).to_bytes(4, "little") + zstandard.compress(own.tobytes() + np.ascontiguousarray(planes).tobytes(), 1)


def _ids_back(data: bytes, n: int) -> np.ndarray:
    k, raw = int.from_bytes(data[:4], "little"), zstandard.decompress(data[4:])
    planes = np.frombuffer(raw, np.uint8, offset=8 * k).reshape(4, n)
    return np.frombuffer(raw, np.int64, k)[np.ascontiguousarray(planes.T).view("<u4").reshape(-1)]


def _with_bits(chunks: DataFrame, bits: DataFrame) -> DataFrame:
    """Chunk rows with the answers to all they sent, in the order of ranges."""
    answers = bits.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("answers"))
    return chunks.join(answers, "chunk", "left")


def _unpack(answers: list[dict] | None, sizes: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n) for a, n in zip(answers or [], sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def removed(docs: DataFrame, length: int = 50, chunk_bytes: int = 4 << 20, range_names: int = 4 << 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if it is covered by a string of ``length`` bytes that also starts in a row with a smaller
    doc_id. Null text is empty; texts shorter than ``length`` lose nothing; rows that share a doc_id do not count
    against each other; a null doc_id counts as the largest. An empty table gives no rows; further columns are not
    read. ``length`` must be at least 38, so that a sampled tuple has eight bytes.
    """
    if length < PERIOD + 7:
        raise ValueError("length must be at least 38")
    spark, width = docs.sparkSession, length - PERIOD + 1
    chunks, chunk_path = common.stage_table(chunks_of(common.pick(docs, "doc_id", "text"), chunk_bytes), "sub-chunks")
    total = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    keys = max(1, total)  # about as many sampled positions as compressed bytes
    parts = max(common.shuffle_parts(spark), math.ceil(keys / range_names))
    bits = min(64, max(36, math.ceil(math.log2(keys)) + 12))

    def sizes_of(names: np.ndarray, wide: int) -> list[int]:
        return [b - a for _, a, b in _ranges(names, parts, wide)]

    def rows(out: list[dict], fields: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=fields)

    sent_fields, split_fields, result_fields = (common.arrow_schema(s) for s in (SENT, SPLIT, RESULT))

    def send_tuples(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                at, names = chunk.sample(width, bits)
                own, low, high, _ = chunk.distinct(names, at)
                yield rows(list(_send(row["chunk"], own, lambda a, b: np.packbits(low[a:b] == high[a:b]).tobytes(), parts, bits)), sent_fields)

    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                at, names = chunk.sample(width, bits)
                own, _, _, number = chunk.distinct(names, at)
                shared = _unpack(row["answers"], sizes_of(own, bits))
                hit = shared[number] if len(at) else np.zeros(0, bool)
                marks = np.zeros(len(chunk.data), bool)
                marks[chunk.candidates(at[hit], length)] = True
                least = np.full(len(chunk.ids), NO_ID, np.uint64)
                np.minimum.at(least, chunk.doc[at[hit]], names[hit])
                out = []
                for k, (doc, a, b) in enumerate(zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.ends.tolist())):
                    mine, data = marks[a:b], chunk.data[a:b].tobytes()
                    if mine.any():
                        out.append({"name": int(least[k]) & NO_ID, "doc": doc, "data": data, "marks": np.packbits(mine).tobytes()})
                    else:
                        out.append({"doc": doc, "n_bytes": b - a, "kept_sha256": hashlib.sha256(data).hexdigest()})
                yield rows(out, split_fields)

    def marked_at(row: dict, chunk: Chunk) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(row["marks"]), np.uint8), count=len(chunk.data)))

    def send_prefixes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                at = marked_at(row, chunk)
                own, low, _, _ = chunk.distinct(chunk.prefixes(at, length), at)
                yield rows(list(_send(row["chunk"], own, lambda a, b: _ids_out(low[a:b]), parts, 64)), sent_fields)

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                at = marked_at(row, chunk)
                own, low, _, number = chunk.distinct(chunk.prefixes(at, length), at)
                later = _unpack(row["answers"], sizes_of(own, 64))
                hit = at[later[number] | (low[number] < chunk.ids[chunk.doc[at]])] if len(at) else at
                edge = np.zeros(len(chunk.data) + 1, np.int32)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = []
                for doc, a, b in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.ends.tolist()):
                    g = gone[a:b]
                    n = int(np.count_nonzero(g))
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n else 0
                    kept = chunk.data[a:b][~g] if n else chunk.data[a:b]
                    out.append({"doc_id": None if doc == NO_ID else doc, "n_bytes": b - a, "n_removed": n, "n_spans": spans, "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest()})
                yield rows(out, result_fields)

    shared, shared_path = common.stage_table(_bits_back(chunks.mapInArrow(send_tuples, SENT), _several), "sub-shared")
    common.release_shuffles(spark)
    halves, halves_path = common.stage_table(_with_bits(chunks, shared).mapInArrow(split, SPLIT), "sub-split")
    common.drop_path(spark, chunk_path)
    common.drop_path(spark, shared_path)
    common.release_shuffles(spark)
    whole = halves.filter("data is null").select(F.expr(f"nullif(doc, {NO_ID})").alias("doc_id"), "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), "kept_sha256")
    whole, _ = common.stage_table(whole, "sub-whole")
    near = halves.filter("data is not null").select("name", F.xxhash64("doc").alias("h"), "doc", "data", "marks")
    near = near.repartitionByRange(common.shuffle_parts(spark), "name", "h").sortWithinPartitions("name", "h")
    marked, _ = common.stage_table(chunks_of(near, chunk_bytes), "sub-marked")
    common.drop_path(spark, halves_path)
    common.release_shuffles(spark)
    later, _ = common.stage_table(_bits_back(marked.mapInArrow(send_prefixes, SENT), _later), "sub-later")
    common.release_shuffles(spark)
    return whole.unionByName(_with_bits(marked, later).mapInArrow(finish, RESULT))

"""Token-id files: zstandard frames with one shared dictionary, a dictionary hash and an offset index.

A store is a folder with three Spark-written tables, so that any file system Spark reaches can hold it and a lost
executor only repeats its own shards:

* ``shards``: (part, seq, first_doc, n_docs, n_tokens, dict_sha256, data), ordered by (part, seq). ``data`` is the binary shard.
* ``dictionary``: one row (sha256, data): the zstandard dictionary.

A shard is ``NVTK`` + version (u32) + id width (u32) + n (u64) + the dictionary's SHA-256 (32 bytes), then n index
entries (doc_id i64, null flag u8, tokens u64, frame offset u64, frame length u64) and the frames. A reader finds a
document in the index and decompresses that one frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC, VERSION = b"NVTK", 1
HEAD = struct.Struct("<4sIIQ32s")
ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("tokens", "<u8"), ("at", "<u8"), ("size", "<u8")])
SHARDS = "part int, seq int, first_doc bigint, n_docs bigint, n_tokens bigint, dict_sha256 string, data binary"
ROWS = "part int, seq int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample_docs: int = 1000, sample_chars: int = 8000, size: int = 65_536, end_id: int = 0) -> bytes:
    """The shared dictionary, trained on the serialized ids of about ``sample_docs`` documents chosen by a hash of
    their id, of each at most ``sample_chars`` characters. It only sets the compression ratio; every document is
    written whole. Too little text for training gives an empty dictionary."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    rows = some.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, sample_chars).alias("t")).limit(4 * sample_docs).collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.t))
    enc = encoder(tokenizer_path)
    width = _width(enc)
    parts = [_narrow(ids, end_id, width) for ids in enc.encode([r.t for r in rows])]
    parts = [p[k : k + 4096] for p in parts for k in range(0, len(p), 4096)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, parts)) // 10), parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _width(enc) -> int:
    return 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4


def _narrow(ids: bytes, end_id: int, width: int) -> bytes:
    return np.frombuffer(ids + end_id.to_bytes(4, "little"), "<u4").astype(f"<u{width}").tobytes()


def pack_shard(rows: list[tuple[int | None, int, bytes]], dict_sha: bytes, width: int) -> bytes:
    index = np.zeros(len(rows), ENTRY)
    at = 0
    for k, (doc, n, frame) in enumerate(rows):
        index[k] = (0 if doc is None else doc, doc is None, n, at, len(frame))
        at += len(frame)
    return b"".join([HEAD.pack(MAGIC, VERSION, width, len(rows), dict_sha), index.tobytes(), *[f for _, _, f in rows]])


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, n, sha = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.data, self.index = data, np.frombuffer(data, ENTRY, n, HEAD.size)
        self.base = HEAD.size + n * ENTRY.itemsize
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        e = self.index[k]
        at = self.base + int(e["at"])
        raw = self.reader.decompress(self.data[at : at + int(e["size"])], max_output_size=int(e["tokens"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_bytes: int = 8 << 20, level: int = 3, dictionary: bytes | None = None) -> None:
    """Writes ``docs`` (doc_id, text) as a store, in ascending doc_id order over shards and inside each.

    Null text is the empty text; a null doc_id sorts first; rows that repeat a doc_id are kept, next to each other,
    in the order of their texts. An empty table gives a store without shards. Further columns are not read.
    """
    spark = docs.sparkSession
    docs = common.pick(docs, "doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer_path, end_id=end_id) if dictionary is None else dictionary
    sha = hashlib.sha256(dictionary).digest()
    fields = common.arrow_schema(SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path)
        width = _width(enc)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_dict_id=False)
        rows, held = [], 0

        def shard() -> pa.RecordBatch:
            data = pack_shard(rows, sha, width)
            line = [[part], [count], [rows[0][0]], [len(rows)], [sum(n for _, n, _ in rows)], [sha.hex()], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(line, fields)], schema=fields)

        for batch in batches:
            for some in common.pieces(batch):
                for doc, ids in zip(some.column("doc_id").to_pylist(), enc.encode(common.texts_of(some))):
                    frame = writer.compress(_narrow(ids, end_id, width))
                    rows.append((doc, len(ids) // 4 + 1, frame))
                    held += len(frame) + ENTRY.itemsize
                    if held >= shard_bytes:
                        yield shard()
                        rows, held, count = [], 0, count + 1
        if rows:
            yield shard()

    ordered = docs.repartitionByRange(common.shuffle_parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(sha.hex(), bytearray(dictionary))], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().data)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), read back from the frames."""
    dictionary = read_dictionary(spark, path)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    fields = common.arrow_schema(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("data")):
                reader = ShardReader(data.as_py(), dictionary)
                n = reader.index["tokens"].astype(np.int64)
                ids = [None if e["null_id"] else int(e["doc_id"]) for e in reader.index]
                crc = [zlib.crc32(reader.ids(k).tobytes()) for k in range(len(n))]
                cols = [[part] * len(n), [seq] * len(n), ids, np.cumsum(n) - n, n, crc]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, fields)], schema=fields)

    inside = Window.partitionBy("part").orderBy("seq")
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # a row a range that the store was written in
    starts = sums.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"))
    places = shards.select("part", "seq", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("before")).join(starts, "part")
    rows = shards.select("part", "seq", "data").mapInArrow(run, ROWS)
    return rows.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

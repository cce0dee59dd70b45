"""Shared plumbing of the training-data operators: scratch tables, Arrow batches, column picking."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_state: dict = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """The one object that a Python worker keeps between its tasks, such as a loaded tokenizer. A task that asks for
    another key, or has none (``None``), drops it, so that what earlier stages left doesn't pile up in a worker."""
    if key not in _state:
        if _state:
            _state.clear()
            gc.collect()
            trim()
        _state[key] = make()
    return _state[key]


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). A local one is made only where that is unset and
    the driver runs all tasks itself; elsewhere executors could not read each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='nearvote-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of passes whose result is already in a table."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, stateless: bool = True) -> DataFrame:
    """``mapInArrow`` whose worker builds its state once a task and turns each batch into a dict of columns.
    ``stateless``: nothing is kept from the worker's earlier tasks."""
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for part in pieces(batch):
                if step is None:
                    if stateless:
                        worker_state(None, bool)
                    step = make()
                out = step(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)
                out = None
            batch = part = None
            trim()

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes, so that what a worker derives from a batch stays bounded."""
    rows = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings; null becomes the empty string."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: further columns of the input, whatever their names, never reach an operator."""
    return df.select(*[df[n] for n in names])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def spread(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

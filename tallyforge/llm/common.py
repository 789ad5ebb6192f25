"""Shared helpers of the training-data operators: tables, scratch space, Arrow output."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyforge.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; always read through Spark, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder that the session names in spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/tallyforge-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(*tables: DataFrame) -> None:
    """Delete the files of tables that saved() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a short DDL string as mapInArrow takes it."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ", 1) for f in ddl.split(","))])


def batch_of(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    pending: list[tuple] = []
    for row in rows:
        pending.append(row)
        if len(pending) >= size:
            yield batch_of(pending, schema)
            pending = []
    if pending:
        yield batch_of(pending, schema)


def give_back() -> None:
    """Give freed memory back to the system, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_memories: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Say that this worker now remembers things for `owner`; what it remembered for others is forgotten.

    Python workers outlive stages, so that without this the memories of all operators would add up.
    Freed memory is given back to the system where the platform can.
    """
    others = [k for k in _memories if k != owner]
    for other in others:
        _memories.pop(other)()
    _memories[owner] = forget
    if others:
        give_back()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short pieces of the batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with about `most` bytes of a string column each, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)

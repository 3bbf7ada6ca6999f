"""Cutting lineage for the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

#: Per open `scratch`, the tables written since.
_written: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again; lineage ends there.

    A lost executor costs at most the running tasks, since the files outlive it. Within `scratch` the table is deleted in the end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that returns freed memory to the machine when it ends: workers are used again, and keep it otherwise."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that `materialize` writes inside; whatever is read from them must be written before the end."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete_table(spark, path)

"""Shared helpers of the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage, staging_path

__all__ = ["ROW_ID", "arrow_map", "far_rows", "near_rows", "offsets", "read_table", "scratch_name", "stage", "staging_path", "text_batches", "text_code"]

ROW_ID = "__row"
# texts handed to one step of a Python task: a batch is cut so that working arrays stay small
STEP_BYTES = 4 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table of the folder; only Spark opens the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_name(label: str) -> str:
    """A column name that cannot clash with the caller's columns."""
    return f"__{label}_{uuid.uuid4().hex[:8]}"


def text_batches(batches: Iterator[pa.RecordBatch], column: int, step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each Arrow batch in pieces of about ``step`` bytes of text, with the texts as UTF-8 bytes (None for null)."""
    for batch in batches:
        sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        steps = np.cumsum(sizes) // step
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                part = batch.slice(lo, hi - lo)
                yield part, part.column(column).cast(pa.binary()).to_pylist()


# Settings that bound what a task holds of long texts, and the defaults they replace: rows of a scan's batch, rows and bytes of an Arrow batch.
BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": ("512", ("4096",)),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("500", ("10000",)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("4194304", (None, "67108864b", "67108864", "64MB", "-1")),
}


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts are kept small in this session, unless it has settings of its own (Spark's defaults are thousands of rows of any length).

    Buffers for whole batches are single large arrays, in the JVM as in Python; small ones come and go without making the heaps grow.
    """
    for key, (value, defaults) in BATCHES.items():
        if spark.conf.get(key, None) in defaults:
            spark.conf.set(key, value)


def give_back() -> None:
    """Workers live on after a task: what it held of Arrow and of the C library's heap goes back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over the columns of ``df`` in small batches; a task gives its memory back when it ends, as workers live on."""
    bound_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(task, schema)


def text_code(column: str | Column) -> Column:
    """64-bit hash of a text (null: of the empty one), which tells apart texts under one id."""
    return F.xxhash64(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")))


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each run in the concatenation of runs of the given lengths, and the end of the last."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def near_rows(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, buckets: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` that can have a wanted key: all that do, and those whose key hashes to the same bucket.

    Sifts wide rows in the scan, before a join would shuffle them. What is broadcast are the buckets in use, ``buckets`` integers
    at most whatever the data; the more keys are wanted the less is sifted out, and nothing is ever lost.
    """
    bucket = scratch_name("bucket")
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias(bucket)
    used = wanted.select(of(wanted_key)).distinct()
    return df.select("*", of(key)).join(F.broadcast(used), bucket, "left_semi").drop(bucket)


def far_rows(df: DataFrame, key: str, listed: DataFrame, listed_key: str, buckets: int = 1 << 20) -> DataFrame:
    """The other rows of ``df``: those whose key hashes to no bucket of a listed one, so that only :func:`near_rows` have to be compared."""
    bucket = scratch_name("bucket")
    of = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int"), F.lit(-1)).alias(bucket)
    used = listed.select(of(listed_key)).distinct()
    return df.select("*", of(key)).join(F.broadcast(used), bucket, "left_anti").drop(bucket)


def crc32_of_id(column: str | Column) -> Column:
    """Unsigned crc32 of an id written as text."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))

"""Table sinks. A batch has a number, and writing the same batch again changes nothing."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.upserts import apply_net, net_changes
from ..session import stage


def jdbc_write_options(url: str, table: str, batch_size: int = 1000, **extra: str) -> dict[str, str]:
    """Writer options of a database table. Spark commits per partition, so write to a side table
    and let one statement of the database move its rows when a batch has to appear at once."""
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), **extra}


def write_table(df: DataFrame, sink: dict[str, str], mode: str = "append") -> None:
    """Write to any sink described by writer options (``format``, ``path`` or connector options)."""
    options = dict(sink)
    writer = df.write.format(options.pop("format")).mode(mode)
    path = options.pop("path", None)
    writer = writer.options(**options)
    writer.save(path) if path else writer.save()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch to a table partitioned by ``batch_id``; a repeated batch replaces itself.

    Files become visible when the job commits; a failed job leaves none.
    """
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.partitionBy("batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    )


class KeyedTable(NamedTuple):
    """A Parquet folder whose rows lie in ``buckets`` partitions by the hash of their key; a bucket is the least that a change rewrites.

    Spark's dynamic partition overwrite does the writing: a batch replaces the buckets it touches and no others, each when the job commits. A driver
    that dies in that moment may have replaced some buckets; running the batch again completes it, as net changes put whole rows. A reader
    may see some buckets before others; where that or a lost driver must not show, use a table format with MERGE and :func:`merge_into`.
    """

    path: str
    schema: str | StructType
    keys: tuple[str, ...]
    buckets: int = 16

    def _stored(self, spark: SparkSession) -> StructType:
        return StructType([*spark.createDataFrame([], self.schema).schema.fields, StructField("_bucket", IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _write(self, rows: DataFrame, buckets: Collection[int], mode: str) -> None:
        """``rows`` with their bucket, and a row without a key for each bucket, so that one that loses its last row is replaced too."""
        marks = rows.sparkSession.createDataFrame([(b,) for b in buckets], "_bucket int")
        whole = rows.unionByName(marks, allowMissingColumns=True).select(*rows.columns)
        whole.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", mode).parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Write the whole table."""
        spark = rows.sparkSession
        columns = [f.name for f in self._stored(spark).fields[:-1]]
        self._write(rows.select(*columns, self._bucket()), range(self.buckets), "static")

    def read(self, spark: SparkSession, only: Collection[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        rows = spark.read.schema(self._stored(spark)).parquet(self.path).where(F.col(self.keys[0]).isNotNull())
        return (rows if only is None else rows.where(F.col("_bucket").isin(list(only)))).drop("_bucket")

    def merge(
        self, changes: DataFrame, seq: str = "seq", before: str | None = "before", after: str = "after",
    ) -> int:
        """Apply an ordered batch of changes; returns the number of buckets written.

        For use in ``foreachBatch``: running a batch again changes nothing. The batch becomes one row per key first and is written, so Catalyst knows
        its size and sends a small one to the buckets it touches. A batch without changes writes nothing.
        """
        spark = changes.sparkSession
        like = spark.createDataFrame([], self.schema)
        net = stage(net_changes(like, changes, self.keys, seq, before=before, after=after).withColumn("_bucket", self._bucket()), "net")
        touched = sorted(r[0] for r in net.select("_bucket").distinct().collect())  # at most the number of buckets
        if touched:
            merged = apply_net(self.read(spark, touched), net.drop("_bucket"), self.keys, lookup=True)
            self._write(merged.select("*", self._bucket()), touched, "dynamic")
        return len(touched)


def merge_statement(target: str, net: str, keys: Sequence[str], columns: Sequence[str]) -> str:
    """MERGE text that applies net changes (view ``net``) to a table whose format supports it."""
    on = " AND ".join(f"t.`{k}` = n.`{k}`" for k in keys)
    sets = ", ".join(f"t.`{c}` = n._new.`{c}`" for c in columns if c not in keys)
    names = ", ".join(f"`{c}`" for c in columns)
    values = ", ".join(f"n._new.`{c}`" for c in columns)
    return (
        f"MERGE INTO {target} t USING {net} n ON {on} "
        f"WHEN MATCHED AND n._state = 'DROP' THEN DELETE "
        f"WHEN MATCHED THEN UPDATE SET {sets} "
        f"WHEN NOT MATCHED AND n._state = 'PUT' THEN INSERT ({names}) VALUES ({values})"
    )


def merge_into(
    table: str, changes: DataFrame, keys: Sequence[str], seq: str = "seq", before: str | None = "before",
    after: str = "after",
) -> None:
    """Apply a batch of ordered changes to a table whose format has MERGE.

    Only the files of touched rows are rewritten. Every image replaces a whole row, so running the same
    batch again changes nothing.
    """
    spark = changes.sparkSession
    target = spark.table(table)
    net = stage(net_changes(target, changes, keys, seq, before=before, after=after), "net")
    view = f"net_changes_{uuid.uuid4().hex}"  # sinks of one group share the session
    net.createOrReplaceTempView(view)
    try:
        spark.sql(merge_statement(table, view, keys, target.columns))
    finally:
        spark.catalog.dropTempView(view)


def fan_out(batch: DataFrame, groups: Sequence[Sequence[Callable[[DataFrame], None]]]) -> None:
    """Give one batch to several sinks: groups in order, the sinks of a group at the same time.

    A failing sink fails the batch after its group has ended; later groups do not start. The batch is staged, so all
    sinks read the same rows, also after a lost executor.
    """
    kept = stage(batch, "batch")
    for sinks in groups:
        with ThreadPoolExecutor(max_workers=max(len(sinks), 1)) as pool:
            for done in [pool.submit(sink, kept) for sink in sinks]:
                done.result()


def with_retry(
    fn: Callable, attempts: int = 3, wait: float = 1.0, factor: float = 3.0, max_wait: float = 60.0,
    sleep: Callable[[float], None] = time.sleep, on_error: Callable[[int, Exception], None] | None = None,
) -> Callable:
    """Repeat a write step on any exception, waiting longer each time. The step has to be repeatable."""
    @functools.wraps(fn)
    def call(*args, **kwargs):
        pause = wait
        for attempt in range(1, attempts + 1):
            try:
                return fn(*args, **kwargs)
            except Exception as error:
                if on_error:
                    on_error(attempt, error)
                if attempt == attempts:
                    raise
                sleep(min(pause, max_wait))
                pause *= factor

    return call

"""Named sources: files, JDBC, Kafka topics and sharded tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import shard_of
from ..session import staging_path

Source = Mapping[str, str] | DataFrame

# rows of a partition that a task sorts or groups at once
TASK_ROWS = 1 << 18
# characters of texts that a task cuts into words
TASK_CHARS = 1 << 23
# rows of a bucket, which is a file too
BUCKET_ROWS = 1 << 20


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """One Parquet table per name below ``folder``."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def place_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by the hash of ``keys`` in partitions of about ``TASK_ROWS`` rows, counted first: tables of any size make tasks of one size.

    Joins and groupings by the keys then need no other exchange. Adaptive execution merges partitions by their bytes, and of narrow rows that are later
    hashed or sorted there are too many in those; it leaves a number that is given as it is.
    """
    n = max(-(-df.count() // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def place_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows by the hash of ``key`` in partitions of about ``TASK_CHARS`` characters of ``text``, counted first.

    For texts whose words are grouped with the key: the words then stay where they are, and what is exchanged is the texts.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(-(-chars // TASK_CHARS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, key)


def open_source(spark: SparkSession, source: Source) -> DataFrame:
    """A source is a DataFrame or reader options with ``format`` and, for files, ``path``."""
    if isinstance(source, DataFrame):
        return source
    options = dict(source)
    reader = spark.read.format(options.pop("format"))
    path = options.pop("path", None)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def register_views(spark: SparkSession, sources: Mapping[str, Source]) -> None:
    for name, source in sources.items():
        open_source(spark, source).createOrReplaceTempView(name)


def sql_query(
    spark: SparkSession, sources: Mapping[str, Source], text: str, args: Mapping | None = None
) -> DataFrame:
    """Run SELECT text over named sources; the result keeps the column names of the text."""
    register_views(spark, sources)
    return spark.sql(text, args=dict(args or {}))


def jdbc_options(url: str, text: str, fetch_size: int = 10_000, partition: Mapping | None = None, **extra) -> dict:
    """Reader options of a query that runs unchanged in the source database.

    ``partition`` = column, lower, upper, count: the scan is split into parallel range reads.
    """
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    if not partition:
        # one cursor: the text goes down unchanged
        return {**options, "query": text}
    return {
        **options,
        "dbtable": f"({text}) src",
        "partitionColumn": partition["column"],
        "lowerBound": str(partition["lower"]),
        "upperBound": str(partition["upper"]),
        "numPartitions": str(partition["count"]),
    }


def read_stream_query(
    spark: SparkSession, source: Mapping[str, str], text: str, partition: Mapping | None = None, fetch_size: int = 10_000
) -> DataFrame:
    """Full scan of a query by cursor. Partitions and batches of Spark are the chunks.

    JDBC sources stream with ``fetchsize`` and may be split by a numeric or time column; other
    formats are scanned by Spark itself, where ``text`` is SELECT text over the view ``source``.
    """
    source = dict(source)
    if source.get("format") == "jdbc":
        source.pop("format")
        url = source.pop("url")
        return spark.read.format("jdbc").options(**jdbc_options(url, text, fetch_size, partition, **source)).load()
    return sql_query(spark, {"source": source}, text)


def kafka_options(
    servers: str, topic: str, group: str | None = None, batch: bool = False, batch_size: int = 100,
    timeout_ms: int = 1000, starting: str = "latest",
) -> dict[str, str]:
    """Reader options of a topic.

    In batch mode a micro-batch waits for ``batch_size`` records, at most ``timeout_ms``
    (0 waits for the count alone, which Spark expresses as its longest trigger delay).
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    if batch:
        options["minOffsetsPerTrigger"] = str(batch_size)
        options["maxTriggerDelay"] = f"{timeout_ms}ms" if timeout_ms else "365d"
    return options


def kafka_receive(spark: SparkSession, key: str | None = None, **options) -> DataFrame:
    """Streaming rows (key, value, topic, partition, offset, timestamp) of a topic; ``key`` keeps one message key."""
    raw = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    rows = raw.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "topic", "partition", "offset", "timestamp",
    )
    return rows.filter(F.col("key") == key) if key else rows


def shard_route(df: DataFrame, key: str, n: int = 10, prefix: str | None = None) -> DataFrame:
    """Add the ``shard`` of each row by the hash of its key, and the physical table name if ``prefix`` is given."""
    routed = df.withColumn("shard", shard_of(F.col(key).cast("string"), n))
    return routed.withColumn("shard_table", F.concat(F.lit(prefix), "shard")) if prefix else routed


def write_shards(df: DataFrame, path: str, key: str, n: int = 10) -> None:
    """Write a table as ``n`` shard folders; a shard has as many writers as its size asks for."""
    shard_route(df, key, n).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def bucket_count(least: int, *tables: DataFrame) -> int:
    """A number of buckets for tables that are joined: ``least``, doubled until a bucket of the largest holds ``BUCKET_ROWS`` rows at most.

    A task sorts and joins whole buckets. Of two numbers one is a multiple of the other, so tables written at different sizes still share buckets.
    """
    rows, n = max(df.count() for df in tables), least
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def write_buckets(df: DataFrame, table: str, key: str, n: int = 10, path: str | None = None) -> DataFrame:
    """Write a table as ``n`` bucket files by the hash of its key, sorted by it, known to the catalog as ``table``; returns it.

    What folders of shards do for scans, buckets do for keys: a condition on the key opens one bucket, and tables with as many buckets of
    one key type are joined or grouped by it without an exchange. ``path`` (default: the shared folder) keeps the files outside the warehouse. A null
    key is in a bucket of its hash like any other.
    """
    spark = df.sparkSession
    rows = df.repartition(n, key)  # the hash of buckets, so that a bucket is one file
    rows.write.bucketBy(n, key).sortBy(key).mode("overwrite").option("path", path or staging_path(spark, "buckets")).saveAsTable(table)
    return spark.table(table)


def read_shards(spark: SparkSession, parts: str | Sequence[str | DataFrame]) -> DataFrame:
    """The logical table over its shards: a partitioned path, or a list of paths or tables."""
    if isinstance(parts, str):
        return spark.read.parquet(parts)
    frames = [p if isinstance(p, DataFrame) else spark.read.parquet(p) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), frames)

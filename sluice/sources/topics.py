"""A topic kept as Parquet files, and a listener on it: a streaming source with offsets, for where no broker is.

A topic is a folder ``topic=…/partition=…`` of files with the columns ``key, value, timestamp, offset``; offsets of a partition run from 0
without a gap. Anything that writes such files feeds the listener, Spark or not.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import number_rows
from .tables import kafka_options

# workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_SCHEMA = "key string, value string, timestamp timestamp, offset long"
DELAYS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86_400}


def publish(
    df: DataFrame, folder: str, topic: str, key: str | Column, value: str | Column, order: Sequence[str],
    partition: Column | None = None, partitions: int = 1, timestamp: str | Column | None = None,
) -> None:
    """Append rows to a topic: messages of a partition get the next offsets, by ``order`` (unique within a partition).

    The partition is that of the key's hash unless given. One writer at a time, as offsets continue those that are there.
    """
    spark = df.sparkSession
    of = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(
        of(key).cast("string").alias("key"), of(value).cast("string").alias("value"),
        (F.current_timestamp() if timestamp is None else of(timestamp).cast("timestamp")).alias("timestamp"),
        (F.pmod(F.xxhash64(of(key)), F.lit(partitions)) if partition is None else partition).cast("int").alias("partition"),
        *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    path = f"{folder}/topic={topic}"
    numbered = number_rows(rows, [f"_order{i}" for i in range(len(order))], ["partition"], out="_n")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        before = spark.read.schema(FILE_SCHEMA + ", partition int").parquet(path).groupBy("partition").agg((F.max("offset") + 1).alias("_next"))
        numbered = numbered.join(before, "partition", "left")
    else:
        numbered = numbered.withColumn("_next", F.lit(0))
    numbered.select("key", "value", "timestamp", (F.col("_n") - 1 + F.coalesce("_next", F.lit(0))).cast("long").alias("offset"), "partition").write.mode(
        "append").partitionBy("partition").parquet(path)


class FileRange(InputPartition):
    """Offsets ``low`` to below ``high`` of one file."""

    def __init__(self, path: str, partition: int, low: int, high: int) -> None:
        self.path, self.partition, self.low, self.high = path, partition, low, high


class TopicReader(DataSourceStreamReader):
    """Offsets are ``{partition: next offset}``. The batch planned last is noted for the query's group, so that batches stay bounded after a restart."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.folder, self.topic = options["kafka.bootstrap.servers"], options["subscribe"]
        self.starting, self.group = options.get("startingOffsets", "latest"), options.get("kafka.group.id")
        self.least, self.most = int(options.get("minOffsetsPerTrigger", 0)), int(options.get("maxOffsetsPerTrigger", 0))
        delay = options.get("maxTriggerDelay", "15m")
        unit = next(u for u in DELAYS if delay.endswith(u))
        self.delay = float(delay.removesuffix(unit)) * DELAYS[unit]
        self.known: dict[str, tuple[int, int, int]] = {}
        self.position: dict[str, int] | None = None
        self.start: dict[str, int] | None = None
        self.waiting: float | None = None

    def _system(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")

    def _files(self) -> dict[str, tuple[int, int, int]]:
        """(partition, first offset, offset behind the last) of each file, from the footers; a file is looked at once."""
        system, root = self._system()
        selector = pafs.FileSelector(f"{root}/topic={self.topic}", recursive=True, allow_not_found=True)
        for info in system.get_file_info(selector):
            inside = info.path.split(f"topic={self.topic}/", 1)[-1]
            if info.path in self.known or not inside.endswith(".parquet") or any(p[0] in "_." for p in inside.split("/")):
                continue
            with system.open_input_file(info.path) as file:
                footer = pq.ParquetFile(file).metadata
            at = footer.schema.names.index("offset")
            stats = [footer.row_group(i).column(at).statistics for i in range(footer.num_row_groups)]
            if stats:
                partition = int(inside.split("partition=", 1)[1].split("/", 1)[0])
                self.known[info.path] = partition, min(s.min for s in stats), max(s.max for s in stats) + 1
        return self.known

    def _ends(self) -> dict[str, int]:
        """Offset behind the last of each partition, up to the first gap: files of one write may appear one by one."""
        ends: dict[str, int] = {}
        for partition, low, high in sorted(self._files().values()):
            if low <= ends.get(str(partition), 0):
                ends[str(partition)] = max(high, ends.get(str(partition), 0))
        return ends

    def _note_path(self, root: str) -> str:
        return f"{root}/_groups/{self.topic}/{self.group}.json"

    def _noted(self) -> dict[str, int] | None:
        system, root = self._system()
        if not self.group or system.get_file_info(self._note_path(root)).type == pafs.FileType.NotFound:
            return None
        with system.open_input_stream(self._note_path(root)) as file:
            return json.loads(file.read())

    def initialOffset(self) -> dict:
        """Start of a query without a checkpoint: earliest, latest, or offsets by partition as JSON."""
        if self.start is None:
            self.start = {} if self.starting == "earliest" else self._ends() if self.starting == "latest" else {
                p: int(o) for p, o in json.loads(self.starting).items()}
        self.position = self.position or self.start
        return self.start

    def latestOffset(self) -> dict:
        """What the next batch goes up to: nothing new until ``minOffsetsPerTrigger`` messages are there or the first has waited for
        ``maxTriggerDelay``, then at most ``maxOffsetsPerTrigger``, shared among the partitions by what they have.

        The position is the end of the batch planned last, which the group's note keeps over a restart. Spark may ask before it names one: a group without a
        note starts at the beginning; without a group the position is unknown, and one batch takes all there is.
        """
        ends = self._ends()
        if self.position is None and self.group:
            noted = self._noted()
            self.position = self.initialOffset() if noted is None else noted
        if self.position is None:
            return ends
        at = {p: self.position.get(p, 0) for p in {*ends, *self.position}}
        fresh = {p: max(0, ends.get(p, 0) - o) for p, o in at.items()}
        total = sum(fresh.values())
        if not total:
            self.waiting = None
            return self.position
        self.waiting = self.waiting or time.monotonic()
        if total < self.least and time.monotonic() - self.waiting < self.delay:
            return self.position
        share = dict(fresh)
        if self.most and total > self.most:
            share = {p: n * self.most // total for p, n in fresh.items()}
            for p in sorted(fresh):  # what rounding left
                share[p] += min(fresh[p] - share[p], self.most - sum(share.values()))
        return {p: o + share[p] for p, o in at.items() if o + share[p]}

    def _planned(self, end: dict[str, int]) -> None:
        """Spark has logged the end of this batch: it is the position, also after a restart."""
        self.position, self.waiting = end, None
        if self.group:
            system, root = self._system()
            path = self._note_path(root)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path + ".new") as file:
                file.write(json.dumps(end).encode())
            system.move(path + ".new", path)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """The files that hold the offsets of a batch, cut to them; the same for a batch that is run again."""
        self._planned(end)
        ranges = []
        for path, (partition, low, high) in sorted(self._files().items()):
            low, high = max(low, start.get(str(partition), 0)), min(high, end.get(str(partition), 0))
            if low < high:
                ranges.append(FileRange(path, partition, low, high))
        return ranges

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["key", "value", "timestamp", "offset"]):
                offsets = batch.column("offset")
                batch = batch.filter(pc.and_(pc.greater_equal(offsets, partition.low), pc.less(offsets, partition.high)))
                n = batch.num_rows
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").cast(pa.string()), batch.column("value").cast(pa.string()), pa.array([self.topic] * n),
                         pa.array([partition.partition] * n, pa.int32()), batch.column("offset"),
                         batch.column("timestamp").cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", "UTC"))],
                        names=["key", "value", "topic", "partition", "offset", "timestamp"])


class TopicLog(DataSource):
    """The listener's format; options and columns are those of the topic reader, with the folder in place of the servers."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return "key string, value string, topic string, partition int, offset long, timestamp timestamp"

    def streamReader(self, schema) -> TopicReader:
        return TopicReader(self.options)


def topic_receive(spark: SparkSession, folder: str, key: str | None = None, max_batch: int | None = None, **options) -> DataFrame:
    """Streaming rows (key, value, topic, partition, offset, timestamp) of a topic folder, as ``kafka_receive`` gives them.

    ``options`` are those of :func:`kafka_options` without servers: topic, group, batch, batch_size, timeout_ms, starting. A group belongs to one query.
    ``max_batch`` bounds a batch. Delivery is that of Spark's offset log: a batch that did not finish is read again, with the same rows. The folder
    is read by workers themselves, so it lies in a store that pyarrow opens (a mounted folder, HDFS, S3, GCS).
    """
    spark.dataSource.register(TopicLog)
    given = kafka_options(folder, **options)
    if max_batch:
        given["maxOffsetsPerTrigger"] = str(max_batch)
    rows = spark.readStream.format("topic_log").options(**given).load()
    return rows.filter(F.col("key") == key) if key else rows

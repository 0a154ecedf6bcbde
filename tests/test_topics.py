"""The listener on a topic folder: offsets, bounded batches, restarts and crashes."""

import pytest
from pyspark.sql import functions as F

from sluice.sources.topics import TopicReader, publish, topic_receive


def messages(spark, low, high, keys=3):
    return spark.range(low, high).select(F.col("id").alias("n"), F.concat(F.lit("k"), F.col("id") % keys).alias("key"), F.col("id").cast("string").alias("value"))


def send(spark, folder, low, high, **how):
    publish(messages(spark, low, high), folder, "t", "key", "value", ["n"], F.col("n") % 2, **how)


def reader(folder, **options):
    return TopicReader({"kafka.bootstrap.servers": folder, "subscribe": "t", "startingOffsets": "earliest", **options})


def test_offsets_continue_without_gaps(spark, tmp_path):
    folder = str(tmp_path / "topic")
    send(spark, folder, 0, 21)
    send(spark, folder, 21, 40)
    rows = spark.read.parquet(f"{folder}/topic=t").collect()
    for p in (0, 1):
        mine = sorted((r.offset, int(r.value)) for r in rows if r.partition == p)
        assert mine == list(enumerate(n for n in range(40) if n % 2 == p))
    assert reader(folder)._ends() == {"0": 20, "1": 20}


def test_batches_by_count_and_by_time(spark, tmp_path, monkeypatch):
    folder, now = str(tmp_path / "topic"), [100.0]
    monkeypatch.setattr("sluice.sources.topics.time.monotonic", lambda: now[0])
    send(spark, folder, 0, 10)
    r = reader(folder, **{"minOffsetsPerTrigger": "30", "maxTriggerDelay": "1000ms", "maxOffsetsPerTrigger": "16", "kafka.group.id": "g"})
    assert r.initialOffset() == {} == r.latestOffset()
    now[0] += 0.9
    assert r.latestOffset() == {}
    now[0] += 0.2  # the first message has waited long enough
    assert r.latestOffset() == {"0": 5, "1": 5} == r.latestOffset()
    assert sum(p.high - p.low for p in r.partitions({}, {"0": 5, "1": 5})) == 10
    assert r.latestOffset() == {"0": 5, "1": 5}
    send(spark, folder, 10, 60)
    assert r.latestOffset() == {"0": 13, "1": 13}  # enough messages, but a batch is bounded
    again = reader(folder, **{"maxOffsetsPerTrigger": "16", "kafka.group.id": "g"})
    assert again.latestOffset() == {"0": 13, "1": 13}  # the group's note tells where it stands
    assert reader(folder, **{"maxOffsetsPerTrigger": "16"}).latestOffset() == {"0": 30, "1": 30}
    assert reader(folder, startingOffsets='{"1": 7}').initialOffset() == {"1": 7}
    assert reader(folder, startingOffsets="latest").initialOffset() == {"0": 30, "1": 30}


def test_a_file_behind_a_gap_waits(spark, tmp_path):
    folder = str(tmp_path / "topic")
    send(spark, folder, 0, 10)
    part = spark.createDataFrame([("k", "late", None, 9, 0)], "key string, value string, timestamp timestamp, offset long, partition int")
    part.write.mode("append").partitionBy("partition").parquet(f"{folder}/topic=t")
    assert reader(folder)._ends() == {"0": 5, "1": 5}
    assert reader(str(tmp_path / "nothing"))._ends() == {}


@pytest.mark.parametrize("step", [1, 7])
def test_restart_at_every_offset_with_crashes(spark, tmp_path, step):
    """Each run takes one batch; every second run dies after its sink has the batch, so the batch is read again."""
    folder, progress = str(tmp_path / "topic"), str(tmp_path / "progress")
    n = 12 if step == 1 else 40
    send(spark, folder, 0, n)
    seen, runs = {}, []

    def sink(batch, batch_id):
        rows = sorted((r.partition, r.offset, r.value) for r in batch.collect())
        assert seen.setdefault(batch_id, rows) == rows  # a batch that is run again has the same rows
        runs.append(batch_id)
        if len(runs) % 2:
            raise RuntimeError("crash")

    for _ in range(2 * n):
        feed = topic_receive(spark, folder, topic="t", group="g", starting="earliest", max_batch=step)
        query = feed.writeStream.foreachBatch(sink).option("checkpointLocation", progress).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            if not any(p["numInputRows"] for p in query.recentProgress):
                break
        except Exception as error:
            assert "crash" in str(error)
    rows = [r for batch in seen.values() for r in batch]
    assert sorted(rows) == sorted((v % 2, v // 2, str(v)) for v in range(n))
    assert all(len(batch) <= step for batch in seen.values()) and len(runs) > len(seen)


def test_columns_and_key(spark, tmp_path):
    folder = str(tmp_path / "topic")
    publish(messages(spark, 0, 30), folder, "t", "key", "value", ["n"], partitions=4)
    feed = topic_receive(spark, folder, key="k1", topic="t", starting="earliest")
    assert feed.columns == ["key", "value", "topic", "partition", "offset", "timestamp"]
    out = str(tmp_path / "out")
    feed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(int(r.value) for r in rows) == list(range(1, 30, 3)) and len({r.partition for r in rows}) == 1 and rows[0].timestamp is not None

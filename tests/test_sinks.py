import json
import threading

import pytest
from pyspark.sql import functions as F

from sluice.sinks import fan_out, jdbc_write_options, kafka_payload, with_retry, write_batch, write_table


def test_write_batch_replaces_only_itself(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    write_batch(spark.range(3), path, 0)
    write_batch(spark.range(5), path, 1)
    write_batch(spark.range(2), path, 1)
    assert rows(spark.read.parquet(path).groupBy("batch_id").count()) == [(0, 3), (1, 2)]


def test_failed_batch_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    write_batch(spark.range(3), path, 0)
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="boom"):
        write_batch(bad, path, 1)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_write_table_formats(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    write_table(spark.range(3), {"format": kind, "path": path})
    write_table(spark.range(3), {"format": kind, "path": path})
    assert spark.read.format(kind).load(path).count() == 6


def test_jdbc_write_options():
    assert jdbc_write_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t", "batchsize": "1000"}


def test_fan_out_order_and_concurrency(spark):
    seen, barrier = [], threading.Barrier(2, timeout=60)

    def together(name):
        def sink(df):
            barrier.wait()  # both sinks of a group run at the same time
            seen.append((name, df.count()))
        return sink

    fan_out(spark.range(4), [[together("a"), together("b")], [lambda df: seen.append(("c", df.count()))]])
    assert sorted(seen[:2]) == [("a", 4), ("b", 4)] and seen[2] == ("c", 4)


def test_fan_out_stops_at_a_failed_group(spark):
    seen = []

    def broken(df):
        raise RuntimeError("sink down")

    with pytest.raises(RuntimeError, match="sink down"):
        fan_out(spark.range(1), [[broken, lambda df: seen.append(1)], [lambda df: seen.append(2)]])
    assert seen == [1]


def test_with_retry():
    calls, pauses, errors = [], [], []

    def step(n):
        calls.append(n)
        if len(calls) < 3:
            raise ValueError("again")
        return "done"

    assert with_retry(step, sleep=pauses.append, on_error=lambda a, e: errors.append(a))(7) == "done"
    assert calls == [7, 7, 7] and pauses == [1.0, 3.0] and errors == [1, 2]

    def never():
        raise ValueError("no")

    pauses.clear()
    with pytest.raises(ValueError):
        with_retry(never, attempts=6, sleep=pauses.append)()
    assert pauses == [1.0, 3.0, 9.0, 27.0, 60.0]


def test_kafka_payload(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "id int, name string")
    single = {r["key"]: json.loads(r["value"]) for r in kafka_payload(df, "t", "id").collect()}
    assert single["2"] == {"id": 2, "name": "b"} and single["1"] == {"id": 1}
    groups = kafka_payload(df, "t", "k", 2, ["id"]).collect()
    assert sorted(len(json.loads(r["value"])) for r in groups) == [1, 2]
    assert [x["id"] for r in sorted(groups, key=lambda r: r["value"]) for x in json.loads(r["value"])] == [1, 2, 3]
    assert kafka_payload(df, "t").first()["key"] is None

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from sluice import plans
from sluice.operators.monitor import alarm_statistics_stream, flow_series_stream
from sluice.plans import writes
from sluice.sinks import KeyedTable
from sluice.streaming import (
    ProgressLog, append_progress, clean_save_points, component_metrics, dedupe_messages, dedupe_stream, micro_batch, observe_rows, rate_limit,
    resolve_start, run_changes, save_point,
)

T0 = datetime(2024, 1, 1)


def accepted(messages, hold):
    """Replay of a listener: a message is taken if its id is not held."""
    until, taken = {}, []
    for key, at, n in sorted(messages, key=lambda m: (m[1], m[2])):
        if key not in until or at >= until[key]:
            until[key] = at + hold
            taken.append((key, at, n))
    return sorted(taken)


def test_dedupe_equals_replay_with_a_hot_id(spark):
    rng = random.Random(1)
    messages = [(rng.choice(["hot", "hot", "a", "b", f"k{i}"]), T0 + timedelta(minutes=rng.randrange(500)), i) for i in range(600)]
    df = spark.createDataFrame(messages, "id string, at timestamp_ntz, n int")
    out = dedupe_messages(df, ["id"], "at", "n", 60)
    assert sorted(tuple(r) for r in out.collect()) == accepted(messages, timedelta(minutes=60))


def test_dedupe_bound_and_late_rows(spark):
    rows = [("a", T0, 1), ("a", T0 + timedelta(minutes=59), 2), ("a", T0 + timedelta(minutes=60), 3), ("a", T0 - timedelta(days=9), 4)]
    df = spark.createDataFrame(rows, "id string, at timestamp_ntz, n int")
    assert sorted(r["n"] for r in dedupe_messages(df, ["id"], "at", "n", 60).collect()) == [1, 3, 4]


def test_dedupe_needs_a_hold_time(spark):
    with pytest.raises(ValueError):
        dedupe_messages(spark.createDataFrame([("a", T0, 1)], "id string, at timestamp_ntz, n int"), ["id"], "at", "n", 0)


def wait_for(query, path, spark, n, seconds=90):
    for _ in range(seconds):
        time.sleep(1)
        if query.exception():
            raise query.exception()
        try:
            if spark.read.parquet(path).count() >= n:
                return
        except Exception:  # nothing written yet
            continue


def test_dedupe_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "id string, n int"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema).write.parquet(src)
    stream = dedupe_stream(spark.readStream.schema(schema).parquet(src), ["id"], timedelta(hours=1))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
    try:
        wait_for(query, out, spark, 2)
        spark.createDataFrame([("b", 3), ("c", 4)], schema).write.mode("append").parquet(src)
        wait_for(query, out, spark, 3)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_run_changes_restarts_from_the_checkpoint(spark, rows, tmp_path):
    src, path, checkpoint = (str(tmp_path / n) for n in ("src", "table", "cp"))
    table = KeyedTable(path, "id bigint, v string", ("id",), 4)
    schema = "seq long, topic string, value string"

    def feed(*events):
        spark.createDataFrame([(s, "p.s.t", json.dumps(v)) for s, v in events], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        run_changes(spark.readStream.schema(schema).parquet(src), "id bigint, v string", table, checkpoint).awaitTermination()

    table.replace(spark.createDataFrame([(1, "base"), (2, "base")], "id bigint, v string"))
    feed((2, {"op": "u", "after": {"id": 1, "v": "second"}}), (1, {"op": "u", "after": {"id": 1, "v": "first"}}), (3, {"ts_ms": 1}))
    run()
    assert rows(table.read(spark)) == [(1, "second"), (2, "base")]
    run()  # nothing new
    feed((4, {"op": "d", "before": {"id": 2, "v": "base"}}), (5, {"op": "c", "after": {"id": 3, "v": "new"}}))
    run()
    assert rows(table.read(spark)) == [(1, "second"), (3, "new")]


def test_restarted_feed_is_written_by_many_tasks(spark, plan, monkeypatch):
    folder, feeds = "/root/testdata/sf0.001", []
    if not os.path.isdir(folder):
        pytest.skip("given tables are not here")
    feed = writes._stream_of
    monkeypatch.setattr(writes, "_stream_of", lambda t, df, *given, **options: feeds.append(df) or feed(t, df, *given, **options))
    plans.queries()["stream_restart_new_checkpoint"](spark, folder)
    for df in feeds:
        assert df.rdd.getNumPartitions() > 1 and "Sort" not in plan(df)


def test_streams_of_changes_bound_their_scans(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    schema = "seq long, topic string, value string"
    table = KeyedTable(str(tmp_path / "table"), "id bigint, v string", ("id",), 4)
    table.replace(spark.createDataFrame([(1, "base")], "id bigint, v string"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "src"))
    try:
        for given, kept in ((None, "32m"), ("64m", "64m")):
            spark.conf.set(key, given) if given else spark.conf.unset(key)
            run_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), "id bigint, v string", table,
                        str(tmp_path / f"cp{kept}")).awaitTermination()
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.unset(key)


def test_windowed_streams_close_windows_by_watermark(spark, rows, tmp_path):
    path = str(tmp_path / "src")
    schema = "ts timestamp_ntz, flow int, component string, rows long, cost double, error boolean"
    data = [(T0 + timedelta(minutes=m), 1, "c", 10, 1.5, m == 0) for m in (0, 1, 30, 61, 200)]
    spark.createDataFrame(data, schema).write.parquet(path)
    series = flow_series_stream(spark.readStream.schema(schema).parquet(path), 3600, "10 minutes")
    query = series.writeStream.format("memory").queryName("series").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("series"), "bucket", "total", "errors") == [(T0, 30, 1), (T0 + timedelta(hours=1), 10, 0)]


def test_alarm_statistics_stream(spark, rows, tmp_path):
    path = str(tmp_path / "src")
    schema = "workspace string, status string, create_time timestamp_ntz"
    spark.createDataFrame([("w", s, T0 + timedelta(minutes=m)) for s, m in [("SUCCESS", 0), ("FAILED", 0), ("SILENT", 1), ("SUCCESS", 90)]], schema).write.parquet(path)
    stats = alarm_statistics_stream(spark.readStream.schema(schema).parquet(path), "minute")
    stats.writeStream.format("memory").queryName("stats").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("stats"), "success", "failed", "silent") == [(0, 0, 1), (1, 1, 0)]


def test_micro_batch_options_and_rate_limit(spark, tmp_path):
    assert micro_batch("kafka", 100, 500) == {"minOffsetsPerTrigger": "100", "maxOffsetsPerTrigger": "100", "maxTriggerDelay": "500ms"}
    with pytest.raises(ValueError):
        micro_batch("paper", 1)
    src, sizes, began = str(tmp_path / "src"), [], []
    spark.range(40).repartition(4).write.parquet(src)
    stream = spark.readStream.schema("id long").options(**micro_batch("files", 1)).parquet(src)

    def sink(batch, batch_id):
        began.append(time.time())
        sizes.append(batch.count())

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp"))
    query = rate_limit(writer, 2, 2000).start()  # one batch per second
    query.processAllAvailable()
    query.stop()
    assert sum(sizes) == 40 and len(sizes) == 4
    assert began[-1] - began[0] >= 2.0
    assert rate_limit(writer, None) is writer


def test_resolve_start(spark, rows):
    points = spark.createDataFrame([("a", 1, "p1", "v1"), ("a", 2, "p2", "v2")], "flow string, id long, name string, value string")
    flows = spark.createDataFrame([
        ("a", "AUTO", None), ("a", "STOCK_AND_INCREASE", None), ("a", "CUSTOM", "p1"), ("a", "CUSTOM", "zz"),
    ], "flow string, strategy string, save_point string")
    for row, wanted in zip(flows.collect(), [("RESUME", "v2"), ("SCRATCH", None), ("RESUME", "v1"), ("ERROR", None)]):
        got = resolve_start(spark.createDataFrame([row], flows.schema), points, ["flow"]).first()
        assert (got["start"], got["value"]) == wanted
    none = spark.createDataFrame([("b", "LAST_STORAGE", None), ("c", "AUTO", None)], flows.schema)
    assert rows(resolve_start(none, points, ["flow"]), "flow", "start") == [("b", "ERROR"), ("c", "SCRATCH")]


def test_save_points(spark, tmp_path):
    path = str(tmp_path / "points")
    for batch in (0, 1):
        save_point(spark, path, "w", "f", "c", f'{{"offset":{batch}}}', batch, T0 + timedelta(days=batch), 3)
    points = spark.read.parquet(path)
    assert points.select("name").distinct().count() == 2
    assert [r["id"] for r in clean_save_points(points, T0 + timedelta(days=3, seconds=1)).collect()] == [1]


def test_metrics(spark, rows, tmp_path):
    metrics = spark.createDataFrame([("f", "c", "p", 5, 1.5, False), ("f", "c", "p", 6, 2.5, True), ("f", "c", None, 1, 1.0, False)],
                                    "flow string, component string, parent string, rows long, cost double, error boolean")
    assert rows(component_metrics(metrics), "parent", "calls", "rows", "errors") == [(None, 1, 1, 0), ("p", 2, 11, 1)]
    spark.range(10).write.parquet(str(tmp_path / "src"))
    log = ProgressLog()
    stored = ProgressLog(append_progress(spark, str(tmp_path / "progress")))
    spark.streams.addListener(log)
    spark.streams.addListener(stored)
    try:
        stream = observe_rows(spark.readStream.schema("id long").parquet(str(tmp_path / "src")), "reader", "id > 6")
        stream.writeStream.format("noop").queryName("watched").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if any(e["observed"] for e in log.entries):
                break
            time.sleep(0.2)
    finally:
        time.sleep(2)
        spark.streams.removeListener(log)
        spark.streams.removeListener(stored)
    assert spark.read.parquet(str(tmp_path / "progress")).filter("query = 'watched'").count() == len(log.entries)
    assert not stored.entries
    assert {"rows": 10, "errors": 3} in [e["observed"].get("reader") for e in log.entries]


def test_listeners_of_a_flow_start_apart(spark, rows):
    points = spark.createDataFrame([("w", "f", "one", 1, "p", "v1"), ("w", "f", "two", 2, "p", "v2")],
                                   "workspace string, flow string, component string, id long, name string, value string")
    flows = spark.createDataFrame([("w", "f", "one", "AUTO", None), ("w", "f", "two", "AUTO", None), ("x", "f", "two", "AUTO", None)],
                                  "workspace string, flow string, component string, strategy string, save_point string")
    assert rows(resolve_start(flows, points), "workspace", "component", "value") == [("w", "one", "v1"), ("w", "two", "v2"), ("x", "two", None)]


def test_rate_is_rounded_up():
    class Writer:
        def trigger(self, processingTime):
            self.every = processingTime
            return self

    assert rate_limit(Writer(), 300, 1000).every == "4 milliseconds"


def test_dedupe_in_few_rounds(spark, monkeypatch):
    """Fifty accepted copies of one message, repeated moments and a null key, against a plain loop."""
    from sluice.streaming import dedupe

    rng = random.Random(3)
    rows = [(k, T0 + timedelta(seconds=rng.randint(0, 60 * 120)), n) for k in ("a", None) for n in range(400)]
    rows += [("b", T0, 1), ("b", T0, 0), ("b", T0 + timedelta(minutes=2), 5), ("c", T0, 9)]
    wanted = []
    for key in ("a", "b", "c", None):
        until = None
        for _, at, n in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if until is None or at >= until:
                wanted.append((key, at, n))
                until = at + timedelta(minutes=2)
    writes, plain = [], dedupe.stage
    monkeypatch.setattr(dedupe, "stage", lambda df, label: writes.append(label) or plain(df, label))
    got = dedupe_messages(spark.createDataFrame(rows, "k string, at timestamp_ntz, n int"), ["k"], "at", "n", 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert sum(w[0] == "a" for w in wanted) > 40 and writes.count("accepted") <= 12

"""Registered queries: keyed writes, sinks, messages and streams."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, functions as F

from ..operators.align import align_content
from ..operators.folds import Statement, read_modify_write
from ..operators.upserts import apply_changes, custom_write, delete_rows, update_rows, upsert
from ..session import staging_path
from ..sinks import KeyedTable, fan_out, kafka_payload, with_retry, write_batch, write_table
from ..sources.tables import TASK_ROWS
from ..streaming import (
    clean_save_points, component_metrics, dedupe_messages, micro_batch, rate_limit, resolve_start, run_changes,
    save_point,
)
from ..operators.monitor import flow_series_stream
from .fixtures import Inputs
from .sources import IMAGE

KEYS = ["key"]


def change_images(changes: DataFrame) -> DataFrame:
    """Flat changes with their images: a DELETE has only the state before, the others only the state after."""
    image = F.struct("key", "amount", "note")
    deleted = F.col("op") == "DELETE"
    return changes.select("seq", "op", F.when(deleted, image).alias("before"), F.when(~deleted, image).alias("after"))


def _flagship(t: Inputs):
    base = t["base_state"]
    return align_content(base, apply_changes(base, change_images(t["changes"]), KEYS), KEYS)


def _of_kind(t: Inputs, op: str) -> DataFrame:
    return t["changes"].filter(F.col("op") == op)


TEMPLATES = {
    "INSERT": {"key": "${key}", "amount": "${amount}"},
    "UPDATE": {"amount": "${Amount} * 2"},
    "DELETE": {"note": "concat('deleted by ', cast(${key} AS STRING))"},
}


# values that read the old row: an insert of a known key counts down, an update counts up
COUNTING = {
    "INSERT": Statement({"n": "old.n - ${n}"}, insert=True),
    "UPDATE": {"n": "old.n + ${n}", "peak": "greatest(old.peak, ${Peak})", "first": "coalesce(old.first, ${first})"},
}
# each value depends on the one before it and on a condition over the old row
CHAINED = {"UPDATE": Statement({"n": "(old.n * 3 + ${n}) % 1000003", "peak": "old.n"}, when="old.peak < ${peak}")}


def _write_table(t: Inputs):
    path = staging_path(t.spark, "written")
    for batch_id in (0, 1, 1):  # the repeated batch replaces itself
        write_batch(t["orders"], path, batch_id)
    return t.spark.read.parquet(path)


def _fan_out(t: Inputs):
    """Rows of three sinks; ``earlier`` are the sinks that had ended when this one started."""
    paths, ended, seen = [staging_path(t.spark, f"sink{i}") for i in range(3)], set(), {}

    def sink(i: int, batch: DataFrame) -> None:
        seen[i] = len(ended) if i == 2 else 0
        write_table(batch, {"format": "parquet", "path": paths[i]})
        ended.add(i)

    fan_out(t["events"], [[partial(sink, 0), partial(sink, 1)], [partial(sink, 2)]])
    first, second, third = [
        t.spark.read.parquet(p).withColumns({"sink": F.lit(i), "earlier": F.lit(seen[i])}) for i, p in enumerate(paths)
    ]
    return first.unionByName(second).unionByName(third)


def _with_retry(t: Inputs):
    """A write whose first attempt fails after it has written; ``attempts`` tells how many it took."""
    path, attempts = staging_path(t.spark, "retried"), []

    def write(df: DataFrame) -> None:
        attempts.append(len(attempts))
        write_table(df, {"format": "parquet", "path": path}, "overwrite")
        if len(attempts) == 1:
            raise OSError("injected")

    with_retry(write, wait=0.0)(t["customer"])
    return t.spark.read.parquet(path).withColumn("attempts", F.lit(len(attempts)))


def _stream_of(t: Inputs, df: DataFrame, most: int = 0, **options: str) -> DataFrame:
    """A table as a stream of files, of ``most`` rows if given."""
    path = staging_path(t.spark, "feed")
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return t.spark.readStream.schema(df.schema).options(**options).parquet(path)


def _keyed(t: Inputs, buckets: int) -> KeyedTable:
    """The base state as a keyed table."""
    table = KeyedTable(staging_path(t.spark, "target"), t["base_state"].schema, tuple(KEYS), buckets)
    table.replace(t["base_state"])
    return table


def _stream_changes(t: Inputs):
    table = _keyed(t, 1)
    run_changes(_stream_of(t, t["envelopes"], TASK_ROWS), IMAGE, table, staging_path(t.spark, "progress")).awaitTermination()
    return table.read(t.spark)


def _restart_new_checkpoint(t: Inputs):
    """Two halves of the changes, the second as a new run whose batches count from 0 again."""
    table = _keyed(t, 8)
    for half in (0, 1):
        part = t["envelopes"].filter(F.col("seq") < 300 if half == 0 else F.col("seq") >= 300)
        run_changes(_stream_of(t, part, TASK_ROWS), IMAGE, table, staging_path(t.spark, "progress")).awaitTermination()
    return table.read(t.spark)


def _resume_from_stream(t: Inputs):
    """Save points written by a stream after each of its batches, and where its listener would start again."""
    table, points = _keyed(t, 4), staging_path(t.spark, "points")

    def note(spark, batch_id: int) -> None:
        save_point(spark, points, "ws1", "f", "listener", f"batch {batch_id}", batch_id, datetime(2024, 1, 15), 3)

    feed = _stream_of(t, t["envelopes"].repartition(3), **micro_batch("files", 1))
    run_changes(feed, IMAGE, table, staging_path(t.spark, "progress"), after_batch=note).awaitTermination()
    flows = t.spark.createDataFrame(
        [("ws1", "f", "listener", "AUTO", None), ("ws1", "f", "other", "LAST_STORAGE", None)],
        "workspace string, flow string, component string, strategy string, save_point string")
    return resolve_start(flows, t.spark.read.parquet(points))


def _batches(t: Inputs, df: DataFrame, limit: int | None, **options: str) -> DataFrame:
    path = staging_path(t.spark, "batches")
    feed = _stream_of(t, df, **options)
    writer = feed.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id)).option(
        "checkpointLocation", staging_path(t.spark, "progress")
    )
    if limit:
        query = rate_limit(writer, limit).start()
        query.processAllAvailable()
        query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(path)
    return rows.drop("batch_id").withColumn("batches", F.lit(rows.select("batch_id").distinct().count()))


def _stream_flow_series(t: Inputs):
    path = staging_path(t.spark, "series")
    series = flow_series_stream(_stream_of(t, t["metrics"]), 86_400, "1 day")
    (
        series.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", staging_path(t.spark, "progress"))
        .trigger(availableNow=True).start(path).awaitTermination()
    )
    return t.spark.read.schema(series.schema).parquet(path).select(
        "flow", "bucket", "total", F.col("rate").cast("double").alias("rate"), F.col("avg_cost").cast("double").alias("avg_cost"),
        "errors",
    )


QUERIES = {
    "flagship": _flagship,
    "c1_upsert": lambda t: upsert(t["base_state"], _of_kind(t, "INSERT").drop("op"), KEYS, "seq"),
    "c2_update_rows": lambda t: update_rows(t["base_state"], _of_kind(t, "UPDATE").drop("op", "note"), KEYS, "seq"),
    "c3_delete_rows": lambda t: delete_rows(t["base_state"], change_images(_of_kind(t, "DELETE")), KEYS, "before"),
    "c4_apply_changes": lambda t: apply_changes(t["base_state"], change_images(t["changes"]), KEYS),
    "c5_custom_write": lambda t: custom_write(t["base_state"], t["changes"], TEMPLATES, KEYS),
    "c5_read_modify_write": lambda t: read_modify_write(t["counters"], t["counter_changes"], COUNTING, KEYS),
    "c5_ordered_fold": lambda t: read_modify_write(t["counters"], t["counter_changes"], CHAINED, KEYS),
    "c6_write_table": _write_table,
    "c7_fan_out": _fan_out,
    "c8_kafka_send": lambda t: kafka_payload(t["events"].select("event_id", "user_id", "event_type", "value"), "events", "user_id"),
    "c8_kafka_send_split": lambda t: kafka_payload(
        t["orders"].select("o_orderkey", "o_orderstatus"), "orders", "all", 100, ["o_orderkey"]
    ),
    "c9_with_retry": _with_retry,
    "d1_dedupe_messages": lambda t: dedupe_messages(t["messages"], ["scope", "id"], "arrival", "n"),
    "d2_micro_batch": lambda t: _batches(t, t["events"].repartition(4), None, **micro_batch("files", 2)),
    "d3_rate_limit": lambda t: _batches(t, t["orders"].repartition(4), 100, **micro_batch("files", 1)),
    "d4_resolve_start": lambda t: resolve_start(t["flow_starts"], t["save_points"]),
    "d5_save_points": _resume_from_stream,
    "d5_clean_save_points": lambda t: clean_save_points(t["save_points"], "2024-01-15 12:00:00"),
    "d6_small_costs": lambda t: component_metrics(t["metrics"].withColumn("cost", F.lit(0.004))).withColumn("cost", F.col("cost").cast("double")),
    "d6_component_metrics": lambda t: component_metrics(t["metrics"]).withColumn("cost", F.col("cost").cast("double")),
    "stream_apply_changes": _stream_changes,
    "stream_restart_new_checkpoint": _restart_new_checkpoint,
    "stream_flow_series": _stream_flow_series,
}

# last event and last event that is not an update, per key
_LAST = """
    last_event AS (
        SELECT * FROM {changes} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
    last_reset AS (
        SELECT key, op AS reset FROM {changes} WHERE op <> 'UPDATE'
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
    state AS (
        SELECT coalesce(b.key, e.key) AS key,
               CASE WHEN e.key IS NULL THEN b.amount ELSE e.amount END AS amount,
               CASE WHEN e.key IS NULL THEN b.note ELSE e.note END AS note,
               CASE WHEN e.key IS NULL THEN true WHEN r.reset = 'INSERT' THEN true WHEN r.reset = 'DELETE' THEN false
                    ELSE b.key IS NOT NULL END AS present
        FROM base_state b FULL JOIN last_event e ON b.key = e.key LEFT JOIN last_reset r ON r.key = e.key)"""

_KEPT_CHANGES = """
    kept AS (
        SELECT c.* FROM changes c JOIN events ON seq = event_id
        WHERE NOT (event_type IN ('click', 'purchase') AND event_id % 10 = 0))"""

_SET = """
    (SELECT key, max(seq) AS last_seq, arg_max(op, seq) AS last_op, arg_max(amount, seq) AS last_amount
     FROM changes WHERE op IN ({ops}) GROUP BY key)"""

# a row per key and change, each from the one before; {steps} gives n, peak, first and present after a change
_REPLAYED = """
    WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM counter_changes),
    starts AS (
        SELECT coalesce(t.key, c.key) AS key, t.n, t.peak, t.first, t.key IS NOT NULL AS present
        FROM counters t FULL JOIN (SELECT DISTINCT key FROM counter_changes) c ON c.key = t.key),
    walk AS (
        SELECT key, cast(0 AS BIGINT) AS rn, n, peak, first, present FROM starts
        UNION ALL
        SELECT w.key, c.rn, {steps} FROM walk w JOIN numbered c ON c.key = w.key AND c.rn = w.rn + 1)
    SELECT key, n, peak, first FROM walk WHERE present AND rn = (SELECT count(*) FROM counter_changes c WHERE c.key = walk.key)"""

ORACLES = {
    "c5_read_modify_write": _REPLAYED.format(steps="""
        CASE WHEN c.op = 'INSERT' THEN CASE WHEN w.present THEN w.n - c.n ELSE c.n END WHEN c.op = 'UPDATE' THEN w.n + c.n ELSE w.n END,
        CASE WHEN c.op = 'INSERT' AND NOT w.present THEN c.peak WHEN c.op = 'UPDATE' THEN greatest(w.peak, c.peak) ELSE w.peak END,
        CASE WHEN c.op = 'INSERT' AND NOT w.present THEN c.first WHEN c.op = 'UPDATE' THEN coalesce(w.first, c.first) ELSE w.first END,
        CASE c.op WHEN 'INSERT' THEN true WHEN 'DELETE' THEN false ELSE w.present END"""),
    "c5_ordered_fold": _REPLAYED.format(steps="""
        CASE WHEN c.op = 'INSERT' THEN c.n WHEN c.op = 'UPDATE' AND w.peak < c.peak THEN (w.n * 3 + c.n) % 1000003 ELSE w.n END,
        CASE WHEN c.op = 'INSERT' THEN c.peak WHEN c.op = 'UPDATE' AND w.peak < c.peak THEN w.n ELSE w.peak END,
        CASE WHEN c.op = 'INSERT' THEN c.first ELSE w.first END,
        CASE c.op WHEN 'INSERT' THEN true WHEN 'DELETE' THEN false ELSE w.present END"""),
    "flagship": f"""
        WITH {_LAST.format(changes='changes')}
        SELECT coalesce(b.key, s.key) AS key,
               CASE WHEN s.key IS NULL THEN 'LEFT_ONLY' WHEN b.key IS NULL THEN 'RIGHT_ONLY' ELSE 'DIFFERENT' END AS status
        FROM base_state b FULL JOIN (SELECT * FROM state WHERE present) s ON b.key = s.key
        WHERE b.key IS NULL OR s.key IS NULL OR b.amount IS DISTINCT FROM s.amount OR b.note IS DISTINCT FROM s.note""",
    "c1_upsert": """
        WITH new_rows AS (
            SELECT * FROM changes WHERE op = 'INSERT' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
        SELECT key, amount, note FROM new_rows
        UNION ALL
        SELECT * FROM base_state WHERE key NOT IN (SELECT key FROM new_rows)""",
    "c2_update_rows": """
        WITH new_rows AS (
            SELECT * FROM changes WHERE op = 'UPDATE' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
        SELECT b.key, CASE WHEN n.key IS NULL THEN b.amount ELSE n.amount END AS amount,
               CASE WHEN n.key IS NULL THEN b.note END AS note
        FROM base_state b LEFT JOIN new_rows n ON b.key = n.key""",
    "c3_delete_rows": """
        SELECT * FROM base_state WHERE NOT EXISTS (SELECT 1 FROM changes WHERE op = 'DELETE' AND changes.key = base_state.key)""",
    "c4_apply_changes": f"WITH {_LAST.format(changes='changes')} SELECT key, amount, note FROM state WHERE present",
    "c5_custom_write": f"""
        WITH inserted AS {_SET.format(ops="'INSERT'")}, valued AS {_SET.format(ops="'INSERT', 'UPDATE'")},
        noted AS {_SET.format(ops="'INSERT', 'DELETE'")}
        SELECT coalesce(b.key, i.key) AS key,
               CASE WHEN v.key IS NULL THEN b.amount WHEN v.last_op = 'UPDATE' THEN v.last_amount * 2 ELSE v.last_amount END
               AS amount,
               CASE WHEN n.key IS NULL THEN b.note WHEN n.last_op = 'DELETE' THEN 'deleted by ' || cast(n.key AS STRING) END
               AS note
        FROM base_state b FULL JOIN inserted i ON b.key = i.key
        LEFT JOIN valued v ON v.key = coalesce(b.key, i.key) LEFT JOIN noted n ON n.key = coalesce(b.key, i.key)""",
    "c6_write_table": "SELECT * FROM orders, (VALUES (0), (1)) b(batch_id)",
    "c7_fan_out": "SELECT * FROM events, (VALUES (0, 0), (1, 0), (2, 2)) s(sink, earlier)",
    "c8_kafka_send": """
        SELECT 'events' AS topic, cast(user_id AS STRING) AS key,
               '{"event_id":' || cast(event_id AS STRING) || ',"user_id":' || cast(user_id AS STRING) || ',"event_type":"'
               || event_type || '","value":' || cast(value AS STRING) || '}' AS value
        FROM events""",
    "c8_kafka_send_split": """
        SELECT 'orders' AS topic, 'all' AS key, '[' || string_agg(j, ',' ORDER BY o_orderkey) || ']' AS value
        FROM (SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS page,
                     '{"o_orderkey":' || cast(o_orderkey AS STRING) || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j
              FROM orders)
        GROUP BY page""",
    "c9_with_retry": "SELECT *, 2 AS attempts FROM customer",
    "d1_dedupe_messages": """
        WITH RECURSIVE accepted AS (
            SELECT scope, id, min(arrival) AS arrival FROM messages GROUP BY scope, id
            UNION ALL
            SELECT m.scope, m.id, min(m.arrival) FROM accepted a
            JOIN messages m ON m.scope = a.scope AND m.id = a.id AND m.arrival >= a.arrival + interval '3600' minute
            GROUP BY m.scope, m.id, a.arrival)
        SELECT DISTINCT m.id, m.scope, m.arrival, m.n FROM messages m
        JOIN accepted a ON m.scope = a.scope AND m.id = a.id AND m.arrival = a.arrival""",
    "d2_micro_batch": "SELECT *, 2 AS batches FROM events",
    "d3_rate_limit": "SELECT *, 4 AS batches FROM orders",
    "d4_resolve_start": """
        WITH latest AS (SELECT workspace, flow, component, arg_max(value, id) AS v FROM save_points GROUP BY ALL),
        named AS (SELECT workspace, flow, component, name, arg_max(value, id) AS v FROM save_points GROUP BY ALL),
        found AS (
            SELECT f.*, CASE WHEN f.save_point IS NOT NULL THEN n.v WHEN f.strategy <> 'STOCK_AND_INCREASE' THEN l.v END AS value
            FROM flow_starts f LEFT JOIN latest l ON l.workspace = f.workspace AND l.flow = f.flow AND l.component = f.component
            LEFT JOIN named n ON n.workspace = f.workspace AND n.flow = f.flow AND n.component = f.component AND n.name = f.save_point)
        SELECT workspace, flow, component, strategy, save_point, value,
               CASE WHEN value IS NOT NULL THEN 'RESUME' WHEN save_point IS NOT NULL OR strategy = 'LAST_STORAGE' THEN 'ERROR'
                    ELSE 'SCRATCH' END AS start
        FROM found""",
    "d5_save_points": """
        SELECT * FROM (VALUES ('ws1', 'f', 'listener', 'AUTO', NULL, 'RESUME', 'batch 2'), ('ws1', 'f', 'other', 'LAST_STORAGE', NULL, 'ERROR', NULL))
        v(workspace, flow, component, strategy, save_point, start, value)""",
    "d5_clean_save_points": "SELECT * FROM save_points WHERE expire_time IS NULL OR expire_time >= timestamp '2024-01-15 12:00:00'",
    "d6_small_costs": """
        SELECT flow, component, parent, count(*) AS calls, cast(sum(rows) AS BIGINT) AS rows,
               cast(round(sum(cast(0.004 AS DECIMAL(28,8))), 2) AS DOUBLE) AS cost, cast(0.004 AS DOUBLE) AS max_cost,
               count(*) FILTER (WHERE error) AS errors
        FROM metrics GROUP BY flow, component, parent""",
    "d6_component_metrics": """
        SELECT flow, component, parent, count(*) AS calls, cast(sum(rows) AS BIGINT) AS rows,
               cast(round(sum(cast(cost AS DECIMAL(28,8))), 2) AS DOUBLE) AS cost, max(cost) AS max_cost,
               count(*) FILTER (WHERE error) AS errors
        FROM metrics GROUP BY flow, component, parent""",
    "stream_restart_new_checkpoint": f"""
        WITH {_KEPT_CHANGES}, {_LAST.format(changes='kept')} SELECT key, amount, note FROM state WHERE present""",
    "stream_apply_changes": f"""
        WITH {_KEPT_CHANGES}, {_LAST.format(changes='kept')} SELECT key, amount, note FROM state WHERE present""",
    # a day is closed once the newest row is a day past its end
    "stream_flow_series": """
        SELECT flow, date_trunc('day', ts)::TIMESTAMP AS bucket, cast(sum(rows) AS BIGINT) AS total,
               ((20000 * cast(sum(rows) AS BIGINT) + 86400) // (2 * 86400)) / 10000.0 AS rate,
               ((2 * cast(sum(cast(cost AS DECIMAL(28,8))) * 100000000 AS HUGEINT) + 1000000 * count(*)) // (2000000 * count(*))) / 100.0 AS avg_cost,
               count(*) FILTER (WHERE error) AS errors
        FROM metrics
        WHERE date_trunc('day', ts) + interval '1' day <= (SELECT max(ts) FROM metrics) - interval '1' day
        GROUP BY flow, date_trunc('day', ts)""",
}

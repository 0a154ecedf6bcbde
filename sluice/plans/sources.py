"""Registered queries: sources and paging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import staging_path
from ..sources import (
    assign_pages, bucket_count, deep_page_query, include_tables, page_query, parse_change_events, publish, read_shards, read_stream_query, scroll_pages,
    scroll_query, shard_route, snapshot_then_changes, sql_query, topic_receive, write_buckets, write_shards,
)
from .fixtures import Inputs

IMAGE = "key bigint, amount double, note string"

SEGMENT_TOTALS = """
    SELECT c_mktsegment, count(*) AS n_orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total
    FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_totalprice > {minimum}
    GROUP BY c_mktsegment"""

SCAN = "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate FROM {source}"


def _sql_query(t: Inputs):
    sources = {
        "customer": {"format": "parquet", "path": f"{t.folder}/customer.parquet"},
        "orders": {"format": "parquet", "path": f"{t.folder}/orders.parquet"},
    }
    return sql_query(t.spark, sources, SEGMENT_TOTALS.format(minimum=":minimum"), {"minimum": 1000.0})


def _read_stream_query(t: Inputs):
    return read_stream_query(t.spark, {"format": "parquet", "path": f"{t.folder}/lineitem.parquet"}, SCAN.format(source="source"))


def _flat_changes(df):
    return df.select(
        "seq", "src_schema", "src_table", "op", F.col("before.key").alias("before_key"),
        F.col("after.key").alias("after_key"), F.col("after.amount").alias("after_amount"), F.col("after.note").alias("after_note"),
    )


def _parse_change_events(t: Inputs):
    return _flat_changes(parse_change_events(t["envelopes"], IMAGE, ["CREATE", "UPDATE", "DELETE"]))


def _include_tables(t: Inputs):
    changes = parse_change_events(t["envelopes"], IMAGE)
    return _flat_changes(include_tables(changes, "shop", "shop.cust.*, shop.parts"))


def _snapshot_then_changes(t: Inputs):
    changes = parse_change_events(t["envelopes"], IMAGE)
    joined = snapshot_then_changes(t["base_state"], changes)
    return joined.select("seq", "op", F.col("after.key").alias("key"), F.col("after.amount").alias("amount"))


def _kafka_receive(t: Inputs):
    """Events published to a topic in two writes and received by a listener that is stopped and started again after every batch."""
    folder, seen, progress = (staging_path(t.spark, label) for label in ("topic", "received", "progress"))
    events = t["events"]
    half = events.count() // 2
    for part in (F.col("event_id") < half, F.col("event_id") >= half):
        publish(events.where(part), folder, "events", "event_type", "props", ["event_id"], F.col("event_id") % 3, timestamp="ts")
    while True:
        feed = topic_receive(t.spark, folder, "error", max_batch=half // 2 + 1, topic="events", group="errors", starting="earliest")
        query = feed.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(seen)
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            break
    return t.spark.read.schema(feed.schema).parquet(seen).select("key", "value", "topic", "partition", "offset")


def _shard_route(t: Inputs):
    keyed = t["events"].select("event_id", F.concat_ws("-", "event_type", "event_id").alias("id"))
    return shard_route(keyed, "id", 10, "idempotent_")


def _read_shards(t: Inputs):
    path = staging_path(t.spark, "shards")
    write_shards(t["customer"], path, "c_name", 4)
    return read_shards(t.spark, path).withColumn("shard", F.col("shard").cast("int"))


def _bucketed_join(t: Inputs):
    """Orders and lines kept by the same buckets, joined without an exchange, and the lines of one order from one bucket."""
    run, n = uuid.uuid4().hex, bucket_count(8, t["orders"], t["lineitem"])
    orders = write_buckets(t["orders"].select("o_orderkey", "o_orderpriority"), f"orders_{run}", "o_orderkey", n)
    lines = write_buckets(t["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), f"lines_{run}", "l_orderkey", n)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    one = lines.where("l_orderkey = 7").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit("one bucket").alias("o_orderpriority"), "l_partkey", "l_linenumber", "l_quantity")
    return joined.unionByName(one)


QUERIES = {
    "a1_sql_query": _sql_query,
    "a2_read_stream_query": _read_stream_query,
    "a3_page_query": lambda t: page_query(t["orders"], [F.desc("o_totalprice"), "o_orderkey"], page=3, size=100),
    "a3_deep_page": lambda t: deep_page_query(
        t["lineitem"], [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], page=41, size=100
    ),
    "a4_assign_pages": lambda t: assign_pages(t["orders"], [F.desc("o_totalprice"), "o_orderkey"], 500),
    "a5_scroll_query": lambda t: scroll_query(t["orders"], "O_ORDERKEY", 200, after=400),
    "a5_scroll_nulls": lambda t: scroll_query(t["events"].withColumn("k", F.expr("nullif(event_id, 7)")), "k", 400),
    "a5_scroll_pages_nulls": lambda t: scroll_pages(
        t["events"].withColumn("k", F.expr("CASE WHEN event_id % 3 > 0 THEN event_id END")), "k", 300, ["event_id"]
    ),
    "a5_scroll_pages": lambda t: scroll_pages(t["events"], "event_id", 300),
    "a6_parse_change_events": _parse_change_events,
    "a7_snapshot_then_changes": _snapshot_then_changes,
    "a8_include_tables": _include_tables,
    "a9_kafka_receive": _kafka_receive,
    "a11_bucketed_join": _bucketed_join,
    "a10_shard_route": _shard_route,
    "a11_read_shards": _read_shards,
}

_HASH = (
    "list_reduce(list_prepend(cast(0 AS BIGINT), list_transform(string_split({0}, ''), lambda c: cast(unicode(c) AS BIGINT))), "
    "lambda a, c: (a * 31 + c) % 4294967296)"
)
# the sign bit cleared, modulo the number of shards
_SHARD = "cast((" + _HASH + " % 2147483648) % {1} AS INTEGER)"

_PARSED = """
    SELECT event_id AS seq, {schema} AS src_schema, {table} AS src_table,
           CASE WHEN event_type IN ('signup', 'view') THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
           CASE WHEN event_type IN ('error', 'click') THEN user_id END AS before_key,
           CASE WHEN event_type <> 'error' THEN user_id END AS after_key,
           CASE WHEN event_type <> 'error' THEN value END AS after_amount,
           CASE WHEN event_type <> 'error' THEN props END AS after_note
    FROM events
    WHERE NOT (event_type IN ('click', 'purchase') AND event_id % 10 = 0) AND {more}"""

ORACLES = {
    "a1_sql_query": SEGMENT_TOTALS.format(minimum=1000.0),
    "a2_read_stream_query": SCAN.format(source="lineitem"),
    "a3_page_query": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200",
    "a3_deep_page": """
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS position FROM lineitem)
        WHERE position > 4000 AND position <= 4100""",
    "a4_assign_pages": """
        SELECT *, cast(floor((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) / 500) AS BIGINT) + 1 AS page_no
        FROM orders""",
    "a5_scroll_query": "SELECT * FROM orders WHERE o_orderkey > 400 ORDER BY o_orderkey LIMIT 200",
    "a5_scroll_nulls": "SELECT *, nullif(event_id, 7) AS k FROM events ORDER BY k NULLS FIRST LIMIT 400",
    "a5_scroll_pages_nulls": """
        SELECT *, cast(floor((row_number() OVER (ORDER BY k NULLS FIRST, event_id) - 1) / 300) AS BIGINT) + 1 AS page_no
        FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_id END AS k FROM events)""",
    "a5_scroll_pages": """
        SELECT *, cast(floor((row_number() OVER (ORDER BY event_id) - 1) / 300) AS BIGINT) + 1 AS page_no FROM events""",
    "a6_parse_change_events": _PARSED.format(
        schema="CASE event_type WHEN 'purchase' THEN 'crm' WHEN 'click' THEN NULL ELSE 'shop' END",
        table="CASE event_type WHEN 'view' THEN 'orders' WHEN 'click' THEN NULL ELSE 'customer' END",
        more="event_type <> 'view'",
    ),
    "a7_snapshot_then_changes": """
        SELECT -1 AS seq, 'INSERT' AS op, key, amount FROM base_state
        UNION ALL
        SELECT seq, op, CASE WHEN op <> 'DELETE' THEN key END AS key, CASE WHEN op <> 'DELETE' THEN amount END AS amount
        FROM changes JOIN events ON seq = event_id
        WHERE NOT (event_type IN ('click', 'purchase') AND event_id % 10 = 0)""",
    "a8_include_tables": _PARSED.format(
        schema="'shop'", table="'customer'", more="event_type IN ('signup', 'error')",
    ),
    "a11_bucketed_join": """
        SELECT o_orderkey, o_orderpriority, l_partkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        UNION ALL
        SELECT l_orderkey, 'one bucket', l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7""",
    "a9_kafka_receive": """
        SELECT * FROM (
            SELECT event_type AS key, props AS value, 'events' AS topic, cast(event_id % 3 AS INTEGER) AS partition,
                   row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS "offset"
            FROM events)
        WHERE key = 'error'""",
    "a10_shard_route": f"""
        SELECT event_id, id, {_SHARD.format('id', 10)} AS shard,
               'idempotent_' || cast({_SHARD.format('id', 10)} AS STRING) AS shard_table
        FROM (SELECT event_id, event_type || '-' || cast(event_id AS STRING) AS id FROM events)""",
    "a11_read_shards": f"SELECT *, {_SHARD.format('c_name', 4)} AS shard FROM customer",
}

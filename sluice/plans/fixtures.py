"""Inputs of the registered queries, derived from the given tables by one SQL text.

The text is valid in Spark SQL and in the checking engine; where the dialects differ an entry holds
both. Texts may use the tables and each other. Whole tables are used throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import load_tables, place_rows

# the given tables
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_ESCAPED_PROPS = "replace(props, '\"', chr(92) || '\"')"
_IMAGE = (
    "'{\"key\":' || cast(user_id AS STRING) || ',\"amount\":' || cast(value AS STRING) || ',\"note\":\"' || "
    + _ESCAPED_PROPS + " || '\"}'"
)

FIXTURES: dict[str, str | dict[str, str]] = {
    # ordered changes; a view counts as a row read by the initial snapshot
    "changes": """
        SELECT event_id AS seq, user_id AS key,
               CASE WHEN event_type IN ('signup', 'view') THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE'
                    ELSE 'UPDATE' END AS op,
               value AS amount, props AS note
        FROM events""",
    # half of the changed keys exist
    "base_state": "SELECT c_custkey * 2 AS key, c_acctbal AS amount, c_mktsegment AS note FROM customer",
    # whole numbers, whose sums have one value in any order
    "counters": "SELECT key, cast(floor(amount) AS BIGINT) AS n, cast(floor(amount) AS BIGINT) AS peak, note AS first FROM base_state",
    "counter_changes": """
        SELECT seq, key, op, cast(floor(amount) AS BIGINT) AS n, cast(floor(amount) AS BIGINT) AS peak, note AS first FROM changes""",
    "envelopes": f"""
        SELECT event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'p.shop.customer' WHEN 'view' THEN 'p.shop.orders'
                               WHEN 'purchase' THEN 'p.crm.customer' WHEN 'click' THEN 'p.shop'
                               ELSE 'p.shop.customer.extra' END AS topic,
               '{{"op":"' ||
               CASE WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'view' THEN 'r' WHEN event_type = 'error' THEN 'd'
                    WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'x' ELSE 'u' END ||
               '","before":' ||
               CASE WHEN event_type IN ('error', 'click') THEN {_IMAGE} ELSE 'null' END ||
               ',"after":' ||
               CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND event_id % 10 = 0) THEN 'null'
                    ELSE {_IMAGE} END ||
               ',"ts_ms":1}}' AS value
        FROM events
        UNION ALL
        SELECT event_id AS seq, 'heartbeat' AS topic, '{{"ts_ms":1}}' AS value FROM events WHERE event_type = 'error'""",
    "left_side": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    # missing, extra and changed rows
    "right_side": """
        SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderdate,
               CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    # every message twice more, one to six days later
    "messages": """
        SELECT 'm' || cast(event_id AS STRING) AS id, event_type AS scope, ts AS arrival, event_id AS n FROM events
        UNION ALL
        SELECT 'm' || cast(event_id AS STRING) AS id, event_type AS scope,
               ts + (1 + event_id % 4) * interval '1' day AS arrival, event_id AS n FROM events
        UNION ALL
        SELECT 'm' || cast(event_id AS STRING) AS id, event_type AS scope,
               ts + (3 + event_id % 4) * interval '1' day AS arrival, event_id AS n FROM events""",
    "save_points": """
        SELECT 'ws' || cast(user_id % 4 AS STRING) AS workspace, user_id AS flow, 'c' || cast(event_id % 2 AS STRING) AS component, event_id AS id, 'sp-' || cast(event_id % 50 AS STRING) AS name, props AS value,
               ts + interval '3' day AS expire_time
        FROM events""",
    "flow_starts": """
        SELECT 'ws' || cast(c_custkey % 4 AS STRING) AS workspace, c_custkey AS flow, 'c' || cast(c_nationkey % 3 AS STRING) AS component,
               CASE c_custkey % 5 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'LAST_STORAGE' WHEN 2 THEN 'STOCK_AND_INCREASE'
                                  WHEN 3 THEN 'CUSTOM' ELSE 'INCREASE' END AS strategy,
               CASE WHEN c_custkey % 5 = 3 THEN 'sp-' || cast(c_custkey % 60 AS STRING) END AS save_point
        FROM customer""",
    "metrics": """
        SELECT ts, user_id % 10 AS flow, event_type AS component,
               CASE WHEN event_type = 'click' THEN NULL ELSE 'source' END AS parent,
               event_id % 100 AS rows, value AS cost, event_type = 'error' AS error
        FROM events""",
    "op_log": """
        SELECT event_id AS id, 'ws' || cast(user_id % 4 AS STRING) AS workspace, user_id, event_type AS function,
               event_id % 40 AS record_id, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS status,
               props AS action, value AS cost, ts AS create_time
        FROM events""",
    "records": """
        SELECT p_partkey AS record_id, p_partkey % 7 AS creator, p_name AS name,
               'r' || cast(p_partkey AS STRING) AS code, p_size % 5 AS publish_version,
               CASE p_size % 4 WHEN 0 THEN 'ENABLE' WHEN 1 THEN 'PAUSE' WHEN 2 THEN 'TBP' ELSE 'OTHER' END AS status,
               p_retailprice AS price
        FROM part""",
    "versions": """
        SELECT 'r' || cast(p_partkey AS STRING) AS code, p_size % 3 AS version, p_brand AS published_as,
               CASE p_size % 2 WHEN 0 THEN 'ENABLE' ELSE 'HISTORY' END AS status
        FROM part""",
    "query_log": """
        SELECT o_orderpriority AS template, o_totalprice AS cost, o_orderkey % 50 AS number,
               o_orderkey % 3 = 0 AS hit_cache, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'SUCCESS' END AS status
        FROM orders""",
    # users hold a role per market segment, roles have permissions per brand
    "users": "SELECT c_custkey AS user_id, c_name AS username, c_nationkey AS team, c_mktsegment AS role FROM customer",
    "permissions": """
        SELECT p_partkey AS permission_id, p_brand AS permission, p_type AS permission_type, p_size % 2 AS enabled
        FROM part""",
    "role_permissions": """
        SELECT DISTINCT c_mktsegment AS link_role, l_partkey AS link_permission
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""",
    "inbox": """
        SELECT o_orderkey AS message_id, o_custkey AS user_id, o_orderpriority AS title,
               CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS is_read,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_urgent, o_orderdate AS create_time
        FROM orders""",
    "grants": """
        SELECT o_custkey AS user_id, 'FLOW' AS record_type, o_orderkey % 20 AS record_id,
               o_orderstatus = 'O' AS can_write, o_orderstatus = 'P' AS can_publish
        FROM orders""",
    # per order a graph: line n hangs below line n - 3, the first lines below the start node
    "edges": """
        SELECT DISTINCT l_orderkey AS design,
               'n' || cast(CASE WHEN l_linenumber > 3 THEN l_linenumber - 3 ELSE 0 END AS STRING) AS source,
               'n' || cast(l_linenumber AS STRING) AS target, l_linenumber % 2 AS ord
        FROM lineitem""",
    "nodes": """
        SELECT DISTINCT l_orderkey AS design, 'n' || cast(l_linenumber AS STRING) AS id,
               CASE l_linenumber WHEN 1 THEN 'queryMySQL' WHEN 2 THEN 'filter' WHEN 3 THEN 'map' WHEN 4 THEN 'writeMySQL'
                                 WHEN 5 THEN 'kafkaReceive' WHEN 6 THEN 'printLog' ELSE 'mystery' END AS type,
               'ds' || cast(l_linenumber % 4 AS STRING) AS datasource
        FROM lineitem
        UNION ALL
        SELECT DISTINCT l_orderkey AS design, 'n0' AS id, 'job' AS type, '' AS datasource FROM lineitem""",
    # the same graphs as documents; an order has at most seven line numbers
    "designs": {
        "spark": """
            SELECT n.design,
                   '{"nodes":[' || n.nodes || '],"edges":[' || e.edges || ']}' AS text, n.codes
            FROM (SELECT design,
                         array_join(sort_array(collect_list(node)), ',') AS nodes,
                         '[' || array_join(sort_array(collect_set(code)), ',') || ']' AS codes
                  FROM (SELECT design, '"' || datasource || '"' AS code,
                               '{"id":"' || id || '","type":"' || type || '","properties":{"datasourceCode":"'
                               || datasource || '"}}' AS node FROM nodes)
                  GROUP BY design) n
            JOIN (SELECT design,
                         array_join(sort_array(collect_list(edge)), ',') AS edges
                  FROM (SELECT design, '{"id":"' || source || target || '","sourceNodeId":"' || source || '","targetNodeId":"'
                               || target || '"' || CASE WHEN ord = 0 THEN '}' ELSE ',"properties":{"order":'
                               || cast(ord AS STRING) || '}}' END AS edge FROM edges)
                  GROUP BY design) e ON n.design = e.design""",
        "duckdb": """
            SELECT n.design,
                   '{"nodes":[' || n.nodes || '],"edges":[' || e.edges || ']}' AS text, n.codes
            FROM (SELECT design, string_agg(node, ',' ORDER BY node) AS nodes,
                         '[' || string_agg(DISTINCT code, ',' ORDER BY code) || ']' AS codes
                  FROM (SELECT design, '"' || datasource || '"' AS code,
                               '{"id":"' || id || '","type":"' || type || '","properties":{"datasourceCode":"'
                               || datasource || '"}}' AS node FROM nodes)
                  GROUP BY design) n
            JOIN (SELECT design, string_agg(edge, ',' ORDER BY edge) AS edges
                  FROM (SELECT design, '{"id":"' || source || target || '","sourceNodeId":"' || source || '","targetNodeId":"'
                               || target || '"' || CASE WHEN ord = 0 THEN '}' ELSE ',"properties":{"order":'
                               || cast(ord AS STRING) || '}}' END AS edge FROM edges)
                  GROUP BY design) e ON n.design = e.design""",
    },
    "documents_ext": """
        SELECT p_partkey AS id,
               '{"_id":{"$oid":"' || cast(p_partkey AS STRING) || '"},"price":{"$numberDecimal":"'
               || cast(p_retailprice AS STRING) || '"},"size":' || cast(p_size AS STRING)
               || ',"seen":{"$date":' || cast(1700000000000 + p_partkey * 1000 AS STRING)
               || '},"info":{"name":"' || p_name || '","brand":{"$binary":"' || p_brand
               || '"}},"codes":[{"$numberLong":"' || cast(p_partkey * 3 AS STRING) || '"},"' || p_type
               || '"],"pair":{"$oid":"a","x":1},"ratio":1.5,"quoted":"{' || chr(92) || '"k' || chr(92) || '":1}"}' AS doc
        FROM part""",
    "alarms": """
        SELECT event_id AS alarm_id, 'q' || cast(event_id AS STRING) AS request_id,
               'srv' || cast(user_id % 5 AS STRING) AS server, 'i' || cast(user_id % 3 AS STRING) AS instance,
               event_type AS scene, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'ws' || cast(user_id % 4 AS STRING) END
               AS workspace, ts AS alarm_time, props, value
        FROM events""",
    # one scene per customer segment and nation group
    "scenes": """
        SELECT DISTINCT 'srv' || cast(c_nationkey % 5 AS STRING) AS server,
               CASE c_nationkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'purchase'
                                    ELSE 'signup' END AS scene,
               'ws' || cast(c_nationkey % 4 AS STRING) AS workspace, 'sc' || cast(c_nationkey AS STRING) AS scene_code,
               'rb' || cast(c_nationkey % 6 AS STRING) AS robot, 'tp' || cast(c_nationkey % 4 AS STRING) AS template,
               CASE WHEN c_nationkey % 11 = 0 THEN 'DISABLE' ELSE 'ENABLE' END AS status
        FROM customer""",
    "robot_alarms": """
        SELECT event_id AS alarm_id, 'rb' || cast(user_id % 7 AS STRING) AS robot,
               'tp' || cast(event_id % 5 AS STRING) AS template, 'ws' || cast(user_id % 4 AS STRING) AS workspace,
               ts AS alarm_time, props AS note, event_type || ' ' || props AS text
        FROM events""",
    "robots": {
        "spark": """
            SELECT DISTINCT 'ws' || cast(c_nationkey % 4 AS STRING) AS workspace, 'rb' || cast(c_nationkey % 6 AS STRING) AS robot,
                   CASE c_nationkey % 12 WHEN 0 THEN 'BROADCAST' WHEN 7 THEN 'BROADCAST' WHEN 1 THEN 'RANDOM' WHEN 5 THEN 'RANDOM'
                                         ELSE 'POLLING' END AS mode,
                   CASE WHEN c_nationkey % 6 = 4 THEN 'DISABLE' ELSE 'ENABLE' END AS status,
                   CASE WHEN c_nationkey % 6 = 3 THEN 'DISABLE' ELSE 'ENABLE' END AS record_log,
                   array('a', 'b', 'c') AS receives
            FROM customer""",
        "duckdb": """
            SELECT DISTINCT 'ws' || cast(c_nationkey % 4 AS STRING) AS workspace, 'rb' || cast(c_nationkey % 6 AS STRING) AS robot,
                   CASE c_nationkey % 12 WHEN 0 THEN 'BROADCAST' WHEN 7 THEN 'BROADCAST' WHEN 1 THEN 'RANDOM' WHEN 5 THEN 'RANDOM'
                                         ELSE 'POLLING' END AS mode,
                   CASE WHEN c_nationkey % 6 = 4 THEN 'DISABLE' ELSE 'ENABLE' END AS status,
                   CASE WHEN c_nationkey % 6 = 3 THEN 'DISABLE' ELSE 'ENABLE' END AS record_log,
                   ['a', 'b', 'c'] AS receives
            FROM customer""",
    },
    "silence_words": """
        SELECT DISTINCT 'ws' || cast(c_nationkey % 4 AS STRING) AS workspace, 'rb' || cast(c_nationkey % 5 AS STRING) AS robot,
               '"k": ' || cast(c_nationkey % 25 AS STRING) AS word, c_nationkey % 3 AS rule_no
        FROM customer""",
    "alarm_log": """
        SELECT event_id AS id, 'ws' || cast(user_id % 4 AS STRING) AS workspace,
               'srv' || cast(user_id % 5 AS STRING) AS server,
               CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'SILENT' WHEN 2 THEN 'SENDING' ELSE 'SUCCESS' END
               AS status, ts AS create_time
        FROM events""",
    "audience_messages": """
        SELECT 'r' || cast(r_regionkey AS STRING) AS message_id, 'ALL' AS scope, cast(NULL AS STRING) AS target FROM region
        UNION ALL
        SELECT 'n' || cast(n_nationkey AS STRING) AS message_id, 'WORKSPACE' AS scope, cast(n_nationkey AS STRING) AS target
        FROM nation
        UNION ALL
        SELECT 'o' || cast(o_orderkey AS STRING) AS message_id, 'USER' AS scope, cast(o_custkey AS STRING) AS target
        FROM orders""",
    # three files of log lines without gaps: per event a header line and two lines that belong to it
    "log_lines": {
        "spark": """
            SELECT file, line_no, text FROM (
              SELECT event_id % 3 AS file, cast(floor(event_id / 3) * 3 AS BIGINT) + k AS line_no,
                     CASE WHEN k = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') || ' '
                          || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' 7 --- [flow] [main] ['
                          || repeat(cast(user_id % 10 AS STRING), 32) || '] ['
                          || CASE WHEN event_id % 4 = 0 THEN repeat(' ', 32) ELSE repeat('a', 32) END || '] app.'
                          || event_type || ' : ' || props
                          ELSE '    at step ' || cast(k AS STRING) || ' of ' || cast(event_id AS STRING) END AS text
              FROM events LATERAL VIEW explode(array(0, 1, 2)) x AS k)""",
        "duckdb": """
            SELECT event_id % 3 AS file, cast(floor(event_id / 3) * 3 AS BIGINT) + k AS line_no,
                   CASE WHEN k = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' '
                        || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' 7 --- [flow] [main] ['
                        || repeat(cast(user_id % 10 AS STRING), 32) || '] ['
                        || CASE WHEN event_id % 4 = 0 THEN repeat(' ', 32) ELSE repeat('a', 32) END || '] app.'
                        || event_type || ' : ' || props
                        ELSE '    at step ' || cast(k AS STRING) || ' of ' || cast(event_id AS STRING) END AS text
            FROM events CROSS JOIN (VALUES (0), (1), (2)) x(k)""",
    },
}


def _text(name: str, dialect: str) -> str:
    entry = FIXTURES[name]
    return entry if isinstance(entry, str) else entry[dialect]


def _uses(text: str, names) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [n for n in names if n in words]


def with_fixtures(body: str, dialect: str = "duckdb") -> str:
    """The query text with the fixtures it mentions as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text, FIXTURES):
            if name not in needed and text is not _text(name, dialect):
                visit(_text(name, dialect))
                if name not in needed:
                    needed.append(name)

    visit(body)
    parts = [f"{name} AS ({_text(name, dialect)})" for name in needed]
    match = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    if match:
        parts.append(body[match.end():])
        return "WITH " + ("RECURSIVE " if match.group(1) else "") + ", ".join(parts)
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Inputs:
    """Given tables and fixtures of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load_tables(self.spark, self.folder, [name])[name]
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        text = with_fixtures(body, "spark")
        for name, df in load_tables(self.spark, self.folder, _uses(text, TABLES)).items():
            # all fixtures of lines join or group them by their order
            (place_rows(df, "l_orderkey") if name == "lineitem" else df).createOrReplaceTempView(name)
        return self.spark.sql(text)

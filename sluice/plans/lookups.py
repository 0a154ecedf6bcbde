"""Registered queries: joins, lookups, searches, groupings and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import number_rows
from ..operators.graph import dead_ends, graph_roots, parse_design, reachable, successor_groups
from ..operators.relational import (
    check_references, conditional_counts, contributors, custom_order, describe_source, distinct_join, enrich, exists_any,
    json_contains, json_values, log_search, member_page, nest_groups, not_in, ordered_group_columns,
    record_authority, retain, text_search, top_groups, version_join,
)
from .fixtures import TABLES, Inputs

BRANDS = ["Brand#1", "Brand#12", "Brand#20"]
RANKS = {"ENABLE": 1, "PAUSE": 2, "TBP": 3}
NOW = "2024-01-31 00:00:00"


def _user_permissions(t: Inputs):
    tables = {"users": t["users"], "role_permissions": t["role_permissions"], "permissions": t["permissions"]}
    joins = [("permissions", "", ""), ("role_permissions", "link_permission", "permission_id"), ("users", "role", "link_role")]
    return distinct_join(tables, joins, {"permissions": "enabled = 1"}, ["user_id", "permission"])


def _exists_any(t: Inputs):
    links = t["role_permissions"].join(t["permissions"], F.col("link_permission") == F.col("permission_id"))
    return exists_any(t["users"], links.select(F.col("link_role").alias("role"), "permission"), "role", "permission", BRANDS)


def _custom_order(t: Inputs):
    """The order as a value: the position each row has in the sorted output."""
    ordered = custom_order(t["records"], "status", RANKS, [("price", True), ("record_id", False)])
    return number_rows(ordered.withColumn("_place", F.monotonically_increasing_id()), ["_place"]).drop("_place")


def _contributors(t: Inputs):
    found = contributors(t["records"], t["op_log"], 3)
    return found.select("record_id", "creator", F.array_join("users", ",").alias("users"))


def _nest_groups(t: Inputs):
    tables = t["part"].select(
        F.col("p_brand").alias("schema"), F.col("p_name").alias("table"),
        F.when(F.col("p_name").startswith("small"), F.lit("tiny ones")).alias("comment"),
    )
    nested = nest_groups(tables, "schema", "table", "comment")
    return nested.select("schema", F.array_join("children.label", ",").alias("labels"), F.size("children").alias("n"))


def _ordered_group_columns(t: Inputs):
    index = t["lineitem"].select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("index_name"), (F.col("l_linenumber") == 1).alias("is_unique"),
        F.struct("l_partkey", "l_suppkey").alias("seq"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("col"),
    )
    grouped = ordered_group_columns(index, ["index_name"], "seq", "col", ["is_unique"])
    return grouped.select("index_name", "is_unique", F.array_join("columns", ",").alias("columns"))


def _log_search(t: Inputs):
    return log_search(
        t["op_log"], {"workspace": "ws1", "status": "SUCCESS", "function": None}, {"action": '"k": 1'}, "create_time",
        "2024-01-05 00:00:00", "2024-01-25 00:00:00", current=2, size=20,
    )


def _references(t: Inputs):
    refs = t["lineitem"].select(F.concat(F.lit("d"), F.col("l_suppkey") + F.col("l_linenumber") * 10).alias("code"))
    registry = t["supplier"].select(
        F.concat(F.lit("d"), "s_suppkey").alias("code"),
        F.when(F.col("s_nationkey") % 3 == 0, "DISABLE").otherwise("ENABLE").alias("status"),
    )
    return check_references(refs, registry, "code")


def _edges(t: Inputs):
    return t["edges"].withColumnRenamed("ord", "order")


def _line_edges(t: Inputs):
    """Edges between lines only, so that short orders have none."""
    return dead_ends(t["nodes"], _edges(t).where("source <> 'n0'"))


def _design(t: Inputs, part: int):
    return parse_design(t["designs"])[part]


def _successors(t: Inputs):
    groups = F.transform("successors", lambda g: F.concat(g["order"].cast("string"), F.lit(":"), F.array_join(g["targets"], ",")))
    return successor_groups(_edges(t)).select("design", "source", F.array_join(groups, ";").alias("successors"))


def _dead_ends(t: Inputs):
    return dead_ends(t["nodes"], _edges(t))


QUERIES = {
    "g1_distinct_join": _user_permissions,
    "g2_exists_any": _exists_any,
    "g3_not_in": lambda t: not_in(t["customer"], t["events"], "c_custkey", "user_id"),
    "g3_not_in_empty": lambda t: not_in(t["supplier"], t["nation"].filter("n_nationkey < 0"), "s_nationkey", "n_nationkey"),
    "g4_member_page": lambda t: member_page(
        t["op_log"].select("id", "user_id", "workspace"), t["users"], {"keyword": "00001", "exclude_user": 12}, 2, 30,
        order_by=[("user_id", False), ("id", False)],
    ),
    "g5_top_groups": lambda t: top_groups(t["orders"], "o_custkey", "o_orderdate", "1995-01-01", "1998-12-31"),
    "g6_conditional_counts": lambda t: conditional_counts(
        t["inbox"], {"unread": "is_read = 0", "urgent_unread": "is_read = 0 AND is_urgent = 1"}, ["user_id"]
    ),
    "g6_conditional_counts_all": lambda t: conditional_counts(t["inbox"], {"unread": "is_read = 0"}),
    "g7_custom_order": _custom_order,
    "g8_enrich": lambda t: enrich(t["op_log"], t["users"], "user_id", ["username", "role"]),
    "g9_contributors": _contributors,
    "g10_version_join": lambda t: version_join(t["records"], t["versions"], ["ENABLE", "PAUSE"], ["published_as"]),
    "g11_json_contains": lambda t: json_contains(t["designs"].select("design", "codes"), "codes", "ds3"),
    "g11_json_contains_first": lambda t: json_contains(t["designs"].select("design", "codes"), "codes", "ds3", ["design"]),
    "g12_json_values": lambda t: json_values(t["designs"].select("design", "text"), "text", "datasourceCode"),
    "g13_check_references": _references,
    "g14_text_search": lambda t: text_search(t["documents"], ["text", "source"], "th"),
    "g15_log_search": _log_search,
    "g16_retain_days": lambda t: retain(t["op_log"], NOW, ts="create_time", days=10),
    "g16_retain_expiry": lambda t: retain(t["save_points"], "2024-01-20 00:00:00", expiry="expire_time"),
    "g17_nest_groups": _nest_groups,
    "g18_ordered_group_columns": _ordered_group_columns,
    "g19_describe_source": lambda t: describe_source(
        t.spark, {name: t[name] for name in TABLES}, count_nulls=True
    ),
    "g20_record_authority": lambda t: record_authority(t["users"], t["grants"], "FLOW", 7),
    "h1_parse_design_nodes": lambda t: _design(t, 0),
    "h1_parse_design_edges": lambda t: _design(t, 1),
    "h2_graph_roots": lambda t: graph_roots(_edges(t)),
    "h3_successor_groups": _successors,
    "h4_reachable": lambda t: reachable(_edges(t)),
    "h4_reachable_depth": lambda t: reachable(_edges(t), 2),
    "h5_without_edges": _line_edges,
    "h5_dead_ends": _dead_ends,
}


def _nulls(columns: str, table: str) -> str:
    """Columns of a table with their missing values; ``columns`` are name:type pairs."""
    pairs = [c.split(":") for c in columns.split()]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {i} AS position, '{name}' AS column_name, '{kind}' AS type, true AS nullable, "
        f"count(*) - count({name}) AS nulls FROM {table}"
        for i, (name, kind) in enumerate(pairs, start=1)
    )


# The columns of the given tables.
_COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz "
              "o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double "
                "l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string "
                "l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}

ORACLES = {
    "g1_distinct_join": """
        SELECT DISTINCT user_id, permission FROM users JOIN role_permissions ON link_role = role
        JOIN permissions ON permission_id = link_permission WHERE enabled = 1""",
    "g2_exists_any": """
        SELECT *, role IN (SELECT link_role FROM role_permissions JOIN permissions ON link_permission = permission_id
                           WHERE permission IN ('Brand#1', 'Brand#12', 'Brand#20')) AS has_any FROM users""",
    "g3_not_in": "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "g3_not_in_empty": "SELECT * FROM supplier",
    "g4_member_page": """
        WITH joined AS (
            SELECT o.id, o.user_id, o.workspace, u.username, u.team, u.role FROM op_log o, users u
            WHERE o.user_id = u.user_id AND u.username LIKE '%00001%' AND o.user_id <> 12)
        SELECT *, (SELECT count(*) FROM joined) AS total FROM joined ORDER BY user_id, id LIMIT 30 OFFSET 30""",
    "g5_top_groups": """
        SELECT o_custkey, count(*) AS rows FROM orders
        WHERE o_orderdate BETWEEN timestamp '1995-01-01' AND timestamp '1998-12-31'
        GROUP BY o_custkey ORDER BY rows DESC, o_custkey LIMIT 6""",
    "g6_conditional_counts": """
        SELECT user_id, count(*) AS total, count(*) FILTER (WHERE is_read = 0) AS unread,
               count(*) FILTER (WHERE is_read = 0 AND is_urgent = 1) AS urgent_unread
        FROM inbox GROUP BY user_id""",
    "g6_conditional_counts_all": "SELECT count(*) AS total, count(*) FILTER (WHERE is_read = 0) AS unread FROM inbox",
    "g7_custom_order": """
        SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'ENABLE' THEN 1 WHEN 'PAUSE' THEN 2 WHEN 'TBP' THEN 3 ELSE 4 END,
                                     price DESC, record_id) AS position
        FROM records""",
    "g8_enrich": "SELECT o.*, u.username, u.role FROM op_log o LEFT JOIN users u ON u.user_id = o.user_id",
    "g9_contributors": """
        WITH listed AS (
            SELECT record_id, creator, creator AS user_id FROM records
            UNION
            SELECT r.record_id, creator, l.user_id FROM records r JOIN op_log l ON l.record_id = r.record_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY
                CASE WHEN user_id = creator THEN 0 WHEN user_id = 3 THEN 1 ELSE 2 END, user_id) AS n FROM listed)
        SELECT record_id, creator, string_agg(cast(user_id AS STRING), ',' ORDER BY n) AS users
        FROM ranked WHERE n <= 6 GROUP BY record_id, creator""",
    "g10_version_join": """
        SELECT r.*, v.published_as FROM records r
        LEFT JOIN versions v ON v.code = r.code AND v.version = r.publish_version AND v.status IN ('ENABLE', 'PAUSE')""",
    "g11_json_contains": "SELECT design, codes FROM designs WHERE contains(codes, '\"ds3\"')",
    "g11_json_contains_first": "SELECT design, codes FROM designs WHERE contains(codes, '\"ds3\"') ORDER BY design LIMIT 1",
    "g12_json_values": "SELECT DISTINCT design, datasource AS value FROM nodes WHERE datasource <> ''",
    "g13_check_references": """
        WITH refs AS (SELECT DISTINCT l_suppkey + l_linenumber * 10 AS k FROM lineitem)
        SELECT 'd' || cast(k AS STRING) AS code, CASE WHEN s_suppkey IS NULL THEN 'MISSING' ELSE 'DISABLED' END AS problem
        FROM refs LEFT JOIN supplier ON s_suppkey = k WHERE s_suppkey IS NULL OR s_nationkey % 3 = 0""",
    "g14_text_search": "SELECT * FROM documents WHERE text LIKE '%th%' OR source LIKE '%th%'",
    "g15_log_search": """
        WITH found AS (
            SELECT * FROM op_log WHERE workspace = 'ws1' AND status = 'SUCCESS' AND action LIKE '%"k": 1%'
            AND create_time >= timestamp '2024-01-05' AND create_time <= timestamp '2024-01-25')
        SELECT found.*, total FROM (SELECT count(*) AS total FROM found)
        LEFT JOIN (SELECT * FROM found ORDER BY create_time DESC, id DESC LIMIT 20 OFFSET 20) found ON true""",
    "g16_retain_days": "SELECT * FROM op_log WHERE create_time >= timestamp '2024-01-21 00:00:00'",
    "g16_retain_expiry": "SELECT * FROM save_points WHERE expire_time >= timestamp '2024-01-20 00:00:00'",
    "g17_nest_groups": """
        SELECT p_brand AS schema, string_agg(label, ',' ORDER BY p_name) AS labels, count(*) AS n
        FROM (SELECT DISTINCT p_brand, p_name, p_name || CASE WHEN p_name LIKE 'small%' THEN '(tiny ones)' ELSE '' END AS label
              FROM part)
        GROUP BY p_brand""",
    "g18_ordered_group_columns": """
        SELECT cast(l_orderkey AS STRING) || '-' || cast(l_linenumber AS STRING) AS index_name, l_linenumber = 1 AS is_unique,
               string_agg('c' || cast(l_partkey AS STRING), ',' ORDER BY l_partkey, l_suppkey) AS columns
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "g19_describe_source": " UNION ALL ".join(_nulls(columns, table) for table, columns in _COLUMNS.items()),
    "g20_record_authority": """
        SELECT u.*, coalesce(bool_or(g.can_write), false) AS can_write, coalesce(bool_or(g.can_publish), false) AS can_publish
        FROM users u LEFT JOIN grants g ON g.user_id = u.user_id AND g.record_type = 'FLOW' AND g.record_id = 7
        GROUP BY ALL""",
    "h1_parse_design_nodes": """
        SELECT design, id, type, '{"datasourceCode":"' || datasource || '"}' AS properties FROM nodes""",
    "h1_parse_design_edges": 'SELECT design, source, target, ord AS "order" FROM edges',
    "h2_graph_roots": """
        SELECT DISTINCT design, source AS id FROM edges e
        WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.design = e.design AND x.target = e.source)""",
    "h3_successor_groups": """
        SELECT design, source, string_agg(cast(ord AS STRING) || ':' || targets, ';' ORDER BY ord) AS successors
        FROM (SELECT design, source, ord, string_agg(target, ',' ORDER BY target) AS targets FROM edges GROUP BY design, source, ord)
        GROUP BY design, source""",
    "h4_reachable": """
        WITH RECURSIVE walk AS (
            SELECT DISTINCT design, source AS root, source AS node, 0 AS depth FROM edges e
            WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.design = e.design AND x.target = e.source)
            UNION
            SELECT w.design, w.root, e.target, w.depth + 1 FROM walk w JOIN edges e ON e.design = w.design AND e.source = w.node)
        SELECT design, root, node, min(depth) AS depth FROM walk GROUP BY design, root, node""",
    "h4_reachable_depth": """
        WITH RECURSIVE walk AS (
            SELECT DISTINCT design, source AS root, source AS node, 0 AS depth FROM edges e
            WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.design = e.design AND x.target = e.source)
            UNION
            SELECT w.design, w.root, e.target, w.depth + 1 FROM walk w JOIN edges e ON e.design = w.design AND e.source = w.node WHERE w.depth < 2)
        SELECT design, root, node, min(depth) AS depth FROM walk GROUP BY design, root, node""",
    "h5_without_edges": """
        SELECT design, id, type, 'NO_SUCCESSOR' AS problem FROM nodes n
        WHERE type IN ('job', 'queryMySQL', 'kafkaReceive', 'eventDebezium')
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.design = n.design AND e.source = n.id AND e.source <> 'n0')
        UNION ALL
        SELECT design, id, type, 'UNKNOWN_TYPE' AS problem FROM nodes WHERE type = 'mystery'
        UNION ALL
        SELECT DISTINCT design, NULL, NULL, 'NO_EDGES' FROM nodes n
        WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.design = n.design AND e.source <> 'n0')""",
    "h5_dead_ends": """
        SELECT design, id, type, 'NO_SUCCESSOR' AS problem FROM nodes n
        WHERE type IN ('job', 'queryMySQL', 'kafkaReceive', 'eventDebezium')
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.design = n.design AND e.source = n.id)
        UNION ALL
        SELECT design, id, type, 'UNKNOWN_TYPE' AS problem FROM nodes WHERE type = 'mystery'""",
}

"""Registered queries: templates, paging with totals, call statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.templates import (
    dynamic_where, page_with_total, query_count, query_list, query_log_stats, query_one, template_query,
)
from .fixtures import Inputs

TEMPLATE = """
    SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price
    FROM orders WHERE o_orderstatus = {status} AND o_totalprice BETWEEN {low} AND {high}
    GROUP BY o_orderpriority"""

CONDITIONS = [
    ("status", lambda v: F.col("o_orderstatus") == v),
    ("keyword", lambda v: F.col("o_orderpriority").contains(v)),
    ("minimum", lambda v: F.col("o_totalprice") >= v),
    ("customers", lambda v: F.col("o_custkey").isin(v)),
]


def _template(t: Inputs):
    t["orders"].createOrReplaceTempView("orders")
    text = TEMPLATE.format(status="${status}", low="${low}", high="${high}")
    return template_query(t.spark, text, {"status": "O", "low": 5000.0, "high": 300000.0})


def _log_stats(t: Inputs):
    return query_log_stats(t["query_log"]).withColumns({
        "hit_rate": F.col("hit_rate").cast("double"), "avg_cost": F.col("avg_cost").cast("double")
    })


def _unread(t: Inputs):
    return dynamic_where(t["inbox"], [("unread", lambda v: F.col("is_read") == 0)], {"unread": True})


QUERIES = {
    "f1_template_query": _template,
    "f2_dynamic_where": lambda t: dynamic_where(
        t["orders"], CONDITIONS, {"status": "F", "keyword": "URGENT", "minimum": 100000.0, "customers": []}
    ),
    "f2_dynamic_where_blank": lambda t: dynamic_where(t["orders"], CONDITIONS, {"status": " ", "keyword": None}),
    "f3_query_one": lambda t: query_one(t["orders"].agg(F.max_by(F.col("o_orderkey"), F.struct("o_totalprice", "o_orderkey")).alias("k"))),
    "f3_query_list": lambda t: query_list(t["inbox"]),
    "f3_query_count": lambda t: query_count(t["lineitem"]),
    "f3_query_page": lambda t: page_with_total(_unread(t), 2, 50, [("create_time", True), ("message_id", False)]),
    "f4_page_with_total": lambda t: page_with_total(t["lineitem"], 1, 10, [
        ("l_shipdate", True), ("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False), ("l_linenumber", False),
    ]),
    "f4_past_the_end": lambda t: page_with_total(t["customer"], 1_000_000, 10, [("c_custkey", False)]),
    "f5_query_log_stats": _log_stats,
}

ORACLES = {
    "f1_template_query": TEMPLATE.format(status="'O'", low=5000.0, high=300000.0),
    "f2_dynamic_where": """
        SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%URGENT%' AND o_totalprice >= 100000""",
    "f2_dynamic_where_blank": "SELECT * FROM orders",
    "f3_query_one": "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1",
    "f3_query_list": "SELECT * FROM inbox",
    "f3_query_count": "SELECT count(*) AS total FROM lineitem",
    "f3_query_page": """
        SELECT *, (SELECT count(*) FROM inbox WHERE is_read = 0) AS total FROM inbox WHERE is_read = 0
        ORDER BY create_time DESC, message_id LIMIT 50 OFFSET 50""",
    "f4_page_with_total": """
        SELECT *, (SELECT count(*) FROM lineitem) AS total FROM lineitem
        ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10""",
    "f4_past_the_end": """
        SELECT c.*, n AS total FROM (SELECT count(*) AS n FROM customer) LEFT JOIN customer c ON false""",
    "f5_query_log_stats": """
        SELECT template, count(*) AS calls, count(*) FILTER (WHERE status <> 'SUCCESS') AS errors,
               count(*) FILTER (WHERE hit_cache) AS cache_hits,
               ((20000 * count(*) FILTER (WHERE hit_cache) + count(*)) // (2 * count(*))) / 100.0 AS hit_rate,
               cast(sum(number) AS BIGINT) AS rows,
               ((2 * cast(sum(cast(cost AS DECIMAL(28,8))) * 100000000 AS HUGEINT) + 1000000 * count(*)) // (2000000 * count(*))) / 100.0 AS avg_cost
        FROM query_log GROUP BY template""",
}

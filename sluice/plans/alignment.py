"""Registered queries: table comparison and repair."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators.align import (
    align_content, align_count, align_diff_fields, align_range, align_repair, align_report, align_sample,
)
from ..operators.upserts import apply_changes
from .fixtures import Inputs
from .sources import _SHARD

KEYS = ["o_orderkey"]
TODAY = date(2024, 1, 20)


def _sides(t: Inputs):
    return t["left_side"], t["right_side"]


def _repair(t: Inputs):
    left, right = _sides(t)
    return align_repair(left, right, KEYS)


def _repaired(t: Inputs):
    _, right = _sides(t)
    return apply_changes(right, _repair(t).withColumn("seq", F.lit(1)), KEYS, before=None)


def _report(t: Inputs):
    runs = t["events"].select(
        (F.col("user_id") % 5).alias("task"), F.col("ts").alias("day"), (F.col("event_type") != "error").alias("ok")
    )
    return align_report(runs, TODAY).withColumns({
        "date": F.col("date").cast("string"), "success_rate": F.col("success_rate").cast("double")
    })


QUERIES = {
    "e1_align_count": lambda t: align_count(*_sides(t)),
    "e1_align_count_by": lambda t: align_count(*_sides(t), by=["o_orderpriority"]),
    "e2_align_content": lambda t: align_content(*_sides(t), KEYS),
    "e3_align_diff_fields": lambda t: align_diff_fields(*_sides(t), KEYS),
    "e4_align_sample": lambda t: align_sample(*_sides(t), KEYS, buckets=10, take=3),
    "e5_align_range": lambda t: align_range(*_sides(t), "o_orderdate", "1996-01-01", "1998-01-01", KEYS),
    "e6_align_repair": _repair,
    "e6_align_repaired": _repaired,
    "e7_align_report": _report,
}

_DIFFERENT = (
    "l.o_custkey IS DISTINCT FROM r.o_custkey OR l.o_totalprice IS DISTINCT FROM r.o_totalprice OR "
    "l.o_orderdate IS DISTINCT FROM r.o_orderdate OR l.o_orderpriority IS DISTINCT FROM r.o_orderpriority"
)

_CONTENT = f"""
    SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey,
           CASE WHEN r.o_orderkey IS NULL THEN 'LEFT_ONLY' WHEN l.o_orderkey IS NULL THEN 'RIGHT_ONLY' ELSE 'DIFFERENT' END
           AS status
    FROM (SELECT * FROM left_side WHERE {{0}}) l FULL JOIN (SELECT * FROM right_side WHERE {{0}}) r ON l.o_orderkey = r.o_orderkey
    WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR {_DIFFERENT}"""

ORACLES = {
    "e1_align_count": """
        SELECT (SELECT count(*) FROM left_side) AS left_rows, (SELECT count(*) FROM right_side) AS right_rows,
               (SELECT count(*) FROM left_side) = (SELECT count(*) FROM right_side) AS equal""",
    "e1_align_count_by": """
        SELECT coalesce(l.p, r.p) AS o_orderpriority, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows,
               coalesce(l.n, 0) = coalesce(r.n, 0) AS equal
        FROM (SELECT o_orderpriority AS p, count(*) AS n FROM left_side GROUP BY 1) l
        FULL JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM right_side GROUP BY 1) r ON l.p IS NOT DISTINCT FROM r.p""",
    "e2_align_content": _CONTENT.format("true"),
    "e3_align_diff_fields": """
        WITH both_sides AS (
            SELECT l.o_orderkey, l.o_totalprice AS lp, r.o_totalprice AS rp, l.o_orderpriority AS lo, r.o_orderpriority AS ro
            FROM left_side l JOIN right_side r ON l.o_orderkey = r.o_orderkey)
        SELECT o_orderkey, 'o_totalprice' AS field, cast(lp AS STRING) AS left_value, cast(rp AS STRING) AS right_value
        FROM both_sides WHERE lp IS DISTINCT FROM rp
        UNION ALL
        SELECT o_orderkey, 'o_orderpriority' AS field, lo AS left_value, ro AS right_value
        FROM both_sides WHERE lo IS DISTINCT FROM ro""",
    "e4_align_sample": _CONTENT.format(f"{_SHARD.format('cast(o_orderkey AS STRING)', 10)} < 3"),
    "e5_align_range": _CONTENT.format("o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '1998-01-01'"),
    "e6_align_repair": f"""
        SELECT CASE WHEN r.o_orderkey IS NULL THEN 'INSERT' WHEN l.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
               coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_custkey, l.o_totalprice, l.o_orderdate, l.o_orderpriority
        FROM left_side l FULL JOIN right_side r ON l.o_orderkey = r.o_orderkey
        WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR {_DIFFERENT}""",
    "e6_align_repaired": "SELECT * FROM left_side",
    # round half up in whole numbers: percent with two decimals
    "e7_align_report": """
        WITH runs AS (SELECT user_id % 5 AS task, cast(ts AS DATE) AS d, event_type <> 'error' AS ok FROM events),
        grid AS (SELECT task, cast(x AS DATE) AS d FROM (SELECT DISTINCT task FROM runs),
                 generate_series(timestamp '2024-01-14', timestamp '2024-01-20', interval '1' day) g(x))
        SELECT g.task, cast(g.d AS STRING) AS date, count(r.ok) AS runs, count(*) FILTER (WHERE r.ok) AS succeeded,
               CASE WHEN count(r.ok) > 0 THEN ((20000 * count(*) FILTER (WHERE r.ok) + count(r.ok)) // (2 * count(r.ok))) / 100.0 END
               AS success_rate,
               g.d = DATE '2024-01-20' AS is_today
        FROM grid g LEFT JOIN runs r ON r.task = g.task AND r.d = g.d GROUP BY g.task, g.d""",
}

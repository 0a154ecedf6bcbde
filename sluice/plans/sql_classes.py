"""Registered queries: one or more SELECT texts per class of SQL that ``sql_query`` has to carry.

A text is the same in both dialects unless an entry gives two. Sums of amounts go through decimals so
that the order of addition cannot show.
"""

from __future__ import annotations

from ..functions.tables import register_functions
from ..sources import place_texts, sql_query
from .fixtures import TABLES, _uses, Inputs


def _money(expression: str) -> str:
    return f"cast(sum(cast({expression} AS DECIMAL(18,4))) AS DOUBLE)"


TEXTS: dict[str, str | tuple[str, str]] = {
    # joins
    "k1_inner_join": f"""
        SELECT n_name, count(*) AS n_orders, {_money('o_totalprice')} AS total
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
        GROUP BY n_name""",
    "k1_left_join": """
        SELECT o_orderkey, count(l_partkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY o_orderkey""",
    "k1_full_join": """
        SELECT c.c_custkey, s.s_suppkey, c.c_acctbal, s.s_acctbal
        FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey""",
    "k1_semi_join": """
        SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    "k1_anti_join": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "k1_residual_join": """
        SELECT o_orderkey, count(*) AS late_lines FROM orders JOIN lineitem
        ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice > o_totalprice / 10
        GROUP BY o_orderkey""",
    # range and as-of matches within an equal key
    "k2_interval_join": """
        SELECT o_orderkey, l_partkey, l_linenumber, l_shipdate FROM orders JOIN lineitem
        ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + interval '365' day""",
    "k2_range_join": """
        SELECT p_partkey, l_orderkey, l_linenumber, l_quantity FROM part JOIN lineitem
        ON l_partkey = p_partkey AND l_quantity BETWEEN p_size - 5 AND p_size + 5""",
    "k2_as_of_join": (
        """
        SELECT o_orderkey, o_orderdate, max(l_shipdate) AS last_ship, max_by(l_partkey, struct(l_shipdate, l_partkey)) AS last_part
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate
        GROUP BY o_orderkey, o_orderdate""",
        """
        SELECT o_orderkey, o_orderdate, max(l_shipdate) AS last_ship, arg_max(l_partkey, (l_shipdate, l_partkey)) AS last_part
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate
        GROUP BY o_orderkey, o_orderdate""",
    ),
    # aggregates
    "k3_aggregate": f"""
        SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS sum_qty, {_money('l_extendedprice')} AS sum_base,
               cast(sum(cast(l_extendedprice AS DECIMAL(12,2)) * cast(1 - l_discount AS DECIMAL(6,2))) AS DOUBLE) AS sum_disc,
               min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n
        FROM lineitem WHERE l_shipdate <= timestamp '2001-09-02 00:00:00'
        GROUP BY l_returnflag, l_linestatus""",
    "k3_distinct_having": """
        SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts, count(*) AS n
        FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10""",
    # grouping sets
    "k4_grouping_sets": f"""
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, {_money('o_totalprice')} AS total,
               grouping(o_orderstatus) AS g_status, grouping(o_orderpriority) AS g_priority
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
    "k4_cube": "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS size FROM part GROUP BY CUBE (p_brand, p_type)",
    "k4_rollup": """
        SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    # windows, over the lines of an order and the events of a user's hour
    "k5_ranking": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER w AS rn, rank() OVER w2 AS rk,
               dense_rank() OVER w2 AS drk, ntile(4) OVER w AS quarter
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber),
               w2 AS (PARTITION BY l_orderkey ORDER BY l_returnflag)""",
    "k5_analytic": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, lag(l_quantity) OVER w AS previous,
               lead(l_partkey, 2, -1) OVER w AS next_but_one, first_value(l_suppkey) OVER w AS first_supplier
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber)""",
    "k5_frames": """
        SELECT event_id,
               cast(sum(event_id) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id
                                        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three,
               count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts
                              RANGE BETWEEN interval '10' minute PRECEDING AND CURRENT ROW) AS in_ten_minutes,
               max(value) OVER (PARTITION BY user_id, date_trunc('hour', ts)) AS top_value
        FROM events""",
    # sorting and limits
    "k6_top_k": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "k6_limit_offset": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
        ORDER BY l_orderkey DESC NULLS LAST, l_partkey, l_suppkey, l_linenumber LIMIT 40 OFFSET 60""",
    # set operators
    "k7_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "k7_union_all": "SELECT 'c' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier",
    "k7_intersect": "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25",
    "k7_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events",
    # subqueries
    "k8_scalar_subquery": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE cast(o_totalprice AS DECIMAL(18,2)) > (SELECT sum(cast(o_totalprice AS DECIMAL(18,2))) / count(*) FROM orders)""",
    "k8_correlated_subquery": """
        SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order,
               (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS errors
        FROM customer""",
    "k8_cte": f"""
        WITH per_customer AS (SELECT o_custkey, count(*) AS n, {_money('o_totalprice')} AS total FROM orders GROUP BY o_custkey),
        busy AS (SELECT * FROM per_customer WHERE n >= 10)
        SELECT c_mktsegment, count(*) AS busy_customers, max(total) AS top_total
        FROM busy JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    # each step takes the event whose number among the user's is twice that of the one before
    "k8_recursive_cte": """
        WITH RECURSIVE numbered AS (
            SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        walk AS (
            SELECT user_id, event_id, rn, 0 AS step, event_id % 1009 AS code FROM numbered WHERE rn = 1
            UNION ALL
            SELECT n.user_id, n.event_id, n.rn, w.step + 1, (w.code * 31 + n.event_id) % 1009
            FROM walk w JOIN numbered n ON n.user_id = w.user_id AND n.rn = w.rn * 2)
        SELECT user_id, event_id, rn, step, code FROM walk""",
    "k8_in_subquery": """
        SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_tax < 0.01)""",
    # table functions and aggregates of one's own
    "k12_table_function": (
        """
        SELECT user_id, session, started, ended, events
        FROM sessions(TABLE(SELECT user_id, ts, 24 AS hours FROM events) PARTITION BY user_id ORDER BY ts)""",
        """
        SELECT user_id, cast(session AS INTEGER) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events
        FROM (SELECT user_id, ts, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session
              FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > interval '24' hour, true) AS fresh FROM events))
        GROUP BY user_id, session"""),
    "k12_aggregate_function": (
        "SELECT l_returnflag, l_linestatus, l_linenumber, weighted_median(l_extendedprice, l_quantity) AS median FROM lineitem GROUP BY ALL",
        """
        SELECT l_returnflag, l_linestatus, l_linenumber, min(l_extendedprice) AS median
        FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS reached,
                     sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber) AS total FROM lineitem)
        WHERE 2 * reached >= total GROUP BY ALL"""),
    # functions
    "k9_string_functions": (
        """
        SELECT doc_id, upper(lang) AS up, length(text) AS n, substring(text, 3, 20) AS part, instr(text, 'th') AS pos,
               replace(source, '/', '-') AS plain, trim(concat(' ', lang, ' ')) AS t, lpad(cast(doc_id AS STRING), 8, '0') AS padded,
               md5(text) AS digest, reverse(lang) AS rev, regexp_replace(source, '[0-9]+', '#') AS masked,
               text LIKE '%er%' AS has_er
        FROM documents""",
        """
        SELECT doc_id, upper(lang) AS up, length(text) AS n, substring(text, 3, 20) AS part, instr(text, 'th') AS pos,
               replace(source, '/', '-') AS plain, trim(concat(' ', lang, ' ')) AS t, lpad(cast(doc_id AS STRING), 8, '0') AS padded,
               md5(text) AS digest, reverse(lang) AS rev, regexp_replace(source, '[0-9]+', '#', 'g') AS masked,
               text LIKE '%er%' AS has_er
        FROM documents""",
    ),
    "k9_date_functions": (
        """
        SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, weekday(ts) + 1 AS iso_day,
               cast(date_trunc('hour', ts) AS timestamp_ntz) AS hour_start, date_format(ts, 'yyyy/MM/dd HH:mm') AS label,
               datediff(ts, timestamp_ntz '2024-01-01 00:00:00') AS days, ts + interval '90' minute AS later,
               last_day(ts) = cast(ts AS DATE) AS month_end
        FROM events""",
        """
        SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, isodow(ts) AS iso_day,
               date_trunc('hour', ts)::TIMESTAMP AS hour_start, strftime(ts, '%Y/%m/%d %H:%M') AS label,
               date_diff('day', DATE '2024-01-01', cast(ts AS DATE)) AS days, ts + interval '90' minute AS later,
               last_day(ts) = cast(ts AS DATE) AS month_end
        FROM events""",
    ),
    "k9_math_functions": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(floor(l_extendedprice) AS BIGINT) AS low, cast(ceil(l_extendedprice) AS BIGINT) AS high,
               abs(l_quantity - 25) AS distance, l_orderkey % 7 AS modulo, cast(sign(l_quantity - 25) AS INT) AS side,
               greatest(l_discount, l_tax) AS top, least(l_discount, l_tax) AS bottom, sqrt(l_quantity * l_quantity) AS same
        FROM lineitem""",
    "k10_json_functions": (
        """
        SELECT event_id, cast(get_json_object(props, '$.k') AS INT) AS k, cast(json_array_length('[1,2,3]') AS INT) AS n,
               array_join(json_object_keys(props), ',') AS names
        FROM events""",
        """
        SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k, cast(json_array_length('[1,2,3]') AS INT) AS n,
               array_to_string(json_keys(props), ',') AS names
        FROM events""",
    ),
    "k10_array_functions": (
        """
        SELECT doc_id, size(split(text, ' ')) AS words, array_contains(split(text, ' '), 'the') AS has_the,
               array_join(slice(array_sort(array_distinct(split(text, ' '))), 1, 5), '|') AS first_words,
               aggregate(transform(split(text, ' '), w -> length(w)), 0, (a, x) -> a + x) AS letters,
               size(filter(split(text, ' '), w -> length(w) > 6)) AS long_words
        FROM documents""",
        """
        SELECT doc_id, len(string_split(text, ' ')) AS words, list_contains(string_split(text, ' '), 'the') AS has_the,
               array_to_string(list_slice(list_sort(list_distinct(string_split(text, ' '))), 1, 5), '|') AS first_words,
               list_sum(list_transform(string_split(text, ' '), lambda w: length(w)))::BIGINT AS letters,
               len(list_filter(string_split(text, ' '), lambda w: length(w) > 6)) AS long_words
        FROM documents""",
    ),
    "k10_map_functions": (
        """
        SELECT p_partkey, element_at(m, 'brand') AS brand, element_at(m, 'none') AS absent, cast(cardinality(m) AS INT) AS n,
               array_join(map_keys(m), ',') AS names
        FROM (SELECT p_partkey, map('brand', p_brand, 'type', p_type) AS m FROM part)""",
        """
        SELECT p_partkey, m['brand'] AS brand, m['none'] AS absent, cast(cardinality(m) AS INT) AS n, array_to_string(map_keys(m), ',') AS names
        FROM (SELECT p_partkey, MAP {'brand': p_brand, 'type': p_type} AS m FROM part)""",
    ),
    "k10_explode": (
        "SELECT doc_id, word, count(*) AS n FROM documents LATERAL VIEW explode(split(text, ' ')) x AS word GROUP BY doc_id, word",
        "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) "
        "GROUP BY doc_id, word",
    ),
    "k11_conditions": """
        SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
               coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hurry
        FROM orders WHERE o_orderdate BETWEEN timestamp '1995-01-01 00:00:00' AND timestamp '1998-12-31 00:00:00'""",
}


# texts whose words are grouped within a row's key: the rows are exchanged, not the words
BY_TEXT = {"k10_explode": ("documents", "doc_id", "text")}


def _run(t: Inputs, text: str, placed: tuple[str, str, str] | None = None):
    sources = {name: {"format": "parquet", "path": f"{t.folder}/{name}.parquet"} for name in _uses(text, TABLES)}
    if placed:
        name, key, long = placed
        sources[name] = place_texts(t[name], key, long)
    register_functions(t.spark)
    return sql_query(t.spark, sources, text)


QUERIES = {
    name: (lambda t, text=text if isinstance(text, str) else text[0], placed=BY_TEXT.get(name): _run(t, text, placed))
    for name, text in TEXTS.items()
}

ORACLES = {name: text if isinstance(text, str) else text[1] for name, text in TEXTS.items()}

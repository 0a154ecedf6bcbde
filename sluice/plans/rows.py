"""Registered queries: row transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.transforms import (
    align_to_table, decode_binary, double_to_decimal, drop_null_fields, filter_rows, format_change_times, map_rows,
    mask_columns, normalize_document, normalize_types, preview, resolve_columns, safe_expr,
)
from .fixtures import Inputs

DOCUMENT = (
    "_id string, price decimal(12,2), size int, seen timestamp_ntz, info struct<name: string, brand: string>, "
    "codes array<string>, pair string, ratio double, quoted string, absent string"
)


def _normalize_types(t: Inputs):
    rows = t["orders"].select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        "o_totalprice",
    )
    return normalize_types(rows)


def _format_change_times(t: Inputs):
    micros = F.col("event_id") * 123_456_000 % 86_400_000_000
    rows = t["events"].select(
        "event_id", F.datediff("ts", F.lit("1970-01-01")).alias("day"), micros.alias("clock"), F.col("ts").alias("at"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("utc"),
    )
    return format_change_times(rows, {"day": "DATE", "clock": "TIME", "at": "DATETIME", "utc": "TIMESTAMP"}, "+08:00")


def _decode_binary(t: Inputs):
    rows = t["documents"].select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("body"))
    return decode_binary(rows, ["body"]).select("doc_id", F.md5("body").alias("body_md5"), F.length("body").alias("n_bytes"))


def _double_to_decimal(t: Inputs):
    rows = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    decimals = double_to_decimal(rows, ["l_extendedprice", "l_discount"], 20, 4)
    return decimals.withColumns({c: F.col(c).cast("string") for c in ("l_extendedprice", "l_discount")})


def _normalize_document(t: Inputs):
    parsed = normalize_document(t["documents_ext"], "doc", DOCUMENT, "+08:00")
    return parsed.select(
        "id", F.col("doc._id").alias("oid"), F.col("doc.price").cast("double").alias("price"), "doc.size", "doc.seen",
        "doc.info.name", "doc.info.brand", F.array_join("doc.codes", "|").alias("codes"), "doc.pair", "doc.ratio",
        "doc.quoted", "doc.absent",
    )


def _drop_null_fields(t: Inputs):
    image = F.struct(
        F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("size"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("type"),
    )
    fields = drop_null_fields(t["part"].select("p_partkey", image.alias("image")), "image")
    pairs = F.transform(F.map_entries("image"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return fields.select("p_partkey", F.array_join(pairs, ",").alias("fields"))


def _filter_rows(t: Inputs):
    changes = t["changes"].select("seq", "op", F.when(F.col("op") != "DELETE", F.struct("key", "amount")).alias("after"))
    return filter_rows(changes, "amount > 100 AND key % 2 = 0", "after").select(
        "seq", "op", F.col("after.key").alias("key"), F.col("after.amount").alias("amount")
    )


MAP_SPEC = {
    "compute": {"net": "l_extendedprice * (1 - l_discount)", "year": "year(l_shipdate)"},
    "cast": {"l_quantity": "bigint", "l_linenumber": "string"},
    "rename": {"l_orderkey": "order_id", "l_quantity": "quantity"},
    "drop": ["l_tax", "l_comment", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"],
}

SAFE_TEXT = "concat(upper(substring(event_type, 1, 1)), lower(substring(event_type, 2, 50)), '-', coalesce(props, '(none)'))"


def _resolve_and_align(t: Inputs):
    rows = t["customer"].toDF("C_CustKey", "c_NAME", "extra", "C_ACCTBAL", "C_mktsegment")
    return align_to_table(
        resolve_columns(rows, ["c_custkey", "c_name", "c_mktsegment"]),
        t["customer"].select("c_mktsegment", "c_custkey", "c_nationkey", "c_name").schema,
    )


def _resolve_columns(t: Inputs):
    rows = t["supplier"].toDF("S_KEY", "name", "NAME", "Balance")
    return resolve_columns(rows, ["s_key", "Name"]).select("s_key", F.col("Name").alias("name_nation"), "Balance")


def _mask_columns(t: Inputs):
    rows = t["customer"].select(
        "c_custkey", F.col("c_mktsegment").alias("general"), F.col("c_name").alias("person"),
        F.concat(F.lit("0571"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"),
        F.concat(F.lit("139"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("tel"),
        F.concat(F.lower("c_mktsegment"), F.lit("@mail.example"), F.col("c_custkey").cast("string")).alias("email"),
        F.col("c_custkey").cast("string").alias("id_card"), F.col("c_name").alias("bank_card"),
        F.col("c_mktsegment").alias("password"),
    )
    return mask_columns(rows, {
        "general": "GENERAL", "person": "NAME", "phone": "PHONE", "tel": "TEL", "email": "EMAIL", "id_card": "ID_CARD",
        "bank_card": "BANK_CARD", "password": "PASSWORD",
    })


QUERIES = {
    "b1_normalize_types": _normalize_types,
    "b2_format_change_times": _format_change_times,
    "b3_decode_binary": _decode_binary,
    "b4_double_to_decimal": _double_to_decimal,
    "b5_normalize_document": _normalize_document,
    "b6_drop_null_fields": _drop_null_fields,
    "b7_filter_rows": _filter_rows,
    "b7_filter_query_rows": lambda t: filter_rows(t["orders"], "o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus <> 'F'"),
    "b8_map_rows": lambda t: map_rows(t["lineitem"], MAP_SPEC),
    "b9_safe_expr": lambda t: safe_expr(t["events"].select("event_id", "event_type", "props"), "label", SAFE_TEXT),
    "b10_resolve_columns": _resolve_columns,
    "b11_align_to_table": _resolve_and_align,
    "b12_mask_columns": _mask_columns,
    "b12_mask_texts": lambda t: mask_columns(t["documents"].select("doc_id", "text", "lang"), {"text": "GENERAL", "lang": "GENERAL"}),
    "b13_preview": lambda t: preview(t["documents"], 200, 100, ["doc_id"]),
    "b13_preview_all": lambda t: preview(t["pages"], -1, 1000),
}


def _stars(col: str, head: int, tail: int) -> str:
    return (
        f"CASE WHEN length({col}) < {head + tail} THEN repeat('*', length({col})) ELSE "
        f"left({col}, {head}) || repeat('*', length({col}) - {head + tail}) || right({col}, {tail}) END"
    )


def _general(col: str) -> str:
    return (
        f"CASE WHEN length({col}) < 3 THEN repeat('*', length({col})) WHEN length({col}) < 6 "
        f"THEN left({col}, 1) || repeat('*', length({col}) - 2) || right({col}, 1) "
        f"ELSE left({col}, 2) || repeat('*', length({col}) - 4) || right({col}, 2) END"
    )


def _cut(col: str, n: int) -> str:
    return (
        f"CASE WHEN length({col}) > {n} THEN left({col}, {n}) || '......[' || cast(length({col}) - {n} AS STRING) "
        f"|| '个字符被截断]' ELSE {col} END AS {col}"
    )


_ISO = "rtrim(rtrim(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
_CLOCK = "(timestamp '1970-01-01' + to_microseconds(event_id * 123456000 % 86400000000))"

ORACLES = {
    "b1_normalize_types": """
        SELECT o_orderkey, cast(cast(o_orderdate AS DATE) AS TIMESTAMP) AS d, o_orderdate AS ts, o_totalprice FROM orders""",
    "b2_format_change_times": f"""
        SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
               rtrim(rtrim(strftime({_CLOCK}, '%H:%M:%S.%f'), '0'), '.') AS clock,
               {_ISO.format('ts')} AS at, {_ISO.format("date_trunc('second', ts) + interval '8' hour")} AS utc
        FROM events""",
    "b3_decode_binary": "SELECT doc_id, md5(text) AS body_md5, strlen(text) AS n_bytes FROM documents",
    "b4_double_to_decimal": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               cast(cast(cast(l_extendedprice AS STRING) AS DECIMAL(20,4)) AS STRING) AS l_extendedprice,
               cast(cast(cast(l_discount AS STRING) AS DECIMAL(20,4)) AS STRING) AS l_discount
        FROM lineitem""",
    "b5_normalize_document": """
        SELECT p_partkey AS id, cast(p_partkey AS STRING) AS oid, p_retailprice AS price, p_size AS size,
               timestamp '2023-11-14 22:13:20' + to_seconds(p_partkey) + interval '8' hour AS seen, p_name AS name,
               p_brand AS brand, cast(p_partkey * 3 AS STRING) || '|' || p_type AS codes, '{"$oid":"a","x":1}' AS pair,
               1.5::DOUBLE AS ratio, '{"k":1}' AS quoted, cast(NULL AS STRING) AS absent
        FROM part""",
    "b6_drop_null_fields": """
        SELECT p_partkey, concat_ws(',', 'brand=' || p_brand, CASE WHEN p_size > 20 THEN 'size=' || cast(p_size AS STRING) END,
                                    CASE WHEN p_type <> 'ECONOMY' THEN 'type=' || p_type END) AS fields
        FROM part""",
    "b7_filter_rows": "SELECT seq, op, key, amount FROM changes WHERE op <> 'DELETE' AND amount > 100 AND key % 2 = 0",
    "b7_filter_query_rows": """
        SELECT * FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 200000 AND o_orderstatus IN ('O', 'P')""",
    "b8_map_rows": """
        SELECT l_orderkey AS order_id, l_partkey, l_suppkey, cast(l_linenumber AS STRING) AS l_linenumber,
               cast(l_quantity AS BIGINT) AS quantity, l_extendedprice * (1 - l_discount) AS net, year(l_shipdate) AS year
        FROM lineitem""",
    "b9_safe_expr": """
        SELECT event_id, event_type, props, upper(left(event_type, 1)) || lower(substr(event_type, 2)) || '-' || props AS label
        FROM events""",
    "b10_resolve_columns": "SELECT s_suppkey AS s_key, s_nationkey AS name_nation, s_acctbal AS Balance FROM supplier",
    "b11_align_to_table": """
        SELECT c_mktsegment, c_custkey, cast(NULL AS INTEGER) AS c_nationkey, c_name FROM customer""",
    "b12_mask_columns": f"""
        SELECT c_custkey, {_general('c_mktsegment')} AS general, left(c_name, 1) || repeat('*', length(c_name) - 1) AS person,
               {_stars("('0571' || lpad(cast(c_custkey AS STRING), 7, '0'))", 4, 2)} AS phone,
               {_stars("('139' || lpad(cast(c_custkey AS STRING), 8, '0'))", 3, 4)} AS tel,
               lower(left(c_mktsegment, 1)) || repeat('*', length(c_mktsegment) - 1) || '@mail.example'
               || cast(c_custkey AS STRING) AS email,
               {_stars("cast(c_custkey AS STRING)", 2, 2)} AS id_card, {_stars('c_name', 4, 4)} AS bank_card,
               repeat('*', length(c_mktsegment)) AS password
        FROM customer""",
    "b12_mask_texts": f"SELECT doc_id, {_general('text')} AS text, {_general('lang')} AS lang FROM documents",
    "b13_preview": f"""
        SELECT doc_id, {_cut('text', 100)}, {_cut('lang', 100)}, {_cut('source', 100)}, n_chars
        FROM documents ORDER BY doc_id LIMIT 200""",
    "b13_preview_all": f"SELECT page_id, {_cut('url', 1000)}, {_cut('html', 1000)} FROM pages",
}

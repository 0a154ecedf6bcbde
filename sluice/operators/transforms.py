"""Row transforms: types, filters, maps, masks. All are narrow (no shuffle), except ``preview``."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import iso_datetime, iso_time, mask, truncate_text

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def normalize_types(df: DataFrame) -> DataFrame:
    """Long text to string, any date or timestamp to a timestamp without zone; the rest unchanged."""
    def normal(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _TIMES):
            return col.cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, (T.CharType, T.VarcharType)):
            return col.cast("string").alias(field.name)
        return col

    return df.select(*[normal(f) for f in df.schema.fields])


def format_change_times(df: DataFrame, kinds: Mapping[str, str], zone: str = "UTC") -> DataFrame:
    """Time columns of change images as text.

    ``kinds`` maps a column to DATE (date or epoch day), TIME (microseconds of the day), DATETIME
    (no zone) or TIMESTAMP (UTC, shown in ``zone``).
    """
    def text(name: str, kind: str) -> Column:
        col = F.col(name)
        if kind == "DATE":
            day = col if isinstance(df.schema[name].dataType, T.DateType) else F.date_add(F.lit("1970-01-01"), col.cast("int"))
            return F.date_format(day, "yyyy-MM-dd")
        if kind == "TIME":
            return iso_time(col.cast("long"))
        if kind == "DATETIME":
            return iso_datetime(col)
        if kind == "TIMESTAMP":
            return iso_datetime(F.convert_timezone(F.lit("UTC"), F.lit(zone), col.cast("timestamp_ntz")))
        raise ValueError(f"unknown time kind {kind!r}")

    return df.withColumns({name: text(name, kind) for name, kind in kinds.items()})


def decode_binary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Base64 text of change images to bytes; binary columns stay."""
    text = [c for c in cols if not isinstance(df.schema[c].dataType, T.BinaryType)]
    return df.withColumns({c: F.unbase64(c) for c in text})


def double_to_decimal(df: DataFrame, cols: Sequence[str], precision: int = 38, scale: int = 10) -> DataFrame:
    """Doubles to the decimal of their shortest text; null if it does not fit."""
    return df.withColumns({c: F.col(c).cast("string").try_cast(f"decimal({precision},{scale})") for c in cols})


# Wrapper keys of extended JSON that hold a text.
_TEXT_WRAPPERS = ("$oid", "$numberLong", "$numberDecimal", "$binary")


def normalize_document(df: DataFrame, col: str, schema: T.StructType | str, zone: str = "+08:00") -> DataFrame:
    """Extended-JSON document text to a typed struct.

    An object with one of the wrapper keys and no other key becomes its text, ``$date`` (in
    milliseconds) the local time in ``zone``. Other objects and arrays follow ``schema``; an
    object where the schema asks for a string stays JSON text.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # parsed once per row, and each nested value is bound once for all its readings
    parsed = df.withColumn(col, F.try_parse_json(F.col(col)))
    return parsed.withColumn(col, _bind(F.col(col), lambda v: _document_value(v, schema, zone)))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def _document_value(value: Column, kind: T.DataType, zone: str) -> Column:
    if isinstance(kind, T.StructType):
        def member(members: Column, field: T.StructField) -> Column:
            inside = F.try_element_at(members, F.lit(field.name))
            return _bind(inside, lambda v: _document_value(v, field.dataType, zone)).alias(field.name)

        return _bind(
            F.try_variant_get(value, "$", "map<string,variant>"),
            lambda m: F.when(m.isNotNull(), F.struct(*[member(m, field) for field in kind.fields])),
        )
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.transform(items, lambda item: _document_value(item, kind.elementType, zone))
    return _bind(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _document_leaf(value, m, kind, zone))


def _document_leaf(value: Column, members: Column, kind: T.DataType, zone: str) -> Column:
    """A plain value, or the only member of a wrapper object."""
    def inner(key: str, as_type: str) -> Column:
        return F.when(F.size(members) == 1, F.try_variant_get(F.try_element_at(members, F.lit(key)), "$", as_type))

    if isinstance(kind, _TIMES):
        millis = F.coalesce(inner("$date", "bigint"), inner("$date", "string").try_cast("bigint"))
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(millis).cast("timestamp_ntz"))
        return F.coalesce(local, F.try_variant_get(value, "$", "string").try_cast("timestamp_ntz")).cast(kind)
    unwrapped = F.coalesce(*[inner(key, "string") for key in _TEXT_WRAPPERS])
    if isinstance(kind, T.StringType):
        plain = F.when(members.isNotNull(), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
        return F.coalesce(unwrapped, plain)
    return F.coalesce(unwrapped.try_cast(kind), F.try_variant_get(value, "$", kind.simpleString()))


def drop_null_fields(df: DataFrame, struct_col: str, out: str | None = None) -> DataFrame:
    """A change image as a map of its non-null fields (values as text)."""
    names = df.schema[struct_col].dataType.names
    values = [F.col(f"{struct_col}.`{n}`").cast("string") for n in names]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    filled = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return df.withColumn(out or struct_col, F.when(F.col(struct_col).isNotNull(), filled))


def filter_rows(df: DataFrame, condition: str, image: str | None = None) -> DataFrame:
    """Keep rows that satisfy a SQL condition; unknown counts as no.

    With ``image`` the condition reads the fields of that change image, without it the columns.
    """
    if image is None:
        return df.filter(F.expr(condition))
    return (
        df.select(F.struct("*").alias("_row"), F.col(f"{image}.*"))
        .filter(F.expr(condition))
        .select("_row.*")
    )


def map_rows(df: DataFrame, spec: Mapping[str, Mapping[str, str] | Sequence[str]]) -> DataFrame:
    """Reshape rows: ``compute`` {new: SQL}, ``cast`` {column: type}, ``rename`` {old: new}, ``drop`` [columns].

    The parts run in that order; computed columns see the columns before renaming.
    """
    computed = df.withColumns({n: F.expr(e) for n, e in dict(spec.get("compute", {})).items()})
    typed = computed.withColumns({n: F.col(n).try_cast(t) for n, t in dict(spec.get("cast", {})).items()})
    return typed.withColumnsRenamed(dict(spec.get("rename", {}))).drop(*spec.get("drop", ()))


# Helper functions an expression may call without asking.
SAFE_FUNCTIONS = frozenset(
    "abs coalesce concat concat_ws current_date date_add date_format date_sub datediff get_json_object greatest if "
    "ifnull initcap instr least left length lower lpad ltrim nullif nvl regexp_extract regexp_replace repeat replace "
    "reverse right round rpad rtrim split substring to_date to_timestamp trim unix_timestamp upper uuid year month day "
    "cast try_cast in and or not when then else case between like".split()
)


def safe_expr(df: DataFrame, name: str, sql_text: str, allow: Collection[str] = SAFE_FUNCTIONS) -> DataFrame:
    """Add a user expression whose function calls are all on the allow-list.

    The calls are taken from the parsed expression, so no quoting, comment or qualified name can hide one;
    subqueries are refused.
    """
    allowed, refused = {a.lower() for a in allow}, set()
    try:
        open_nodes = [df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(sql_text)]
    except Exception as error:
        raise ValueError(f"not an expression: {sql_text}") from error
    while open_nodes:
        node = open_nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = node.nameParts()
            called = ".".join(parts.apply(i) for i in range(parts.size())).lower()
            if called not in allowed:
                refused.add(called)
        elif "Subquery" in kind or kind in ("Exists", "ListQuery"):
            refused.add("select")
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.size())]
    if refused:
        raise ValueError(f"not allowed in an expression: {sorted(refused)}")
    return df.withColumn(name, F.expr(sql_text))


def resolve_columns(df: DataFrame, target_cols: Sequence[str], ignore_case: bool = True) -> DataFrame:
    """Columns under the names of the target; of names differing only by case the later one wins.

    Columns the target does not know keep their name.
    """
    key = (lambda n: n.lower()) if ignore_case else (lambda n: n)
    wanted = {key(n): n for n in target_cols}
    position = {key(n): i for i, n in enumerate(df.columns)}
    # give every column a unique temporary name, so that names differing by case stay apart
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[
        F.col(f"_c{i}").alias(wanted.get(k, df.columns[i])) for k, i in position.items()
    ])


def align_to_table(df: DataFrame, target_schema: T.StructType) -> DataFrame:
    """Target columns in target order: missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target_schema.fields
    ])


def mask_columns(df: DataFrame, masks: Mapping[str, str]) -> DataFrame:
    """Hide parts of text columns: ``{column: mask type}``."""
    return df.withColumns({name: mask(F.col(name), kind) for name, kind in masks.items()})


def preview(
    df: DataFrame, rows: int | None = 200, max_len: int | None = 1000, order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """First rows with long texts cut. -1 or None lifts a limit; ``max_len`` 0 hides every value."""
    head = df.orderBy(*order_by) if order_by else df
    if rows is not None and rows != -1:
        head = head.limit(rows)
    if max_len == 0:
        return head.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return head.withColumns({name: truncate_text(F.col(name), max_len) for name in texts})

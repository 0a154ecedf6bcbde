"""Joins, lookups, searches and groupings used by the listing and report queries.

No join is forced to broadcast: Catalyst and AQE do so when a side's measured size allows it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage
from .templates import dynamic_where, page_with_total

# joined rows that a task makes and holds at once
PAIRS = 1 << 18


def distinct_join(
    tables: Mapping[str, DataFrame], joins: Sequence[tuple[str, str, str]], filters: Mapping[str, str], keep: Sequence[str]
) -> DataFrame:
    """Inner joins of several tables, distinct on ``keep``.

    ``joins`` = (table, its column, column so far) in order, the first entry only names the start
    table. ``filters`` run before the joins. Column names are unique over the tables. Columns that are
    needed neither later nor in the result are dropped and duplicates removed after each step.
    Start with the table that holds the kept codes: its links then shrink to distinct codes
    before the many rows of the last table meet them, and pairs never multiply.

    Both sides of a join are written first, so Catalyst knows their sizes and sends a small one to the other. The joined pairs are counted
    before the join, and the rows of the new table lie in as many partitions as the pairs ask for: few links with many rows each make no large tasks.
    """
    def source(name: str, needed: set[str]) -> DataFrame:
        df = tables[name]
        df = df.filter(F.expr(filters[name])) if name in filters else df
        return df.select(*[c for c in df.columns if c in needed]).distinct()

    def later(i: int) -> set[str]:
        return {*keep, *[so_far for _, _, so_far in joins[i:]]}

    current = source(joins[0][0], later(1))
    for i, (name, own, so_far) in enumerate(joins[1:], start=1):
        current, rows = stage(current, "joined"), stage(source(name, {own, *later(i + 1)}), "links")
        placed = _place_pairs(current, so_far, rows, own, [c for c in rows.columns if c in later(i + 1)])
        joined = current.join(placed, F.col(so_far) == F.col(own))
        current = joined.select(*[c for c in joined.columns if c in later(i + 1)]).distinct()
    return current.select(*keep).distinct()


def _place_pairs(left: DataFrame, key: str, right: DataFrame, right_key: str, kept: Sequence[str]) -> DataFrame:
    """``right`` in partitions that join to about ``PAIRS`` rows each.

    By the values of ``kept`` columns, so that equal pairs meet where they are made; by whole rows if one value alone has more pairs.
    """
    weights = left.groupBy(F.col(key).alias(right_key)).agg(F.count(F.lit(1)).alias("_pairs"))
    by_value = right.join(weights, right_key).groupBy(*kept).agg(F.sum("_pairs").alias("_pairs"))
    pairs, most = by_value.agg(F.sum("_pairs"), F.max("_pairs")).first()
    n = max(-(-(pairs or 0) // PAIRS), left.sparkSession.sparkContext.defaultParallelism)
    return right.repartition(n, *(kept if kept and (most or 0) <= PAIRS else right.columns))


def exists_any(left: DataFrame, links: DataFrame, key: str, code: str, codes: Sequence[str]) -> DataFrame:
    """Each row with a flag: is one of its linked rows in ``codes``."""
    hits = links.filter(F.col(code).isin(list(codes))).select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    return left.join(hits, key, "left").select(*left.columns, F.col("_hit").isNotNull().alias("has_any"))


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows whose key is not among the right keys; an empty right side keeps all rows."""
    return left.join(right.select(F.col(right_key or key).alias(key)), key, "left_anti")


def member_page(
    members: DataFrame, users: DataFrame, params: Mapping, current: int = 1, size: int = 10, key: str = "user_id",
    name: str = "username", order_by: Sequence[tuple[str, bool]] = (("user_id", False),),
) -> DataFrame:
    """Members with their user data, optionally by ``keyword`` and without ``exclude_user``, one page and total."""
    joined = dynamic_where(members.join(users, key), [
        ("keyword", lambda v: F.col(name).contains(v)),
        ("exclude_user", lambda v: F.col(key) != v),
    ], params)
    return page_with_total(joined, current, size, order_by)


def top_groups(df: DataFrame, key: str, ts: str, start, end, n: int = 6) -> DataFrame:
    """The ``n`` most frequent groups of an inclusive time range; ties by key."""
    kind = df.schema[ts].dataType
    inside = df.filter(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    return inside.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), key).limit(n)


def conditional_counts(df: DataFrame, flags: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Total and one sum per named condition in a single pass; sums over no rows are null."""
    sums = [F.sum(F.when(F.expr(c), 1).otherwise(0)).alias(name) for name, c in flags.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *sums)


def rank_column(col: str, ranks: Mapping[str, int], default: int) -> Column:
    """CASE rank of a column; values without a rank get ``default``."""
    return reduce(lambda acc, item: acc.when(F.col(col) == item[0], item[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(default)


def custom_order(
    df: DataFrame, col: str, ranks: Mapping[str, int], then: Sequence[tuple[str, bool]], default: int | None = None
) -> DataFrame:
    """Sort by a CASE rank, then by (column, descending) pairs."""
    rank = rank_column(col, ranks, default if default is not None else max(ranks.values()) + 1)
    return df.orderBy(rank, *[F.col(c).desc() if desc else F.col(c).asc() for c, desc in then])


def enrich(df: DataFrame, lookup: DataFrame, key: str, cols: Sequence[str], lookup_key: str | None = None) -> DataFrame:
    """Add columns of a lookup (unique key); rows without a match stay."""
    side = lookup.select(F.col(lookup_key or key).alias(key), *cols)
    return df.join(side, key, "left")


def contributors(
    records: DataFrame, log: DataFrame, current_user, n: int = 6, record: str = "record_id", creator: str = "creator",
    user: str = "user_id",
) -> DataFrame:
    """Per record up to ``n`` distinct users: creator, then the current user if among them, then by id.

    Users are made distinct before the shuffle, and the top-n filter prunes each partition first.
    """
    edits = log.select(F.col(record), F.col(user)).distinct()
    rank = (
        F.when(F.col(user) == F.col(creator), 0).when(F.col(user) == F.lit(current_user), 1).otherwise(2)
    )
    listed = (
        records.select(record, creator)
        .withColumn(user, F.explode(F.array(creator)))
        .unionByName(records.select(record, creator).join(edits, record).filter(F.col(user) != F.col(creator)))
        .withColumn("_rank", rank)
    )
    first = Window.partitionBy(record).orderBy("_rank", user)
    chosen = listed.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n)
    users = chosen.groupBy(record).agg(F.sort_array(F.collect_list(F.struct("_n", user)))[user].alias("users"))
    return records.join(users, record, "left")


def version_join(
    records: DataFrame, versions: DataFrame, statuses: Sequence[str], cols: Sequence[str], code: str = "code",
    version: str = "version", published: str = "publish_version", status: str = "status",
) -> DataFrame:
    """Each record with its published version, if that version has one of ``statuses``."""
    live = versions.filter(F.col(status).isin(list(statuses))).select(
        F.col(code), F.col(version).alias(published), *cols
    )
    return records.join(live, [code, published], "left")


def json_contains(df: DataFrame, json_col: str, value: str, first_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose JSON array column holds a value; with ``first_by`` the first such row only."""
    hits = df.filter(F.array_contains(F.from_json(json_col, "array<string>"), value))
    return hits.orderBy(*first_by).limit(1) if first_by else hits


def json_values(df: DataFrame, json_col: str, field: str, out: str = "value") -> DataFrame:
    """Distinct non-blank text values of a field at any depth, per row of the other columns.

    In valid JSON an unescaped quoted name before a colon is always a key, so one scan of the text
    finds every depth.
    """
    name = "\\Q" + field.replace("\\E", r"\E\\E\Q") + "\\E"  # the name as it is, not as a pattern
    pattern = rf'(?<!\\)"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"'
    raw = F.regexp_extract_all(F.col(json_col), F.lit(pattern), F.lit(1))
    decoded = F.transform(raw, lambda t: F.get_json_object(F.concat(F.lit('{"v":"'), t, F.lit('"}')), "$.v"))
    found = F.array_distinct(F.filter(decoded, lambda v: F.length(F.trim(v)) > 0))
    others = [c for c in df.columns if c != json_col]
    return df.select(*others, F.explode(found).alias(out))


def check_references(
    refs: DataFrame, registry: DataFrame, key: str, status: str = "status", enabled: str = "ENABLE"
) -> DataFrame:
    """Distinct referenced codes that are MISSING from the registry or DISABLED there."""
    known = registry.select(F.col(key), F.col(status).alias("_status"), F.lit(True).alias("_known"))
    verdict = F.when(F.col("_known").isNull(), "MISSING").when(~F.col("_status").eqNullSafe(enabled), "DISABLED")
    return (
        refs.distinct().join(known, key, "left").select(*refs.columns, verdict.alias("problem"))
        .filter(F.col("problem").isNotNull())
    )


def text_search(df: DataFrame, cols: Sequence[str], text: str) -> DataFrame:
    """Rows with ``text`` in one of the columns; no wildcard characters."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).contains(text) for c in cols]))


def log_search(
    df: DataFrame, eq: Mapping, like: Mapping[str, str], ts: str, start=None, end=None, current: int = 1, size: int = 10,
    tie_break: str = "id",
) -> DataFrame:
    """Optional equalities, contained texts and an inclusive time range; newest first, one page and total."""
    kind = df.schema[ts].dataType
    conditions = [
        *[((c, "eq"), lambda v, c=c: F.col(c) == v) for c in eq],
        *[((c, "like"), lambda v, c=c: F.col(c).contains(v)) for c in like],
        ("start", lambda v: F.col(ts) >= F.lit(v).cast(kind)),
        ("end", lambda v: F.col(ts) <= F.lit(v).cast(kind)),
    ]
    params = {
        **{(c, "eq"): v for c, v in eq.items()}, **{(c, "like"): v for c, v in like.items()}, "start": start, "end": end,
    }
    return page_with_total(dynamic_where(df, conditions, params), current, size, [(ts, True), (tie_break, True)])


def retain(df: DataFrame, now, ts: str | None = None, days: int | None = None, expiry: str | None = None) -> DataFrame:
    """Rows that stay: not older than ``days`` before ``now``, or not past their expiry (null never expires)."""
    if ts is not None:
        limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
        return df.filter(F.col(ts) >= limit.cast(df.schema[ts].dataType))
    kept = F.col(expiry) >= F.lit(now).cast(df.schema[expiry].dataType)
    return df.filter(F.col(expiry).isNull() | kept)


def nest_groups(df: DataFrame, group: str, child: str, comment: str) -> DataFrame:
    """One row per group with its sorted children; the label of a child shows its comment.

    Children are distinct per group before the shuffle; a group is as large as the catalog entry
    it describes.
    """
    blank = F.length(F.trim(F.coalesce(F.col(comment), F.lit("")))) == 0
    label = F.when(blank, F.col(child)).otherwise(F.concat(child, F.lit("("), comment, F.lit(")")))
    rows = df.select(group, F.struct(F.col(child).alias("key"), label.alias("label")).alias("_child")).distinct()
    return rows.groupBy(group).agg(F.sort_array(F.collect_list("_child")).alias("children"))


def ordered_group_columns(df: DataFrame, group: Sequence[str], seq: str, col: str, flags: Sequence[str] = ()) -> DataFrame:
    """Index rows to one row per index with its columns in sequence order."""
    return df.groupBy(*group, *flags).agg(
        F.sort_array(F.collect_list(F.struct(seq, col)))[col].alias("columns")
    )


def catalog_tables(spark: SparkSession, exclude: Sequence[str] = ("information_schema", "sys")) -> dict[str, DataFrame]:
    """Tables of the session catalog outside system schemas, as ``schema.table``; views of the session by name."""
    found = {}
    for schema in spark.catalog.listDatabases():
        if schema.name in exclude:
            continue
        for table in spark.catalog.listTables(schema.name):
            name = table.name if table.isTemporary else f"{schema.name}.{table.name}"
            found[name] = spark.table(name)
    return found


def describe_source(
    spark: SparkSession, tables: Mapping[str, DataFrame], exclude: Sequence[str] = (), count_nulls: bool = False
) -> DataFrame:
    """Tables of a source with their columns: position, name, type, nullable.

    With ``count_nulls`` the tables are scanned and ``nulls`` tells how many values are missing.
    """
    frames = []
    for name, df in tables.items():
        if name in exclude:
            continue
        entries = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"),
                *([(F.count(F.lit(1)) - F.count(F.col(f"`{f.name}`"))).alias("nulls")] if count_nulls else []),
            )
            for i, f in enumerate(df.schema.fields, start=1)
        ]
        rows = df if count_nulls else spark.range(1)
        frames.append(rows.agg(F.array(*entries).alias("_columns")).select(F.inline("_columns")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def record_authority(
    users: DataFrame, grants: DataFrame, record_type: str, record_id, key: str = "user_id"
) -> DataFrame:
    """Every user with the write and publish authority on one record; no grant means neither."""
    mine = grants.filter((F.col("record_type") == record_type) & (F.col("record_id") == record_id)).groupBy(key).agg(
        F.max("can_write").alias("_write"), F.max("can_publish").alias("_publish")
    )
    return users.join(mine, key, "left").select(
        *users.columns,
        F.coalesce("_write", F.lit(False)).alias("can_write"),
        F.coalesce("_publish", F.lit(False)).alias("can_publish"),
    )

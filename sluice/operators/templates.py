"""Query templates: bound parameters, optional conditions, paging with totals."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import average_cost, percent
from ..sources.paging import page_query

_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")
_LITERAL = re.compile(r"""[rR]'[^']*'|[rR]"[^"]*"|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""")


def template_query(spark: SparkSession, text: str, params: Mapping) -> DataFrame:
    """SQL text with ``${name}`` placeholders; values are bound, never spliced into the text."""
    for literal in _LITERAL.findall(text):
        if _PLACEHOLDER.search(literal):
            raise ValueError(f"a placeholder inside a literal is not bound: {literal}")
    names = set(_PLACEHOLDER.findall(text))
    missing = sorted(names - set(params))
    if missing:
        raise ValueError(f"no value for {missing}")
    return spark.sql(_PLACEHOLDER.sub(r":\1", text), args={n: params[n] for n in names})


def is_set(value) -> bool:
    """A parameter counts as given if it is not null, not blank and not an empty list."""
    if isinstance(value, str):
        return bool(value.strip())
    return value is not None and value != []


def dynamic_where(df: DataFrame, conditions: Sequence[tuple], params: Mapping) -> DataFrame:
    """Fold of optional filters: ``(parameter, function(value) -> Column)`` pairs."""
    for name, condition in conditions:
        if is_set(params.get(name)):
            df = df.filter(condition(params[name]))
    return df


def query_one(df: DataFrame) -> DataFrame:
    return df.limit(1)


def query_list(df: DataFrame) -> DataFrame:
    return df


def query_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def _ordering(orders: Sequence[tuple[str, bool]]) -> list:
    return [F.col(c).desc() if desc else F.col(c).asc() for c, desc in orders]


def page_with_total(
    df: DataFrame, current: int = 1, size: int = 10, orders: Sequence[tuple[str, bool]] = ()
) -> DataFrame:
    """One page with the total row count beside each row; ``orders`` are (column, descending) and required.

    A page past the end is one row of nulls with the total.
    """
    if not orders:
        raise ValueError("a page needs an order")
    totals = query_count(df)
    page = page_query(df, _ordering(orders), current, size).withColumn("total", totals.scalar())
    empty = totals.filter(F.col("total") <= (current - 1) * size)
    return page.unionByName(empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], "total"))


query_page = page_with_total


def query_log_stats(log: DataFrame) -> DataFrame:
    """Per template: calls, errors, cache hits, hit rate in percent, total rows and average cost.

    Expects ``template, cost, number, hit_cache, status``.
    """
    calls = F.count(F.lit(1))
    return log.groupBy("template").agg(
        calls.alias("calls"),
        F.count_if(F.col("status") != "SUCCESS").alias("errors"),
        F.count_if(F.col("hit_cache")).alias("cache_hits"),
        percent(F.count_if(F.col("hit_cache")), calls).alias("hit_rate"),
        F.sum("number").alias("rows"),
        average_cost(F.col("cost")).alias("avg_cost"),
    )

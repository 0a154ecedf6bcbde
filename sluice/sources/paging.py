"""Paging: one page, every page, and keyset (scroll) paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import number_rows

def page_query(df: DataFrame, order_by: Sequence[str | Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows, sorted, as a top-k query: each task keeps its first ``page * size`` rows.

    For the pages people turn to. Far into a large table use :func:`deep_page_query`.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order_by).offset((page - 1) * size).limit(size)


def deep_page_query(
    df: DataFrame, order_by: Sequence[str | Column], page: int, size: int, out: str = "position"
) -> DataFrame:
    """The same page with the ``out`` position of its rows, by numbering: no task ever holds the skipped rows.

    ``order_by`` has to be unique. The table is range-partitioned and staged once (see :func:`number_rows`).
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    first = (page - 1) * size
    numbered = number_rows(df, order_by, out=out)
    return numbered.filter((F.col(out) > first) & (F.col(out) <= first + size)).orderBy(out)


def assign_pages(df: DataFrame, order_by: Sequence[str | Column], size: int, out: str = "page_no") -> DataFrame:
    """Every row with the number of its page; ``order_by`` has to be unique."""
    return (
        number_rows(df, order_by, out="_position")
        .withColumn(out, F.floor((F.col("_position") - 1) / size) + 1)
        .drop("_position")
    )


def _scroll_column(df: DataFrame, scroll_col: str) -> str:
    """The scroll column is matched ignoring case."""
    for name in df.columns:
        if name.lower() == scroll_col.lower():
            return name
    raise ValueError(f"scroll column {scroll_col!r} is not in {df.columns}")


def scroll_query(
    df: DataFrame, scroll_col: str, size: int, after=None, order_by: Sequence[tuple[str, bool]] = ()
) -> DataFrame:
    """Next page behind ``after``; the bound reaches the scan.

    Ascending by the unique scroll column, or by the caller's ``order_by`` of (column, descending), which has to
    name it. The first page has no bound, so rows without a scroll value come on it, first.
    """
    name = _scroll_column(df, scroll_col)
    if order_by and name.lower() not in {c.lower() for c, _ in order_by}:
        raise ValueError(f"the order lacks the scroll column {name!r}")
    rest = df if after is None else df.filter(F.col(name) > F.lit(after))
    orders = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order_by] or [F.col(name).asc_nulls_first()]
    return rest.orderBy(*orders).limit(size)


def scroll_pages(df: DataFrame, scroll_col: str, size: int, ties: Sequence[str | Column] = ()) -> DataFrame:
    """All pages a scroll would visit, at once. Rows without a scroll value come first, among themselves by ``ties``."""
    return assign_pages(df, [F.col(_scroll_column(df, scroll_col)).asc_nulls_first(), *ties], size)

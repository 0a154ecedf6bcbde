"""Boilerplate lines by their frequency relative to the pages of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import scratch_name, stage

# what is cut from both ends of a line before lines are compared
BLANKS = " \t\r"
# Share of a site's pages beyond which a line is boilerplate. In the given documents lines of their own are on a few pages of hundreds, and the
# frequencies of repeated ones fall off between half a percent and five; at this share 4 % of all lines go, at a tenth 0.7 %.
RATIO = (3, 200)


def _site(host_col: str) -> Column:
    """The host as a key; a null host is a site of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))


def _line_keys(text_col: str) -> Column:
    """One digest per line of the text, null for blank lines."""
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(trimmed, lambda x: F.when(x != "", F.md5(x.cast("binary"))))


def boilerplate_lines(
    docs: DataFrame, host_col: str, text_col: str, ratio: tuple[int, int] = RATIO, min_pages: int = 5,
) -> DataFrame:
    """(site, digest, pages, total): lines on more than ``ratio`` of a site's pages and on ``min_pages`` at least.

    A page counts once for a line however often it repeats it. Distinct lines are taken inside the row, so the only
    shuffle carries (site, digest) counts that were combined before it; a hot site spreads over its lines.
    """
    pages = docs.select(_site(host_col).alias("site"), F.explode(F.array_distinct(F.array_compact(_line_keys(text_col)))).alias("digest"))
    pages = pages.groupBy("site", "digest").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(_site(host_col).alias("site")).agg(F.count("*").alias("total"))
    return pages.join(totals, "site").where(F.col("pages") * ratio[1] > F.col("total") * ratio[0])


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: tuple[int, int] = RATIO, min_pages: int = 5,
    spare_copies: bool = False,
) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines cut from the text, and (n_lines, n_dropped).

    Lines are compared without blanks at their ends; blank lines always stay, in place and as they are. A null host is a site; a
    null text stays null with n_lines 0 and counts as a page of its site; a text of boilerplate only becomes empty. Repeated
    rows count as pages of their own. Sites with fewer than ``min_pages`` pages lose nothing. Input columns named n_lines or
    n_dropped are replaced. With ``spare_copies`` a page that would be left without any line stays as it is: where whole pages repeat, that
    is for a comparison of pages to settle. Lists of a site's lines are at most ``lines per page / ratio`` long, since each of them is
    on that share of the pages; they are written first, so Catalyst picks the join by their real size.
    """
    found = boilerplate_lines(docs, host_col, text_col, ratio, min_pages)
    lists = stage(found.groupBy("site").agg(F.collect_list("digest").alias("drop")), "boilerplate")
    site, drop, hits = scratch_name("site"), scratch_name("drop"), scratch_name("hits")
    keys = _line_keys(text_col)
    joined = docs.withColumn(site, _site(host_col)).join(
        lists.select(F.col("site").alias(site), F.col("drop").alias(drop)), site, "left")
    joined = joined.withColumn(hits, F.when(F.col(drop).isNotNull(), F.array_intersect(F.array_compact(keys), F.col(drop))))
    digest = lambda x: F.md5(F.btrim(x, F.lit(BLANKS)).cast("binary"))
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col(hits), digest(x)))
    touched = F.coalesce(F.size(hits) > 0, F.lit(False)) & F.col(hits).isNotNull()
    if spare_copies:
        touched = touched & F.exists(kept, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rest = F.when(touched, kept)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.withColumns({
        "n_lines": n_lines, "n_dropped": F.when(touched, n_lines - F.size(rest)).otherwise(0).cast("long"),
        text_col: F.when(touched, F.array_join(rest, "\n")).otherwise(F.col(text_col)),
    }).drop(site, drop, hits)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS site, text, string_split(text, chr(10)) AS ls FROM documents),
seen AS (SELECT site, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> ''))) AS k FROM d),
pages AS (SELECT site, k, count(*) AS n FROM seen GROUP BY ALL),
totals AS (SELECT site, count(*) AS total FROM d GROUP BY site),
drops AS (SELECT site, k FROM pages JOIN totals USING (site) WHERE n >= 5 AND n * 200 > total * 3),
lines AS (SELECT r, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
marked AS (SELECT l.r, l.line, l.pos, drops.k IS NOT NULL AS gone FROM lines l
    LEFT JOIN drops ON drops.site = l.site AND drops.k = trim(l.line, chr(32) || chr(9) || chr(13))),
rest AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(rest.n_lines, 0) AS n_lines, coalesce(rest.n_dropped, 0) AS n_dropped,
    CASE WHEN d.text IS NOT NULL THEN rest.text END AS text FROM d LEFT JOIN rest USING (r)
"""

"""Licence texts by the digest of their canonical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .licence_texts import KNOWN, SPELLINGS

# a copyright line names a holder after a sign or a year; sentences that begin with the word are text of the licence
COPYRIGHT = r"(^|\n)[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<year>|\[yyyy\])|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
# what parts words; line ends are kept apart so that lines can be looked up too
PARTS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text without case, punctuation and copyright lines, in equal spellings, line by line.

    Every word stands between two spaces of its own, so a spelling is replaced wherever it is a whole word.
    """
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    plain = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(plain, PARTS, "  "), r" *\n *", "  \n  "), F.lit("  "))
    return reduce(lambda out, pair: F.replace(out, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, plain)


def canonical_text(lines: Column) -> Column:
    """A canonical text as one line of words."""
    return F.btrim(F.regexp_replace(lines, r"\s+", " "))


def known_digests(spark, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(licence, digest) of the known texts; their number is fixed by the list."""
    table = spark.createDataFrame(known, "licence string, text string")
    return table.select("licence", F.md5(canonical_text(canonical_lines(F.col("text"))).cast("binary")).alias("digest")).distinct()


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(doc_id, digest, licence, notices) per row: the licence that the entire text is, and those that entire lines are.

    The digest of the canonical text is hash-joined to the known digests; lines are canonical texts of their own and looked up by
    the same digests. ``notices`` are the licence names of the lines, sorted and joined by commas (null: none). A null text has no
    digest and no licence; a text without words has the digest of the empty text, which no licence has. Repeated rows each give
    a row; an empty table gives none. Texts are read once and not shuffled: the joined side is the fixed list.
    """
    spark = docs.sparkSession
    table = F.broadcast(known_digests(spark, known))  # as many rows as the list
    names = F.create_map(*[F.lit(v) for r in table.collect() for v in (r["digest"], r["licence"])])
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    digests = F.array_distinct(F.transform(
        F.filter(F.transform(F.split("lines", "\n"), lambda x: canonical_text(x)), lambda x: x != ""), lambda x: F.md5(x.cast("binary"))))
    rows = lines.select("doc_id", F.md5(canonical_text(F.col("lines")).cast("binary")).alias("digest"), digests.alias("parts"))
    found = F.transform(F.array_intersect("parts", F.map_keys(names)), lambda d: F.element_at(names, d))
    rows = rows.select("doc_id", "digest", F.nullif(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")).alias("notices"))
    return rows.join(table, "digest", "left").select("doc_id", "digest", "licence", "notices")


def oracle(known: list[tuple[str, str]] = KNOWN) -> str:
    """The same rows as SQL text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, '\\1', 'g')"
        out = f"'  ' || regexp_replace(regexp_replace({out}, {quoted(PARTS)}, '  ', 'g'), ' *\\n *', chr(32) || chr(32) || chr(10) || chr(32) || chr(32), 'g') || '  '"
        return reduce(lambda x, pair: f"replace({x}, ' {pair[0]} ', ' {pair[1]} ')", SPELLINGS, out)

    flat = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known)
    return f"""
WITH known AS (SELECT DISTINCT licence, md5({flat.format(lines('text'))}) AS digest FROM (VALUES {rows}) AS k(licence, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines('text')} AS ls FROM documents),
parts AS (SELECT DISTINCT r, {flat.format('p')} AS p FROM (SELECT r, unnest(string_split(ls, chr(10))) AS p FROM d)),
notices AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM parts JOIN known ON md5(p) = digest WHERE p <> '' GROUP BY r),
whole AS (SELECT r, doc_id, md5({flat.format('ls')}) AS digest FROM d)
SELECT doc_id, digest, licence, notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)
"""

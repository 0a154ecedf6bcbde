"""What each of several filters removes, in every order they can be applied in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, stage, text_batches

LETTERS = "ABCDE"
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
# bytes that continue a character in UTF-8
CONTINUED = bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> int:
    """Bit i is set if the text fails filter i of A to D.

    A: under 200 words; B: under half of the words are distinct; C: more than 2 of 100 characters are A-Z; D: holds one of #$%&*|.
    """
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    characters = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, CONTINUED)))
    marked = len(text.translate(None, MARKS)) < len(text)
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * characters) << 2 | marked << 3)


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Min-plus product: the step at which each mask is removed in each order, one beyond the last where it fails nothing.

    ``masks`` (mask by filter) is 0 where the filter fails and beyond every step elsewhere; ``places`` (order by filter) is the
    inverse permutation of each order: at which step the filter comes.
    """
    return np.minimum((masks[:, None, :] + places[None, :, :]).min(axis=2), places.shape[1] + 1)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters A to D look at the text (:func:`text_failures`); E fails a document whose text equals that of a smaller id anywhere in
    the table, removed or not (equality by sha256). Counts are of rows within the part.

    Method: a document is a mask of five bits, so a part is at most 32 masks with their numbers of documents, of good and of toxic
    ones, counted before any shuffle. Min-plus products of the masks and the inverse permutations of all 120 orders give
    the step that removes each mask; scatter sums weighted by those numbers give the rest. Work after the counts grows with the number of parts.

    Nulls: a null text is empty, a null part the empty string; a row without an id neither fails E nor makes others fail, and has no label. Rows repeated
    with one id are counted each and do not fail E through each other. An id with several label rows is good or toxic if one of them says so. An empty
    table has no part and gives no rows. Other columns are not read.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 2):
            texts = [t or b"" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([text_failures(t) for t in texts], pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["id", "part", "mask", "digest"])

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    found = stage(arrow_map(read, facts, f"id {dict(read.dtypes)['id']}, part string, mask int, digest binary"), "facts")
    # minima are combined before the shuffle, so a text of a third of all rows is a row per input partition; only texts under two ids are joined
    twice = stage(found.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least"), "twice")
    marks = stage(labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1"), "marks")
    masked = found.join(twice, "digest", "left").join(marks, "id", "left").select(
        "part", (F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counted = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # at most 32 rows a part
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return arrow_map(whole, _scattered, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                     "good_lost long, toxic_lost long, shapley long")


def order_table() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, the filter at each step, and the step of each filter (from 1)."""
    orders = list(permutations(range(len(LETTERS))))
    at = np.array(orders)
    places = np.argsort(at, axis=1) + 1
    return ["".join(LETTERS[i] for i in o) for o in orders], at, places


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, at, places = order_table()
    size = len(LETTERS)
    steps = np.arange(1, size + 1)
    fails = (np.arange(1 << size)[:, None] >> np.arange(size)) & 1
    removed_at = removal_steps(np.where(fails == 1, 0, size + 1), places)
    # mask by order by step: is it removed there; does it fail that step's filter though removed before
    here = removed_at[:, :, None] == steps
    late = (fails[:, at] == 1) & (removed_at[:, :, None] < steps)
    only = fails.sum(axis=1) == 1
    for batch in batches:
        for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            weights = np.zeros((3, 1 << size), dtype=np.int64)
            for m in masks:
                weights[:, m["mask"]] = m["n"], m["good"], m["toxic"]
            removed, good, toxic = np.tensordot(weights, here.astype(np.int64), axes=1)
            redundant = np.tensordot(weights[0], late.astype(np.int64), axes=1)
            unique = (weights[0][:, None] * (fails * only[:, None])).sum(axis=0)
            shared = np.zeros(size, dtype=np.int64)
            np.add.at(shared, at, removed)
            kept = weights[0].sum() - removed.cumsum(axis=1)
            columns = [kept, removed, redundant, unique[at], good, toxic, shared[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * (len(names) * size)), pa.array(np.repeat(names, size)), pa.array(np.tile(steps, len(names)), pa.int32()),
                 *(pa.array(c.ravel(), pa.int64()) for c in columns)],
                names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), masks AS (
  SELECT part, doc_id, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
  FROM words
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letter(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s.step, bit FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s JOIN letter ON x = substr(filter_order, s.step, 1)
), ranks AS (
  SELECT mask, filter_order, min(CASE WHEN mask & bit > 0 THEN step ELSE 6 END) AS gone
  FROM (SELECT DISTINCT mask FROM counted) m, steps GROUP BY mask, filter_order
), result AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone < step AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM counted JOIN ranks USING (mask) JOIN steps USING (filter_order) GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM result"""

"""Quality rules: robust multivariate outliers among text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, gamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, stage, text_batches

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
_CONTINUED = bytes(range(0x80, 0xC0))
_STEP = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 8
# transformed statistics, and the least standard deviation of each: most texts have none of the last three
DIMS = ("length", "symbols", "lines", "repeats")
FLOORS = (0.08, 0.05, 0.12, 0.12)
P = len(DIMS)
# parts that the rows of a cell are dealt into
SALTS = 32


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in an eight-word window found twice or more in the text, the first of them included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    total = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        total = (total ^ (total >> np.uint64(29))) * _STEP + codes[i:n + i]
    order = np.sort(total)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(total, twice))
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_statistics(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows, lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    points = len(text.translate(None, BLANKS + _CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), points, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One narrow row per text: id, language, source and the counts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 3):
            counts = np.array([text_statistics(t) for t in texts], dtype=np.int64).reshape(len(texts), len(names))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *(pa.array(counts[:, i]) for i in range(len(names)))],
                                             names=["doc_id", "lang", "source", *names])

    narrow = docs.select(F.col(id_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    return arrow_map(narrow, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang string, source string, "
                     + ", ".join(f"{n} long" for n in names))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 0
    while term > total * 1e-15:
        i += 1
        term *= z / (a + i)
        total += term
    return min(1.0, total * exp(-z) * z ** a / gamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _solved(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means, inverse covariances and determinants from sums over a subset; a row per cell, so NumPy works on whole batches."""
    pairs = [(i, j) for i in range(P) for j in range(i, P)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(keys), batch.num_columns)]
            n, first, second = cols[0], np.stack(cols[1:P + 1], 1), cols[P + 1:]
            mean = first / n[:, None]
            cov = np.zeros((len(n), P, P))
            for (i, j), s in zip(pairs, second):
                cov[:, i, j] = cov[:, j, i] = s / n - mean[:, i] * mean[:, j]
            cov = factor * cov + np.diag(np.square(FLOORS))
            inverse, det = np.linalg.inv(cov), np.linalg.det(cov)
            lists = [pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(inverse.reshape(len(n), -1)), pa.list_(pa.float64())), pa.array(det)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *lists], names=[*keys, "mean", "inverse", "det"])

    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return arrow_map(sums, run, f"{kinds}, mean array<double>, inverse array<double>, det double")


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)])


def _d2() -> Column:
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(P)]
    return sum((gap[i] * gap[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _with_cells(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their cell. The table, a row per cell, is repeated for each salt, so a hot cell is dealt to many tasks."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"])


def _distance(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``d2``, the squared Mahalanobis distance from their cell's estimate."""
    joined = _with_cells(rows, estimates.select(*keys, "mean", "inverse"), keys)
    return joined.withColumn("d2", _d2()).drop("mean", "inverse")


def quality_outliers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    share: float = 0.75, tail: float = 1e-7, min_rows: int = 40, steps: int = 4,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2) per row of ``docs``.

    Base rules fail a text with under 20 words or over 30 % of its words in repeated eight-word windows. The others get a vector: log of
    the mean word length, and the square roots of the shares of symbols, repeated lines and repeated words. Each language and
    source has a minimum-covariance-determinant estimate of them: from two starts (medians and median deviations; mean and
    covariance), concentration steps keep the ``share`` of nearest rows, and the smaller determinant wins. Then one reweighted
    step, and rows beyond the chi-square quantile of ``1 - tail`` are not kept. Covariances have a floor, as most texts have no
    symbols or repeats at all.

    Cells under ``min_rows`` rows are pooled by language, then all together; a pool that is still smaller judges nobody. Null languages and
    sources are values of their own. Null, empty and wordless texts fail the base rules. All rows and whole texts count; a
    step is two aggregations over narrow rows that combine before the shuffle, so a hot cell is a row per task.
    """
    base = stage(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    base = base.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    base = base.withColumns({
        "lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "x": F.when(~F.col("base_failed"), F.array(
            F.log(F.col("word_chars") / F.col("n_words")), F.sqrt(F.col("n_symbols") / F.col("word_chars")),
            F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / F.col("n_words"))))})
    good = base.where("NOT base_failed").select("lang", "source", "x", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_rows)
    pools = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    named = sizes.join(pools, "lang", "left").select("lang", "source", F.when(F.col("n") >= min_rows, F.concat(F.lit("cell"), "lang", F.lit("/"), "source"))
                                                     .when(F.col("pool") >= min_rows, F.concat(F.lit("lang"), "lang")).otherwise("all").alias("cell"))
    cells = stage(named, "cells")
    rows = stage(good.join(cells, ["lang", "source"]).select("cell", "salt", "x"), "vectors")
    ratio = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    medians = rows.groupBy("cell").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(P)]).alias("mean"))
    spread = _with_cells(rows, medians, ["cell"]).groupBy("cell", "mean").agg(F.array(*[
        F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 1000) for i in range(P)]).alias("mad"))
    inverse = F.array(*[1 / (F.pow(1.4826 * F.col("mad")[i], F.lit(2)) + FLOORS[i] ** 2) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    robust = spread.select(F.lit(0).alias("start"), "cell", "mean", inverse.alias("inverse"), F.lit(None).cast("double").alias("det"))
    plain = _solved(_sums(rows, ["cell"]), ["cell"], 1.0).select(F.lit(1).alias("start"), "cell", "mean", "inverse", "det")
    estimate = stage(robust.unionByName(plain), "estimate")
    starts = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = ["start", "cell"]
    for _ in range(steps):
        far = _distance(starts, estimate, keys)
        cut = stage(far.groupBy(*keys).agg(F.percentile_approx("d2", share, 1000).alias("cut")), "cut")
        estimate = stage(_solved(_sums(_with_cells(far, cut, keys).where("d2 <= cut"), keys), keys, ratio), "estimate")
    best = estimate.groupBy("cell").agg(F.min_by(F.struct("mean", "inverse"), F.struct("det", "start")).alias("e")).select("cell", "e.*")
    near = _distance(rows, stage(best, "estimate"), ["cell"]).where(F.col("d2") <= chi2_quantile(0.975, P))
    weighed = 0.975 / chi2_cdf(chi2_quantile(0.975, P), P + 2)
    final = stage(_solved(_sums(near, ["cell"]), ["cell"], weighed), "estimate")
    enough = stage(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("cell"), "enough")

    judged = base.join(cells, ["lang", "source"], "left").join(final.join(enough, "cell", "left_semi").select("cell", "mean", "inverse"), "cell", "left")
    limit = chi2_quantile(1 - tail, P)
    return judged.withColumn("distance2", _d2()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))).alias("kept"), "distance2")

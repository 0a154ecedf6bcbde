"""Compare two tables and derive the changes that repair the right one.

Which keys differ is decided on digests of their rows, added up per key: one narrow shuffle. To
show the differences rows of both sides are counted per distinct content; contents with equal counts
agree and drop out. There is no join, so copies of a key never multiply, and counts and sums combine
before the shuffle, so a hot key or many equal copies cost little.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import percent, shard_of


def _both_sides(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        left.select(*cols, one.alias("_l"), none.alias("_r"))
        .unionByName(right.select(*cols, none.alias("_l"), one.alias("_r")))
    )


def align_count(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row counts of both sides, in total or per group, and whether they agree."""
    return (
        _both_sides(left, right, by)
        .groupBy(*by)
        .agg(F.coalesce(F.sum("_l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("_r"), F.lit(0)).alias("right_rows"))
        .withColumn("equal", F.col("left_rows") == F.col("right_rows"))
    )


def _contents(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    compared = [c for c in (cols or left.columns) if c not in keys]
    grouped = _both_sides(left, right, [*keys, *compared]).groupBy(*keys, *compared)
    return grouped.agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")), compared


def align_content(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """Keys that do not agree: LEFT_ONLY, RIGHT_ONLY or DIFFERENT. Null equals null.

    A key held several times agrees if both sides hold the same copies. Each row is reduced in the scan to its keys and
    a 128-bit digest of its content; a side's digests are added up per key, which does not depend on their order.
    """
    compared = [c for c in (cols or left.columns) if c not in keys]
    types = {c: left.schema[c].dataType for c in compared}

    def digests(df: DataFrame, sign: int) -> DataFrame:
        parts = [p for c in compared for p in (F.col(c).cast(types[c]), F.col(c).isNull())]
        return df.select(*keys, F.lit(sign).alias("_side"), *[
            (F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)") * sign).alias(f"_d{seed}") for seed in (1, 2)])

    per_key = digests(left, 1).unionByName(digests(right, -1)).groupBy(*keys).agg(
        F.count_if(F.col("_side") > 0).alias("_l"), F.count_if(F.col("_side") < 0).alias("_r"), F.sum("_d1").alias("_d1"), F.sum("_d2").alias("_d2"))
    return per_key.filter("_l <> _r OR _d1 <> 0 OR _d2 <> 0").select(
        *keys,
        F.when(F.col("_r") == 0, "LEFT_ONLY").when(F.col("_l") == 0, "RIGHT_ONLY").otherwise("DIFFERENT").alias("status"),
    )


def _differences(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Per unequal key the unmatched image of each side (``_left``, ``_right``, null if absent).

    Equal contents are gone before the second shuffle, which therefore carries differences only. A key with several
    unmatched rows on a side fails the job: the keys do not identify a row there.
    """
    counts, compared = _contents(left, right, keys, cols)
    image, more = F.struct(*compared), F.col("_l") - F.col("_r")

    def only(mine: Column, name: str) -> Column:
        several = F.sum(F.when(mine > 0, mine)) > 1
        return F.when(several, F.raise_error(F.lit(f"{list(keys)} do not identify a row"))).otherwise(F.max(F.when(mine > 0, image))).alias(name)

    pairs = counts.filter(F.col("_l") != F.col("_r")).groupBy(*keys).agg(only(more, "_left"), only(-more, "_right"))
    return pairs, compared


def align_diff_fields(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """One row per differing field of keys on both sides, values as text.

    ``keys`` identify a row.
    """
    pairs, compared = _differences(left, right, keys, cols)
    fields = F.array(*[
        F.when(~F.col(f"_left.{c}").eqNullSafe(F.col(f"_right.{c}")), F.struct(
            F.lit(c).alias("field"),
            F.col(f"_left.{c}").cast("string").alias("left_value"),
            F.col(f"_right.{c}").cast("string").alias("right_value"),
        ))
        for c in compared
    ])
    both = pairs.filter(F.col("_left").isNotNull() & F.col("_right").isNotNull())
    return both.select(*keys, F.inline(F.array_compact(fields)))


def align_sample(
    left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int, take: int, cols: Sequence[str] | None = None
) -> DataFrame:
    """Content check on a repeatable sample: keys whose hash falls in ``take`` of ``buckets``."""
    bucket = shard_of(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), buckets)
    return align_content(left.filter(bucket < take), right.filter(bucket < take), keys, cols)


def align_range(
    left: DataFrame, right: DataFrame, ts: str, start, end, keys: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """Content check of rows with ``start <= ts < end``; the bounds reach both scans."""
    def inside(df: DataFrame) -> DataFrame:
        kind = df.schema[ts].dataType
        return df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))

    return align_content(inside(left), inside(right), keys, cols)


def align_repair(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """Changes that make right equal left: ``op``, the keys, and the left image (null for DELETE).

    The rows feed ``apply_changes(right, …, before=None)``; ``keys`` identify a row on each side.
    """
    pairs, compared = _differences(left, right, keys, cols)
    op = (
        F.when(F.col("_right").isNull(), "INSERT").when(F.col("_left").isNull(), "DELETE").otherwise("UPDATE")
    )
    return pairs.select(op.alias("op"), *keys, *[F.col(f"_left.{c}").alias(c) for c in compared])


def align_report(runs: DataFrame, today: date, task: str = "task", ts: str = "day", ok: str = "ok") -> DataFrame:
    """Per task and day of the last seven days: runs, successes and success rate in percent.

    Days without runs appear with zero runs and no rate; ``is_today`` marks the panel's first figure.
    One pass and one row per task in the shuffle.
    """
    day, passed = F.col(ts).cast("date"), F.col(ok)

    def figures(d: date) -> Column:
        on_day = day == F.lit(d)
        return F.struct(
            F.lit(d).alias("date"), F.count_if(on_day).alias("runs"), F.count_if(on_day & passed).alias("succeeded")
        )

    week = [figures(today - timedelta(days=back)) for back in range(6, -1, -1)]
    return runs.groupBy(task).agg(F.array(*week).alias("_week")).select(task, F.inline("_week")).select(
        task, "date", "runs", "succeeded",
        percent(F.col("succeeded"), F.col("runs")).alias("success_rate"),
        (F.col("date") == F.lit(today)).alias("is_today"),
    )

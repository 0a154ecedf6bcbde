"""Row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def number_rows(
    df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row, overall or within ``partition_by`` groups.

    ``order_by`` has to be unique within a group, or equal rows get their numbers in any order.
    A window would send a group to one task (all rows, if there is no group). Here rows are
    range-partitioned by group and order, so a hot group spans many partitions; each partition
    numbers its own rows and the counts of the partitions before it are added.
    The numbered rows are staged because range bounds are sampled and must not change between
    the two passes.
    """
    ordering = [*partition_by, *order_by]
    numbered = stage(
        df.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    ).withColumns({
        "_part": F.shiftright("_slot", _SLOT_BITS),
        "_row": F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)),
    })
    # one row per (partition, group): bounded by partitions plus groups, never by rows
    blocks = numbered.groupBy("_part", *partition_by).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*partition_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("_part").alias("_part_r"),
        *[F.col(c).alias(f"_{c}_r") for c in partition_by],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_part_r")
    for c in partition_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_r"))
    return numbered.join(offsets, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(out))

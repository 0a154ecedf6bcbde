"""Save points: where a listener starts, recording offsets, cleaning up."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.relational import retain

STRATEGIES = ("INCREASE", "STOCK_AND_INCREASE", "LAST_STORAGE", "AUTO", "CUSTOM", "RECOVERY")


LISTENER = ("workspace", "flow", "component")


def resolve_start(flows: DataFrame, savepoints: DataFrame, keys: Sequence[str] = LISTENER) -> DataFrame:
    """Start of each listener: RESUME at a stored value, SCRATCH, or ERROR.

    Flows: ``keys``, ``strategy, save_point`` (a named point has priority and must exist). Save points:
    ``keys``, ``id, name, value``; each listener of a flow has its own. STOCK_AND_INCREASE ignores stored points, LAST_STORAGE needs one,
    the others take the latest if there is one.
    """
    latest = savepoints.groupBy(*keys).agg(F.max_by("value", "id").alias("_latest"))
    asked = flows.filter(F.col("save_point").isNotNull()).select(*keys, F.col("save_point").alias("name"))
    named = (
        savepoints.join(asked, [*keys, "name"]).groupBy(*keys).agg(F.max_by("value", "id").alias("_named"))
    )
    joined = flows.join(latest, list(keys), "left").join(named, list(keys), "left")
    by_name = F.col("save_point").isNotNull()
    stock = F.col("strategy") == "STOCK_AND_INCREASE"
    value = F.when(by_name, F.col("_named")).when(~stock, F.col("_latest"))
    state = (
        F.when(value.isNotNull(), "RESUME")
        .when(by_name | (F.col("strategy") == "LAST_STORAGE"), "ERROR")
        .otherwise("SCRATCH")
    )
    return joined.select(*keys, "strategy", "save_point", state.alias("start"), value.alias("value"))


def save_point(
    spark: SparkSession, path: str, workspace: str, flow: str, component: str, offsets: str, batch_id: int, now: datetime, days: int
) -> None:
    """Append the offsets of a finished batch under a random name, kept for ``days`` days."""
    row = spark.range(1).select(
        F.lit(batch_id).cast("long").alias("id"), F.lit(workspace).alias("workspace"), F.lit(flow).alias("flow"), F.lit(component).alias("component"),
        F.uuid().alias("name"), F.lit(offsets).alias("value"),
        F.lit(now).cast("timestamp_ntz").alias("create_time"),
        (F.lit(now).cast("timestamp_ntz") + F.expr(f"interval {int(days)} days")).alias("expire_time"),
    )
    row.coalesce(1).write.mode("append").parquet(path)


def clean_save_points(savepoints: DataFrame, now) -> DataFrame:
    """Save points that have not expired."""
    return retain(savepoints, now, expiry="expire_time")

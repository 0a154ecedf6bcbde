"""Figures per component: from stored metric rows, and live from a running query."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import total_cost


def component_metrics(metrics: DataFrame) -> DataFrame:
    """Per flow, component and parent: calls, rows, total and largest cost, errors."""
    return metrics.groupBy("flow", "component", "parent").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("rows").alias("rows"), total_cost(F.col("cost")).alias("cost"),
        F.max("cost").alias("max_cost"), F.count_if("error").alias("errors"),
    )


def observe_rows(df: DataFrame, component: str, error: str = "false") -> DataFrame:
    """Count rows and error rows where the data passes, without another pass over it."""
    return df.observe(component, F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(error)).alias("errors"))


def append_progress(spark: SparkSession, path: str) -> Callable[[dict], None]:
    """A writer that appends each entry to a table of (query, batch_id, rows, cost_ms, observed as JSON)."""
    def write(entry: dict) -> None:
        row = (entry["query"], entry["batch_id"], entry["rows"], entry["cost_ms"], json.dumps(entry["observed"], default=str))
        frame = spark.createDataFrame([row], "query string, batch_id long, rows long, cost_ms long, observed string")
        frame.coalesce(1).write.mode("append").parquet(path)

    return write


class ProgressLog(StreamingQueryListener):
    """Hands on rows, time and observed figures of every batch of every query, each to ``write`` as it ends.

    With a writer such as :func:`append_progress` nothing is held by the driver. Without one, for a look at a few
    batches, all are kept in ``entries``.
    """

    def __init__(self, write: Callable[[dict], None] | None = None):
        self.entries: list[dict] = []
        self._write = write or self.entries.append

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = {name: row.asDict() for name, row in (progress.observedMetrics or {}).items()}
        self._write({
            "query": progress.name, "batch_id": progress.batchId, "rows": progress.numInputRows,
            "cost_ms": progress.batchDuration, "observed": observed,
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

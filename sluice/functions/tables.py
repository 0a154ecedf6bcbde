"""Functions with state for SQL text: a table function over ordered partitions and a grouped aggregate."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf

# workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SESSIONS = "user_id bigint, session int, started timestamp_ntz, ended timestamp_ntz, events bigint"


class Sessions:
    """``sessions(TABLE(rows) PARTITION BY user_id ORDER BY ts)``: the sessions of each user, split by pauses longer than the gap.

    Rows are (user_id, ts, gap in hours). A partition's rows stream by in order; what is held is the open session.
    """

    def __init__(self) -> None:
        self.user = self.started = self.last = None
        self.number = self.events = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        user, ts, hours = row[0], row[1], row[2]
        if self.events and ts - self.last > timedelta(hours=hours):
            yield self.user, self.number, self.started, self.last, self.events
            self.events = 0
        if not self.events:
            self.user, self.started, self.number = user, ts, self.number + 1
        self.last, self.events = ts, self.events + 1

    def terminate(self) -> Iterator[tuple]:
        if self.events:
            yield self.user, self.number, self.started, self.last, self.events


def weighted_median(values: pd.Series, weights: pd.Series) -> float:
    """The least value at which half of the group's weight is reached; a row without value or weight counts for nothing."""
    known = pd.DataFrame({"v": values, "w": weights}).dropna().sort_values("v", kind="stable")
    reached = known["w"].cumsum()
    return None if known.empty else float(known["v"].iloc[int((2 * reached >= known["w"].sum()).to_numpy().argmax())])


def register_functions(spark: SparkSession) -> None:
    """Make ``sessions`` and ``weighted_median`` known to SQL text of this session.

    Batches go through Arrow. The aggregate holds one group at a time in a task, so it is for groups that fit one; a hot group is better served by
    ``percentile`` of Spark itself.
    """
    spark.udtf.register("sessions", udtf(Sessions, returnType=SESSIONS, useArrow=False))
    spark.udf.register("weighted_median", pandas_udf(weighted_median, "double"))

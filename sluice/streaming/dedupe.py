"""Drop repeated messages within a hold time that starts when a message is accepted."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import stage

HOLD_MINUTES = 3600
# rounds before the rest is finished by doubling
PLAIN_ROUNDS = 4


def _micros(df: DataFrame, column: str) -> Column:
    """A time as microseconds; a null time lies before all others."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        number = F.unix_micros(column)
    else:
        number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))
    return F.coalesce(number, F.lit(-(1 << 62)))


def dedupe_messages(
    df: DataFrame, keys: Sequence[str], arrival: str, tie_break: str, hold_minutes: int = HOLD_MINUTES
) -> DataFrame:
    """Messages of a table that a listener with this hold time would accept.

    A few plain rounds come first: the first message of each key is accepted, the rows within its hold time drop out, and
    keys without later copies are done. A round is one aggregation that combines before the shuffle. Keys that go on are
    finished by :func:`_chained`, so a key with n accepted messages takes about log2(n) rounds. A null key is a key; a null
    arrival comes before all others.
    """
    if hold_minutes < 1:
        raise ValueError("the hold time is at least one minute")
    hold = int(hold_minutes) * 60_000_000
    rest = df.select(F.struct(*keys).alias("_key"), _micros(df, arrival).alias("_at"), F.struct(*df.columns).alias("_row"))
    accepted = None
    for _ in range(PLAIN_ROUNDS):
        first = stage(rest.groupBy("_key").agg(
            F.min_by("_row", F.struct("_at", f"_row.{tie_break}")).alias("_row"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
        ), "accepted")
        rows = first.select("_row.*")
        accepted = rows if accepted is None else accepted.unionByName(rows)
        until = first.filter(F.col("_last") - F.col("_first") >= hold).select("_key", (F.col("_first") + hold).alias("_until"))
        if until.isEmpty():
            return accepted
        rest = stage(rest.join(until, "_key").filter("_at >= _until").select("_key", "_at", "_row"), "rest")
    return accepted.unionByName(_chained(rest, hold, tie_break))


def _chained(rows: DataFrame, hold: int, tie_break: str) -> DataFrame:
    """Accepted rows of (_key, _at, _row) by following each key's chain in doubling steps.

    After an accepted message comes the first that is at least the hold time later. That one is known for every arrival at once: it
    lies in the following stretch of hold length or opens the next one that has any. Copies at one moment are combined
    before the first shuffle; windows span a stretch of a key, or one row per stretch, never all messages of a key.
    """
    stretch = lambda c: F.floor(F.col(c) / F.lit(hold).cast("decimal(20,0)")).cast("long")
    moments = stage(rows.groupBy("_key", "_at").agg(F.min_by("_row", f"_row.{tie_break}").alias("_row")), "moments")
    times = moments.select("_key", "_at").withColumn("_stretch", stretch("_at"))
    first = times.groupBy("_key").agg(F.min("_at").alias("_at"), F.max("_at").alias("_last"))
    long = stage(first.filter(F.col("_last") - F.col("_at") >= hold), "long-keys")  # the others end with their first message
    times = times.join(long.select("_key"), "_key", "left_semi")
    probes = times.select("_key", (F.col("_stretch") + 1).alias("_stretch"), F.col("_at").alias("_from"), (F.col("_at") + hold).alias("_when"))
    events = times.select("_key", "_stretch", F.lit(None).cast("long").alias("_from"), F.col("_at").alias("_when")).unionByName(probes)
    inside = Window.partitionBy("_key", "_stretch").orderBy("_when").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(1, Window.unboundedFollowing)
    heads = events.groupBy("_key", "_stretch").agg(F.min(F.when(F.col("_from").isNull(), F.col("_when"))).alias("_head"))
    heads = heads.select("_key", "_stretch", F.min("_head").over(later).alias("_later"))
    found = events.withColumn("_in", F.min(F.when(F.col("_from").isNull(), F.col("_when"))).over(inside)).filter("_from IS NOT NULL")
    jump = stage(
        found.join(heads, ["_key", "_stretch"]).select("_key", F.col("_from").alias("_at"), F.coalesce("_in", "_later").alias("_next"))
        .filter("_next IS NOT NULL"), "jumps")
    accepted, chain = first.select("_key", "_at"), long.select("_key", "_at")
    while True:
        step = stage(chain.join(jump, ["_key", "_at"]).select("_key", F.col("_next").alias("_at")), "accepted")
        if step.isEmpty():
            break
        accepted, chain = accepted.unionByName(step), chain.unionByName(step)
        onward = jump.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        jump = stage(jump.join(onward, ["_key", "_next"]).select("_key", "_at", F.col("_far").alias("_next")), "jumps")
    return moments.join(accepted, ["_key", "_at"], "left_semi").select("_row.*")


class _Hold(StatefulProcessor):
    """Remembers a key from its first message until the hold time has passed."""

    def __init__(self, hold: timedelta):
        self._hold_ms = int(hold.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean", ttlDurationMs=self._hold_ms)

    def handleInputRows(self, key, rows, timerValues):
        known = self._seen.exists()
        for batch in rows:
            if not known and len(batch):
                self._seen.update((True,))
                known = True
                yield batch.head(1)

    def close(self) -> None:
        pass


def dedupe_stream(df: DataFrame, keys: Sequence[str], hold: timedelta = timedelta(minutes=HOLD_MINUTES)) -> DataFrame:
    """The same on a stream, by processing time; late rows are not dropped.

    Copies within an input batch go before the shuffle. Needs the RocksDB state store.
    """
    schema, names = df.schema, list(keys)

    def thin(batches):
        for batch in batches:
            yield batch.drop_duplicates(names)

    return df.mapInPandas(thin, schema).groupBy(*keys).transformWithStateInPandas(
        _Hold(hold), schema, outputMode="append", timeMode="processingTime"
    )

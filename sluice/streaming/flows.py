"""Stream settings and the change stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..session import bound_scans
from ..sinks.writers import KeyedTable, with_retry
from ..sources.changes import parse_change_events


def micro_batch(kind: str, count: int, timeout_ms: int = 0) -> dict[str, str]:
    """Reader options that end a micro-batch at a count or a timeout.

    Kafka: ``count`` records, or fewer after ``timeout_ms``. Files: ``count`` files.
    """
    if kind == "kafka":
        options = {"minOffsetsPerTrigger": str(count), "maxOffsetsPerTrigger": str(count)}
        return {**options, "maxTriggerDelay": f"{timeout_ms}ms"} if timeout_ms else options
    if kind == "files":
        return {"maxFilesPerTrigger": str(count)}
    raise ValueError("kind is kafka or files")


def rate_limit(writer: DataStreamWriter, limit: int | None, interval_ms: int = 1000) -> DataStreamWriter:
    """At most ``limit`` batches per interval for the whole query; waits, never drops. None passes through."""
    if not limit:
        return writer
    return writer.trigger(processingTime=f"{max(-(-interval_ms // limit), 1)} milliseconds")


def run_changes(
    envelopes: DataFrame, image_schema: str, table: KeyedTable | None, checkpoint: str, seq: str = "seq",
    ops: Sequence[str] = ("CREATE", "UPDATE", "DELETE", "READ"),
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True,
    write: Callable[[DataFrame, int], None] | None = None,
    after_batch: Callable[[SparkSession, int], None] | None = None,
) -> StreamingQuery:
    """Change envelopes of a stream applied to a keyed table, batch by batch.

    The checkpoint restarts after the last finished batch; the batch in which a run died is applied again, which changes nothing. Pass ``write``
    to put the batches elsewhere, as with :func:`sluice.sinks.merge_into`, and ``after_batch`` to note a finished batch, as with
    :func:`sluice.streaming.save_point`. A task sorts the images of what it has read, which :func:`sluice.session.bound_scans` keeps small.
    """
    bound_scans(envelopes.sparkSession)
    changes = prepare(parse_change_events(envelopes, image_schema, ops))

    def step(batch: DataFrame, batch_id: int) -> None:
        if write:
            write(batch, batch_id)
        else:
            table.merge(batch, seq)
        if after_batch:
            after_batch(batch.sparkSession, batch_id)

    writer = changes.writeStream.foreachBatch(with_retry(step)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Messages for a topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.paging import assign_pages


def kafka_payload(
    df: DataFrame, topic: str, key: str | None = None, split: int | None = None, order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """Rows as ``topic, key, value`` with the row as JSON.

    With ``split`` a message carries up to that many rows as a JSON array, in ``order_by`` order
    (unique); ``key`` is then a fixed key for all messages, without it each row's own column.
    """
    if split is None:
        message_key = F.col(key).cast("string") if key else F.lit(None).cast("string")
        return df.select(F.lit(topic).alias("topic"), message_key.alias("key"), F.to_json(F.struct("*")).alias("value"))
    paged = assign_pages(df.select(*df.columns, F.to_json(F.struct("*")).alias("_json")), order_by, split, out="_page")
    ordered = F.sort_array(F.collect_list(F.struct(*order_by, "_json")))["_json"]
    return paged.groupBy("_page").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("value")).select(
        F.lit(topic).alias("topic"), F.lit(key).cast("string").alias("key"), "value"
    )


def kafka_send(payload: DataFrame, servers: str) -> None:
    payload.write.format("kafka").option("kafka.bootstrap.servers", servers).save()

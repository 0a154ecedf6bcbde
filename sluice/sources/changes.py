"""Change events: envelopes to ordered change rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Envelope code -> (operation name, kind of write).
OPERATIONS = {
    "r": ("READ", "INSERT"),
    "c": ("CREATE", "INSERT"),
    "u": ("UPDATE", "UPDATE"),
    "d": ("DELETE", "DELETE"),
    "t": ("TRUNCATE", "INSERT"),
    "m": ("MESSAGE", "INSERT"),
}


def _is_empty(image: str, schema: T.StructType) -> Column:
    """An image that is missing or has no non-null field."""
    fields = [F.col(f"{image}.`{name}`").isNull() for name in schema.names]
    return F.col(image).isNull() | reduce(lambda a, b: a & b, fields)


def parse_change_events(
    df: DataFrame, image_schema: T.StructType | str, ops: Sequence[str] = ("CREATE", "UPDATE", "DELETE", "READ"),
    topic: str = "topic", value: str = "value",
) -> DataFrame:
    """Envelope text to ``src_schema, src_table, op, before, after`` beside the other columns.

    Heartbeats, unknown or unlisted operations and events whose images are both empty are
    skipped. ``ops`` are operation names. A topic has a schema and a table only if it has more
    than two dotted parts. Works the same on a stream.
    """
    if isinstance(image_schema, str):
        image_schema = T.StructType.fromDDL(image_schema)
    unknown = set(ops) - {name for name, _ in OPERATIONS.values()}
    if unknown:
        raise ValueError(f"unknown operations {sorted(unknown)}")
    listed = {code: kind for code, (name, kind) in OPERATIONS.items() if name in ops}
    envelope = T.StructType([
        T.StructField("op", T.StringType()),
        T.StructField("before", image_schema),
        T.StructField("after", image_schema),
    ])
    kinds = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])
    parts = F.split(F.col(topic), r"\.")
    named = F.size(parts) > 2
    # a generator row keeps the later filter from parsing the text again for each image field
    parsed = df.select(*[c for c in df.columns if c != value], F.explode(F.array(F.from_json(value, envelope))).alias("_e"))
    return (
        parsed.withColumns({
            "src_schema": F.when(named, parts[1]),
            "src_table": F.when(named, F.try_element_at(parts, F.lit(3))),
            "op": F.try_element_at(kinds, F.col("_e.op")),
            "before": F.col("_e.before"),
            "after": F.col("_e.after"),
        })
        .filter(F.col("op").isNotNull() & ~(_is_empty("before", image_schema) & _is_empty("after", image_schema)))
        .drop("_e", topic)
    )


def snapshot_then_changes(
    snapshot: DataFrame, changes: DataFrame, ops: Sequence[str] = ("CREATE", "UPDATE", "DELETE", "READ"),
    seq: str = "seq",
) -> DataFrame:
    """Initial rows as inserts ahead of all changes.

    ``changes`` has ``op``, ``after`` and ``seq``; snapshot rows get the sequence -1 (change
    sequences start at 0). Without READ among ``ops`` there is no snapshot.
    """
    if "READ" not in ops:
        return changes
    after = changes.schema["after"].dataType
    seq_type = changes.schema[seq].dataType
    rows = snapshot.select(
        F.lit(-1).cast(seq_type).alias(seq),
        F.lit("INSERT").alias("op"),
        F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in after.fields]).alias("after"),
    )
    return changes.unionByName(rows, allowMissingColumns=True)


def include_tables(df: DataFrame, schemas: str | None = None, tables: str | None = None) -> DataFrame:
    """Keep changes of listed schemas and ``schema.table`` names.

    Both lists are comma-separated patterns that have to match the whole name, ignoring case;
    an empty list keeps everything.
    """
    def matches(name: Column, patterns: str | None) -> Column:
        wanted = [p.strip() for p in (patterns or "").split(",") if p.strip()]
        return name.rlike("(?i)^(?:" + "|".join(wanted) + ")$") if wanted else F.lit(True)

    full_name = F.concat("src_schema", F.lit("."), "src_table")
    return df.filter(matches(F.col("src_schema"), schemas) & matches(full_name, tables))

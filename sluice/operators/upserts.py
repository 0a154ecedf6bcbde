"""Keyed writes as DataFrames: the target after inserts, updates and deletes.

Replaying the changes of a key in order always ends in one of three states, which needs two
aggregates only. Let ``last`` be the last event of the key and ``reset`` its last event that is
not an UPDATE. If ``reset`` is an INSERT, the row exists with the image of ``last``; if it is a
DELETE, the row is gone; without ``reset`` an existing row takes the image of ``last``. The
aggregates combine before the shuffle, so a hot key costs one row per input partition.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .transforms import resolve_columns


def required(col: Column, name: str) -> Column:
    """The column, failing the job if it is null: a null key matches nothing and must not be written."""
    return F.when(col.isNull(), F.raise_error(F.lit(f"key column {name} is null"))).otherwise(col)


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: required(F.col(k), k) for k in keys})


def _names(target: DataFrame, given: Collection[str], ignore_case: bool) -> dict[str, str]:
    """Target column to the given column that fills it; an equal name goes before one that differs by case."""
    folded = {n.lower(): n for n in given} if ignore_case else {}
    known = set(given)
    found = {c: c if c in known else folded.get(c.lower()) for c in target.columns}
    return {c: n for c, n in found.items() if n is not None}


def _image(target: DataFrame, given: Collection[str], prefix: str = "", ignore_case: bool = True) -> Column:
    """All target columns as a struct, taken from ``prefix``; columns not given are null."""
    names = _names(target, given, ignore_case)
    return F.struct(*[
        (F.col(f"{prefix}`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ])


def _aligned(target: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(_image(target, rows.columns).alias("_row")).select("_row.*")


def latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``; combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.`{c}`") for c in rows.columns])


def single(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, failing the job if a key comes twice: without an order none of them is the last."""
    others = [c for c in rows.columns if c not in keys]
    twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several rows for one value of {list(keys)}, and no seq"))).otherwise(
        F.first(F.struct(F.lit(1).alias("_one"), *others)))
    found = rows.groupBy(*keys).agg(twice.alias("_only"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_only.`{c}`") for c in rows.columns])


def _net_rows(target: DataFrame, rows: DataFrame, keys: Sequence[str], seq: str | None, ignore_case: bool) -> DataFrame:
    """One checked row per key under the names of the target."""
    rows = resolve_columns(rows, [*target.columns, *([seq] if seq else [])], ignore_case)
    rows = _with_keys(rows, keys)
    return _aligned(target, latest(rows, keys, seq) if seq else single(rows, keys))


def upsert(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], seq: str | None = None, ignore_case: bool = True,
) -> DataFrame:
    """Insert rows; an existing key has all its other columns replaced.

    Columns are matched ignoring case unless told otherwise. ``seq`` says which row of a key is last; without it a
    key that comes twice fails the job, and so does a null key.
    """
    net = _net_rows(target, rows, keys, seq, ignore_case).select(*keys, F.struct(*target.columns).alias("_new"))
    return apply_net(target, net.withColumn("_state", F.lit("PUT")), keys)


def update_rows(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], seq: str | None = None, ignore_case: bool = True,
) -> DataFrame:
    """Replace all other columns of keys that exist (absent ones become null); unknown keys are ignored, null keys refused."""
    net = _net_rows(target, rows, keys, seq, ignore_case).select(*keys, F.struct(*target.columns).alias("_new"))
    joined = target.join(net, list(keys), "left")
    return joined.select(*[
        F.col(c) if c in keys
        else F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`")).otherwise(F.col(c)).alias(c)
        for c in target.columns
    ])


def delete_rows(target: DataFrame, rows: DataFrame, keys: Sequence[str], image: str | None = None) -> DataFrame:
    """Remove the keys of ``rows``, taken from their ``image`` (the state before) if given; null keys are refused."""
    gone = _with_keys(rows.select(*[F.col(f"{image}.{k}" if image else k).alias(k) for k in keys]), keys)
    return target.join(gone, list(keys), "left_anti")


def net_changes(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op",
    before: str | None = "before", after: str = "after", ignore_case: bool = True,
) -> DataFrame:
    """One row per key: ``_state`` PUT, DROP or PATCH (only if the row exists) and the image ``_new``.

    The key of a DELETE comes from its ``before`` image, any other key from ``after``. With
    ``before=None`` changes are flat rows whose columns are the image.
    """
    if before is None:
        given = _names(target, changes.columns, ignore_case)
        key_of = {k: F.col(f"`{given.get(k, k)}`") for k in keys}
        new = _image(target, changes.columns, "", ignore_case)
    else:
        old, now = (_names(target, changes.schema[c].dataType.names, ignore_case) for c in (before, after))
        key_of = {
            k: F.when(F.col(op) == "DELETE", F.col(f"{before}.`{old.get(k, k)}`")).otherwise(F.col(f"{after}.`{now.get(k, k)}`"))
            for k in keys
        }
        new = _image(target, changes.schema[after].dataType.names, f"{after}.", ignore_case)
    events = changes.select(
        *[required(v, k).cast(target.schema[k].dataType).alias(k) for k, v in key_of.items()],
        required(F.col(seq), seq).alias("_seq"),
        F.col(op).alias("_op"),
        new.alias("_image"),
    )
    reset = F.max_by("_op", F.when(F.col("_op") != "UPDATE", F.col("_seq")))
    return (
        events.groupBy(*keys)
        .agg(F.max_by("_image", "_seq").alias("_new"), reset.alias("_reset"))
        .select(
            *keys,
            "_new",
            F.when(F.col("_reset") == "INSERT", "PUT").when(F.col("_reset") == "DELETE", "DROP").otherwise("PATCH")
            .alias("_state"),
        )
    )


def apply_net(target: DataFrame, net: DataFrame, keys: Sequence[str], lookup: bool = False) -> DataFrame:
    """Target after one net change per key.

    By default one full outer join shuffles both sides on the key, once. With ``lookup`` the target is looked up in the net
    changes instead, and new rows are those whose key the target lacks: for net changes that have been written, so that
    Catalyst knows their size. It then sends small ones to the target, which is not shuffled; large ones cost a second, narrow
    shuffle of the target's keys.
    """
    def value(c: str) -> Column:
        return F.col(c) if c in keys else F.when(F.col("_state").isNull(), F.col(c)).otherwise(F.col(f"_new.`{c}`")).alias(c)

    if not lookup:
        both = target.withColumn("_old", F.lit(True)).join(net, list(keys), "full_outer")
        kept = (
            F.col("_state").isNull() | (F.col("_state") == "PUT")
            | ((F.col("_state") == "PATCH") & F.col("_old").isNotNull())
        )
        return both.filter(kept).select(*[value(c) for c in target.columns])
    survivors = (
        target.join(net, list(keys), "left")
        .filter(F.col("_state").isNull() | (F.col("_state") != "DROP"))
        .select(*[value(c) for c in target.columns])
    )
    known = target.select(*keys).join(net, list(keys), "left_semi")
    fresh = net.filter(F.col("_state") == "PUT").join(known, list(keys), "left_anti").select("_new.*")
    return survivors.unionByName(fresh)


def apply_changes(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op",
    before: str | None = "before", after: str = "after", ignore_case: bool = True,
) -> DataFrame:
    """Target after an ordered batch of INSERT, UPDATE and DELETE changes, equal to replaying them.

    Every image replaces the whole row: columns it lacks become null.
    """
    return apply_net(target, net_changes(target, changes, keys, seq, op, before, after, ignore_case), keys)


_VARIABLE = re.compile(r"\$\{(\w+)\}")


def _template_columns(
    template: Mapping[str, str], target: DataFrame, changes: DataFrame, ignore_case: bool
) -> dict[str, Column]:
    """Template ``{column: text}`` to value expressions; each ``${name}`` must be a target column."""
    fold = (lambda n: n.lower()) if ignore_case else (lambda n: n)
    known = {fold(c): c for c in target.columns}
    have = {fold(c): c for c in changes.columns}
    columns = {}
    for name, text in template.items():
        for variable in [name, *_VARIABLE.findall(text)]:
            if fold(variable) not in known:
                raise ValueError(f"column not in the table: {variable}")

        def bound(match: re.Match) -> str:
            column = have.get(fold(match.group(1)))
            return f"`{column}`" if column else "NULL"

        columns[known[fold(name)]] = F.expr(_VARIABLE.sub(bound, text)).cast(target.schema[known[fold(name)]].dataType)
    return columns


def custom_write(
    target: DataFrame, changes: DataFrame, templates: Mapping[str, Mapping[str, str]], keys: Sequence[str],
    seq: str = "seq", op: str = "op", ignore_case: bool = True,
) -> DataFrame:
    """Apply flat changes with per-operation templates ``{op: {column: "text with ${column}"}}``.

    INSERT writes a whole row, columns outside its template become null. UPDATE and DELETE
    templates set their columns on an existing row (a DELETE template is a soft delete).
    Operations without a template act as in :func:`apply_changes`. Values depend on the change
    alone, so per column the last setting event decides, and everything combines before the shuffle.
    """
    changes = resolve_columns(changes, [*target.columns, seq, op], ignore_case)
    values = {o: _template_columns(t, target, changes, ignore_case) for o, t in templates.items()}
    plain = {
        c: F.col(f"`{c}`").cast(target.schema[c].dataType) if c in changes.columns
        else F.lit(None).cast(target.schema[c].dataType)
        for c in target.columns
    }
    setters = {"INSERT": {**dict.fromkeys(target.columns, None), **values.get("INSERT", plain)}}
    setters["UPDATE"] = values.get("UPDATE", {c: v for c, v in plain.items() if c not in keys})
    if "DELETE" in values:
        setters["DELETE"] = values["DELETE"]
    resets = [o for o in ("INSERT", "DELETE") if o == "INSERT" or o not in values]

    kind, order = F.col(op), required(F.col(seq), seq)
    aggregates = [
        F.max(F.when(kind.isin(resets), order)).alias("_reset_seq"),
        F.max_by(kind, F.when(kind.isin(resets), order)).alias("_reset"),
    ]
    others = [c for c in target.columns if c not in keys]
    for c in others:
        typed = target.schema[c].dataType
        by_op = [(o, cols[c]) for o, cols in setters.items() if c in cols]
        chosen = reduce(
            lambda acc, item: acc.when(kind == item[0], F.struct(
                (F.lit(None) if item[1] is None else item[1]).cast(typed).alias("v"), order.alias("s"))),
            by_op, F.when(F.lit(False), F.struct(F.lit(None).cast(typed).alias("v"), order.alias("s"))),
        )
        ops = [o for o, _ in by_op]
        aggregates.append(F.max_by(chosen, F.when(kind.isin(ops), order)).alias(f"_set_{c}"))
    net = changes.withColumns({k: required(F.col(k), k) for k in keys}).groupBy(*keys).agg(*aggregates)

    both = target.withColumn("_old", F.lit(True)).join(
        net.withColumn("_hit", F.lit(True)), list(keys), "full_outer"
    )
    reset = F.col("_reset")
    exists = F.when(reset == "INSERT", True).when(reset == "DELETE", False).otherwise(F.col("_old").isNotNull())

    def value(c: str) -> Column:
        last = F.col(f"_set_{c}")
        since_reset = last.isNotNull() & (reset.isNull() | (last["s"] >= F.col("_reset_seq")))
        return F.when(since_reset, last["v"]).when(reset.isNull(), F.col(c)).alias(c)

    return both.filter(exists).select(*[F.col(c) if c in keys else value(c) for c in target.columns])

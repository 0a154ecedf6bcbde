"""Keyed writes whose values read the old row: counters, extremes, first values, and any ordered update.

A change is a function from a row (or no row) to a row (or no row). Where every function is of a kind that can be composed,
the changes of a key are composed before the target is read: additions, lower and upper bounds and settings of a column are all of the
form ``x -> least(greatest(x + a, lo), hi)`` or a constant, and such functions composed are of that form again. Anything else is folded over
the old row in order. Either way a key with many changes is cut into runs, so no task holds more than a run of one key.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import number_rows
from ..session import stage
from .transforms import resolve_columns
from .upserts import required

_VARIABLE = re.compile(r"\$\{(\w+)\}")
# composed runs of a key that are composed in one task
FAN_IN = 1000


class Statement(NamedTuple):
    """What an operation does to the row of its key.

    ``set`` gives columns as SQL text over ``old.column`` (the row before) and ``${column}`` (the change). Columns not named keep their value.
    The change is ignored where ``when``, a condition over both, is not true. Without a row nothing happens, unless ``insert`` says that the change's columns
    become the row (as in "insert, on duplicate key update").
    """

    set: Mapping[str, str]
    when: str | None = None
    insert: bool = False


def read_modify_write(
    target: DataFrame, changes: DataFrame, statements: Mapping[str, Statement | Mapping[str, str]], keys: Sequence[str],
    seq: str = "seq", op: str = "op", run: int = 100_000, ignore_case: bool = True,
) -> DataFrame:
    """Target after an ordered batch of flat changes, equal to running each change's statement on the row its predecessors left.

    ``statements`` by operation; INSERT, UPDATE and DELETE without one put the row, replace all columns of an existing row, and remove it. Any
    other operation without a statement fails the job, as do a null key and a null ``seq``. ``seq`` is unique within a key. Names are matched
    ignoring case unless told otherwise; a named column must be one of the target.

    If all values are of the change alone, ``old.c + v`` or ``old.c - v`` of exact numbers, ``greatest`` or ``least`` of ``old.c`` and values of the change,
    or ``coalesce(old.c, v)``, and conditions are of the change alone, a key's changes become one function (:func:`composed`) and the target is joined with
    one row per key. Otherwise the changes of a key are folded over its row, in rounds of ``run`` changes: a key takes as many rounds as
    its changes need, as each may depend on the one before. Sums of doubles are folded too, as their order shows. An intermediate sum out of the
    column's range fails a fold and passes a composition; the result's range is checked in both.
    """
    changes = resolve_columns(changes, [*target.columns, seq, op], ignore_case)
    rest = [f for f in target.schema.fields if f.name not in keys]
    known = {(f.name.lower() if ignore_case else f.name): f.name for f in target.schema.fields}
    parsed = {o: _bound(s if isinstance(s, Statement) else Statement(s), known, keys, ignore_case) for o, s in statements.items()}
    events = changes.select(
        *[required(F.col(f"`{k}`"), k).cast(target.schema[k].dataType).alias(k) for k in keys],
        required(F.col(f"`{seq}`"), seq).alias("_seq"), F.col(f"`{op}`").alias("_op"),
        F.struct(*[(F.col(f"`{f.name}`") if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in target.schema.fields]).alias("new"),
    )
    kinds = _kinds(events, parsed, rest)
    if kinds is None:
        return _folded(target, events, parsed, keys, rest, run)
    functions = composed(events, parsed, kinds, keys, rest, run)
    both = target.select(*keys, F.struct(F.lit(True).alias("_is"), *[f.name for f in rest]).alias("_old")).join(functions, list(keys), "full_outer")
    row = F.when(F.col("_fn").isNull(), F.struct(*[F.col(f"_old.`{f.name}`") for f in rest])).when(
        F.col("_old").isNull(), F.struct(*[F.col(f"_fn.m.`{f.name}`").alias(f.name) for f in rest])).otherwise(
        F.struct(*[_apply(F.col(f"_fn.f.`{f.name}`"), F.col(f"_old.`{f.name}`"), kinds[f.name], f.dataType).alias(f.name) for f in rest]))
    exists = F.when(F.col("_fn").isNull(), True).when(F.col("_old").isNull(), F.col("_fn.m").isNotNull()).otherwise(~F.col("_fn.d"))
    return both.filter(exists).select(*keys, row.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in target.columns])


def _bound(statement: Statement, known: Mapping[str, str], keys: Sequence[str], ignore_case: bool) -> Statement:
    """The statement with names of the target, and ``${column}`` as ``new.column``."""
    fold = (lambda n: n.lower()) if ignore_case else (lambda n: n)

    def name(given: str) -> str:
        if fold(given) not in known:
            raise ValueError(f"column not in the table: {given}")
        return known[fold(given)]

    def text(given: str) -> str:
        return _VARIABLE.sub(lambda m: f"new.`{name(m.group(1))}`", given)

    columns = {name(c): text(t) for c, t in statement.set.items()}
    if set(columns) & set(keys):
        raise ValueError(f"a statement sets a key: {sorted(set(columns) & set(keys))}")
    return Statement(columns, text(statement.when) if statement.when else None, statement.insert)


# ---- composition


def _reads_old(node) -> bool:
    """Does a parsed expression name the old row?"""
    if node.getClass().getSimpleName() == "UnresolvedAttribute" and node.nameParts().apply(0).lower() == "old":
        return True
    children = node.children()
    return any(_reads_old(children.apply(i)) for i in range(children.size()))


def _shape(spark, text: str, column: str) -> str | None:
    """set, add, greatest, least or first, from the parsed text; None if it can't be composed."""
    node = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    if not _reads_old(node):
        return "set"
    kind, children = node.getClass().getSimpleName(), node.children()
    if kind == "UnresolvedFunction":
        kind = node.nameParts().apply(0).lower() if node.nameParts().size() == 1 and not node.isDistinct() else ""
    found = {"Add": "add", "Subtract": "add", "greatest": "greatest", "least": "least", "coalesce": "first"}.get(kind)
    if not found or children.size() < 2 or any(_reads_old(children.apply(i)) for i in range(1, children.size())):
        return None
    first = children.apply(0)
    if first.getClass().getSimpleName() != "UnresolvedAttribute" or first.nameParts().size() != 2:
        return None
    return found if first.nameParts().apply(1).lower() == column.lower() else None


def _exact(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DecimalType))


def _kinds(events: DataFrame, statements: Mapping[str, Statement], rest: Sequence[T.StructField]) -> dict[str, set[str]] | None:
    """Per column the kinds of function it takes, or None if some value or condition can't be composed."""
    spark, kinds = events.sparkSession, {f.name: {"set"} for f in rest}
    typed = {f.name: f.dataType for f in rest}
    for statement in statements.values():
        if statement.when and _reads_old(spark._jsparkSession.sessionState().sqlParser().parseExpression(statement.when)):
            return None
        for column, text in statement.set.items():
            shape = _shape(spark, text, column)
            if shape == "add":
                with_old = events.withColumn("old", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rest]))
                result, own = with_old.select(F.expr(text).alias("v")).schema["v"].dataType, typed[column]
                scale = lambda t: t.scale if isinstance(t, T.DecimalType) else 0
                if not (_exact(own) and _exact(result) and scale(result) <= scale(own)):
                    return None
            if shape is None:
                return None
            kinds[column].add(shape)
    return kinds


def _wide(kind: T.DataType) -> T.DataType:
    """Exact numbers are composed with room for sums."""
    return T.DecimalType(37, kind.scale if isinstance(kind, T.DecimalType) else 0) if _exact(kind) else kind


def _function(kinds: set[str], typed: T.DataType, shape: str | None = None, value: Column | None = None, constant: Column | bool = False) -> Column:
    """One column's function: a constant ``v`` if ``c``, else ``z`` for null and the bounded shift for the rest. Plain columns need c and v only."""
    wide, none = _wide(typed), F.lit(None)
    put = lambda v, name: (none if v is None else v).cast(wide).alias(name)
    is_set = F.lit(constant) if isinstance(constant, bool) else constant
    fields = [is_set.alias("c"), put(value if shape == "set" else None, "v")]
    if kinds != {"set"}:
        fields += [put(value if shape == "greatest" else None, "lo"), put(value if shape == "least" else None, "hi"),
                   put(value if shape in ("greatest", "least", "first") else None, "z")]
        if _exact(typed):
            fields.append((F.coalesce(value, F.lit(0)) if shape == "add" else F.lit(0)).cast(wide).alias("a"))
    return F.struct(*fields)


def _shifted(fn: Column, x: Column, typed: T.DataType) -> Column:
    """A value that is not null, after the function's shift and bounds."""
    moved = (x + fn["a"]).cast(_wide(typed)) if _exact(typed) else x
    return F.least(F.greatest(moved, fn["lo"]), fn["hi"])


def _value(fn: Column, x: Column, kinds: set[str], typed: T.DataType) -> Column:
    if kinds == {"set"}:
        return F.when(fn["c"], fn["v"]).otherwise(x)
    return F.when(fn["c"], fn["v"]).when(x.isNull(), fn["z"]).otherwise(_shifted(fn, x, typed))


def _apply(fn: Column, x: Column, kinds: set[str], typed: T.DataType) -> Column:
    return _value(fn, x.cast(_wide(typed)), kinds, typed).cast(typed)


def _after(f: Column, g: Column, kinds: set[str], typed: T.DataType) -> Column:
    """The function that does ``f``, then ``g``."""
    value = F.when(g["c"], g["v"]).when(f["c"], _value(g, f["v"], kinds, typed))
    fields = [(f["c"] | g["c"]).alias("c"), value.cast(_wide(typed)).alias("v")]
    if kinds != {"set"}:
        constant = f["c"] | g["c"]
        bound = lambda name: F.when(constant, None).when(f[name].isNull(), g[name]).otherwise(_shifted(g, f[name], typed)).cast(_wide(typed)).alias(name)
        fields += [bound("lo"), bound("hi"), F.when(~constant, _value(g, f["z"], kinds, typed)).cast(_wide(typed)).alias("z")]
        if _exact(typed):
            fields.append(F.when(constant, 0).otherwise(f["a"] + g["a"]).cast(_wide(typed)).alias("a"))
    return F.struct(*fields)


def composed(
    events: DataFrame, statements: Mapping[str, Statement], kinds: Mapping[str, set[str]], keys: Sequence[str], rest: Sequence[T.StructField], run: int,
) -> DataFrame:
    """One row per key: ``_fn`` with ``m`` (the row a missing one becomes, or null), ``d`` (an existing one goes) and ``f`` (a function per column)."""
    image = F.struct(*[F.col(f"new.`{f.name}`").alias(f.name) for f in rest])
    nothing = F.lit(None).cast(T.StructType([T.StructField(f.name, f.dataType) for f in rest]))
    same = F.struct(*[_function(kinds[f.name], f.dataType).alias(f.name) for f in rest])
    whole = F.struct(*[_function(kinds[f.name], f.dataType, "set", F.col(f"new.`{f.name}`"), True).alias(f.name) for f in rest])

    def row(m: Column, d: bool, f: Column) -> Column:
        return F.struct(m.alias("m"), F.lit(d).alias("d"), f.alias("f"))

    ignored = row(nothing, False, same)
    by_op = {"INSERT": row(image, False, whole), "UPDATE": row(nothing, False, whole), "DELETE": row(nothing, True, same)}
    # the text of a value with old.c as zero gives what is added, and with old.c as null gives the other operands
    frame = events
    for zero in (True, False):
        frame = frame.withColumn("old", F.struct(*[F.lit(0 if zero and _exact(f.dataType) else None).cast(f.dataType).alias(f.name) for f in rest]))
        for i, statement in enumerate(statements.values()):
            for j, f in enumerate(rest):
                if f.name in statement.set and (_shape(events.sparkSession, statement.set[f.name], f.name) == "add") == zero:
                    # evaluated for the operation's own changes only
                    mine = F.col("_op") == F.lit(list(statements)[i])
                    frame = frame.withColumn(f"_v{i}_{j}", F.when(mine, F.expr(statement.set[f.name])))
    for i, (name, statement) in enumerate(statements.items()):
        functions = []
        for j, f in enumerate(rest):
            if f.name not in statement.set:
                functions.append(_function(kinds[f.name], f.dataType).alias(f.name))
                continue
            shape, value = _shape(events.sparkSession, statement.set[f.name], f.name), F.col(f"_v{i}_{j}").cast(f.dataType)
            constant = True if shape == "set" else value.isNull() if shape == "add" else False
            functions.append(_function(kinds[f.name], f.dataType, shape, value, constant).alias(f.name))
        done = row(image if statement.insert else nothing, False, F.struct(*functions))
        by_op[name] = F.when(F.coalesce(F.expr(statement.when), F.lit(False)), done).otherwise(ignored) if statement.when else done
    unknown = F.raise_error(F.concat(F.lit("no statement for operation "), F.coalesce(F.col("_op").cast("string"), F.lit("null"))))
    chosen = reduce(lambda acc, item: acc.when(F.col("_op") == item[0], item[1]), by_op.items(), F.when(F.lit(False), ignored)).otherwise(
        F.when(unknown.isNull(), ignored))
    single = frame.select(*keys, "_seq", chosen.alias("_fn"))
    kind = _nullable(single.schema["_fn"].dataType)
    single = single.withColumn("_fn", F.col("_fn").cast(kind))

    def merge(f: Column, g: Column) -> Column:
        struct = lambda value: F.struct(*[value(x).alias(x.name) for x in rest])
        made = struct(lambda x: _apply(g["f"][x.name], f["m"][x.name], kinds[x.name], x.dataType))
        m = F.when(f["m"].isNull(), g["m"]).when(~g["d"], made)
        put = struct(lambda x: _function(kinds[x.name], x.dataType, "set", g["m"][x.name], True))
        both = struct(lambda x: _after(f["f"][x.name], g["f"][x.name], kinds[x.name], x.dataType))
        d = F.when(f["d"], g["m"].isNull()).otherwise(g["d"])
        then = F.when(f["d"] & g["m"].isNotNull(), put).when(f["d"], f["f"]).when(g["d"], g["f"]).otherwise(both)
        return F.struct(m.alias("m"), d.alias("d"), then.alias("f")).cast(kind)

    def compose(df: DataFrame, order: str, by: Sequence[str]) -> DataFrame:
        listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "_fn"))).alias("_list"))
        return listed.select(*by, F.aggregate(F.col("_list"), ignored.cast(kind), lambda f, e: merge(f, e["_fn"])).alias("_fn"))

    hot = _hot(events, keys, run)
    cold = compose(single.join(hot, list(keys), "left_anti"), "_seq", keys)
    numbered = number_rows(single.join(hot, list(keys), "left_semi"), ["_seq"], keys, out="_n")
    width = hot.agg(F.max("_changes")).first()[0] or 0
    level, parts = compose(numbered.withColumn("_run", F.floor((F.col("_n") - 1) / run)), "_seq", [*keys, "_run"]), -(-width // run)
    while parts > FAN_IN:
        level = compose(level.withColumn("_next", F.floor(F.col("_run") / FAN_IN)), "_run", [*keys, "_next"]).withColumnRenamed("_next", "_run")
        parts = -(-parts // FAN_IN)
    return cold.unionByName(compose(level, "_run", keys))


def _hot(events: DataFrame, keys: Sequence[str], run: int) -> DataFrame:
    """Keys with more than ``run`` changes; counted before the shuffle and staged, so Catalyst knows how few they are."""
    return stage(events.groupBy(*keys).agg(F.count("*").alias("_changes")).where(F.col("_changes") > run), "hot")


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with all fields nullable, so that every function of a column has one type."""
    return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields]) if isinstance(kind, T.StructType) else kind


# ---- ordered fold


def _folded(
    target: DataFrame, events: DataFrame, statements: Mapping[str, Statement], keys: Sequence[str], rest: Sequence[T.StructField], run: int,
) -> DataFrame:
    """Changes of each key applied in order; keys with many changes in rounds, each over the rows that the round before left."""
    row_type = T.StructType([T.StructField(f.name, f.dataType) for f in rest])
    image = "named_struct(" + ", ".join(f"'{f.name}', new.`{f.name}`" for f in rest) + ")"
    types = {f.name: f.dataType.simpleString() for f in rest}
    by_op = {"INSERT": image, "UPDATE": f"IF(old IS NULL, old, {image})", "DELETE": "NULL"}
    for name, s in statements.items():
        # a value is computed for rows that exist only
        changed = "named_struct(" + ", ".join(
            f"'{c}', CAST({s.set[c]} AS {types[c]})" if c in s.set else f"'{c}', old.`{c}`" for c in types) + ")"
        done = f"CASE WHEN old IS NULL THEN {image if s.insert else 'old'} ELSE {changed} END"
        by_op[name] = f"CASE WHEN coalesce({s.when}, false) THEN {done} ELSE old END" if s.when else done
    quote = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    step = "CASE " + " ".join(f"WHEN new._op = {quote(o)} THEN {e}" for o, e in by_op.items()) + (
        " ELSE raise_error(concat('no statement for operation ', coalesce(CAST(new._op AS STRING), 'null'))) END")
    entry = F.struct("_seq", "_op", "new.*")

    def fold(rows: DataFrame, lists: DataFrame) -> DataFrame:
        """(keys, _row): rows (keys, _row) after the changes listed for their key; a row that goes is null."""
        both = rows.join(lists, list(keys), "full_outer").withColumn("_row", F.col("_row").cast(row_type))
        return both.select(*keys, F.when(F.col("_list").isNull(), F.col("_row")).otherwise(
            F.expr(f"aggregate(_list, _row, (old, new) -> {step})").cast(row_type)).alias("_row"))

    def listed(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_list"))

    hot = _hot(events, keys, run)
    rows = target.select(*keys, F.struct(*[f.name for f in rest]).alias("_row"))
    result = fold(rows.join(hot, list(keys), "left_anti"), listed(events.join(hot, list(keys), "left_anti")))
    width = hot.agg(F.max("_changes")).first()[0] or 0
    if width:
        numbered = stage(number_rows(events.join(hot, list(keys), "left_semi"), ["_seq"], keys, out="_n").withColumn(
            "_run", F.floor((F.col("_n") - 1) / run)), "runs")
        state = rows.join(hot, list(keys), "left_semi")
        for i in range(-(-width // run)):
            state = stage(fold(state, listed(numbered.where(F.col("_run") == i))), "folded")
        result = result.unionByName(state)
    return result.where("_row IS NOT NULL").select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in target.columns])

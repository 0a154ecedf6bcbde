"""Read-modify-write statements against a plain replay."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators.folds import Statement, _kinds, read_modify_write

TARGET = "id long, n long, money decimal(12,2), peak long, low int, first string, note string, ratio double"
CHANGES = "seq long, op string, ID long, n long, money decimal(12,2), peak long, low int, first string, note string, ratio double, other string"


def replay(target, changes, steps):
    """Rows after the changes in order; ``steps`` by operation: (row or None, change) to a row or None."""
    state = {r[0]: list(r[1:]) for r in target}
    for change in sorted(changes, key=lambda c: c[0]):
        row = steps[change[1]](state.get(change[2]), list(change[3:10]))
        if row is None:
            state.pop(change[2], None)
        else:
            state[change[2]] = list(row)
    return sorted((k, *v) for k, v in state.items())


def data(seed, n_keys=12, n=400, hot=0):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.15 else v
    row = lambda: (maybe(rng.randint(-50, 50)), maybe(Decimal(rng.randint(-5000, 5000)) / 100), maybe(rng.randint(-50, 50)),
                   maybe(rng.randint(-50, 50)), maybe(rng.choice("abc")), maybe(rng.choice("xyz")), maybe(rng.randint(0, 9) / 7))
    target = [(k, *row()) for k in range(0, n_keys, 2)]
    seqs = rng.sample(range(10 * n), n)
    ops = ["UPDATE"] * 8 + ["INSERT", "DELETE", "BUMP"]
    changes = [(s, rng.choice(ops), 3 if rng.random() < hot else rng.randrange(n_keys + 4), *row(), "x") for s in seqs]
    return target, changes


plus = lambda a, b: None if a is None or b is None else a + b
most = lambda *v: max((x for x in v if x is not None), default=None)
least = lambda *v: min((x for x in v if x is not None), default=None)

COMPOSED = {
    "UPDATE": Statement({"n": "old.n + ${N}", "money": "old.money - ${money}", "peak": "greatest(old.peak, ${peak})", "low": "least(old.low, ${low}, 40)",
                         "first": "coalesce(old.first, ${first})", "note": "concat(${note}, '!')"}, when="${n} IS NULL OR ${n} <> 7"),
    "BUMP": Statement({"n": "greatest(old.n, ${n})", "money": "old.money + 1", "low": "old.low + ${low}", "peak": "least(old.peak, ${peak})"}, insert=True),
}


def update(row, new):
    if row is None or new[0] == 7:
        return row
    return [plus(row[0], new[0]), plus(row[1], None if new[1] is None else -new[1]), most(row[2], new[2]), least(row[3], new[3], 40),
            row[4] if row[4] is not None else new[4], None if new[5] is None else new[5] + "!", row[6]]


def bump(row, new):
    if row is None:
        return new
    return [most(row[0], new[0]), plus(row[1], 1), least(row[2], new[2]), plus(row[3], new[3]), *row[4:]]


STEPS = {"INSERT": lambda row, new: new, "DELETE": lambda row, new: None, "UPDATE": update, "BUMP": bump}


def frames(spark, target, changes):
    return spark.createDataFrame(target, TARGET), spark.createDataFrame(changes, CHANGES).repartition(6)


@pytest.mark.parametrize("seed, run, hot", [(1, 100_000, 0), (2, 7, 0.4), (3, 1, 0.3), (4, 50, 0.6)])
def test_composed_changes_equal_a_replay(spark, seed, run, hot, monkeypatch):
    monkeypatch.setattr("sluice.operators.folds.FAN_IN", 3)
    target, changes = data(seed, hot=hot, n=250)
    before, feed = frames(spark, target, changes)
    out = read_modify_write(before, feed, COMPOSED, ["id"], run=run)
    assert out.columns == before.columns and out.schema == before.schema
    assert sorted(map(tuple, out.collect())) == replay(target, changes, STEPS)


ORDERED = {
    "UPDATE": Statement({"n": "old.n * 2 + ${n}", "ratio": "old.ratio + ${ratio}", "note": "concat(old.note, ${note})"}, when="old.n < ${n} OR old.n IS NULL"),
    "BUMP": {"n": "abs(old.n) % 11", "first": "old.note"},
}


def ordered_update(row, new):
    if row is None or not (row[0] is None or (new[0] is not None and row[0] < new[0])):
        return row
    return [None if row[0] is None or new[0] is None else row[0] * 2 + new[0], *row[1:5], plus(row[5], new[5]), plus(row[6], new[6])]


ORDERED_STEPS = {**STEPS, "UPDATE": ordered_update,
                 "BUMP": lambda row, new: row and [None if row[0] is None else abs(row[0]) % 11, *row[1:4], row[5], *row[5:]]}


@pytest.mark.parametrize("seed, run, hot", [(5, 100_000, 0), (6, 20, 0.4)])
def test_other_statements_are_folded_in_order(spark, seed, run, hot):
    target, changes = data(seed, hot=hot, n=120)
    # short notes, so that doubling them by appending stays small
    before, feed = frames(spark, target, changes)
    out = read_modify_write(before, feed, ORDERED, ["id"], run=run)
    assert sorted(map(tuple, out.collect())) == replay(target, changes, ORDERED_STEPS)


def test_kinds(spark):
    events = spark.createDataFrame([], f"_seq long, _op string, new struct<{', '.join(':'.join(c.split(' ', 1)) for c in TARGET.split(', '))}>".replace("decimal(12:2)", "decimal(12,2)"))
    rest = events.schema["new"].dataType.fields[1:]
    kinds = lambda column, text, when=None: _kinds(events, {"UPDATE": Statement({column: text}, when)}, rest)
    assert kinds("n", "old.n + new.n")["n"] == {"set", "add"}
    assert kinds("n", "OLD.N + length(concat('old.n', new.note))")["n"] == {"set", "add"}
    assert kinds("ratio", "greatest(old.ratio, new.ratio)")["ratio"] == {"set", "greatest"}
    for column, text in (("n", "old.n * new.n"), ("n", "old.peak + new.n"), ("n", "old.n + old.n"), ("ratio", "old.ratio + new.ratio"), ("n", "old.n + new.ratio"),
                         ("money", "old.money + new.ratio"), ("money", "old.money + 0.125"), ("n", "coalesce(new.n, old.n)"), ("n", "greatest(old.n)")):
        assert text == "greatest(old.n)" or kinds(column, text) is None
    assert kinds("n", "new.n", "old.n > 1") is None


def test_refusals_and_empty_tables(spark):
    target, changes = data(9, n=20)
    before, feed = frames(spark, target, changes)
    for statements in ({"UPDATE": {"absent": "1"}}, {"UPDATE": {"n": "${absent}"}}, {"UPDATE": {"id": "1"}}):
        with pytest.raises(ValueError):
            read_modify_write(before, feed, statements, ["id"])
    for statements in ({"UPDATE": {"n": "old.n + 1"}}, {"UPDATE": {"n": "old.n * 2"}}):  # BUMP has no statement
        with pytest.raises(Exception, match="no statement for operation BUMP"):
            read_modify_write(before, feed, statements, ["id"]).collect()
        with pytest.raises(Exception, match="key column id is null"):
            read_modify_write(before, feed.where("op = 'UPDATE'").withColumn("ID", F.lit(None).cast("long")), statements, ["id"]).collect()
        none = feed.limit(0)
        assert sorted(map(tuple, read_modify_write(before, none, statements, ["id"]).collect())) == sorted(target)
        assert read_modify_write(before.limit(0), none, statements, ["id"]).collect() == []


def test_a_hot_counter_is_spread_over_tasks(spark):
    """A third of all changes count on one key: its runs are composed apart, and no group is longer than a run."""
    n = 30_000
    feed = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("UPDATE").alias("op"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit(2).cast("long").alias("n"))
    target = spark.createDataFrame([(-1, 5), (1, 1)], "id long, n long")
    out = read_modify_write(target, feed, {"UPDATE": {"n": "old.n + ${n}"}}, ["id"], run=500)
    assert sorted(map(tuple, out.collect())) == [(-1, 5 + 2 * (n // 3)), (1, 3)]


def test_sums_may_leave_the_range_in_between(spark):
    big = 2**62
    target = spark.createDataFrame([(1, -big)], "id long, n long")
    feed = spark.createDataFrame([(1, "UPDATE", 1, big), (2, "UPDATE", 1, big), (3, "UPDATE", 1, big // 2)], "seq long, op string, id long, n long")
    out = read_modify_write(target, feed, {"UPDATE": {"n": "old.n + ${n}"}}, ["id"])
    assert out.first().n == big + big // 2

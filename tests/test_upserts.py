import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluice.operators.upserts import (
    apply_changes, apply_net, custom_write, delete_rows, net_changes, update_rows, upsert,
)
from sluice.session import stage
from sluice.sinks import KeyedTable, merge_statement

TARGET = "id int, a int, b string"
CHANGE = "seq long, op string, before struct<id: int, a: int, b: string>, after struct<id: int, a: int, b: string>"


def replay(base, changes):
    state = {r[0]: r for r in base}
    for _, op, before, after in sorted(changes, key=lambda c: c[0]):
        if op == "DELETE":
            state.pop(before[0], None)
        elif op == "INSERT" or after[0] in state:
            state[after[0]] = after
    return sorted(state.values(), key=str)


def random_changes(seed, n, keys):
    rng = random.Random(seed)
    changes = []
    for seq in range(n):
        key = rng.choice(keys)
        image = (key, rng.choice([None, rng.randrange(100)]), rng.choice([None, "x", "y"]))
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        changes.append((seq, op, image, None) if op == "DELETE" else (seq, op, None, image))
    rng.shuffle(changes)
    return changes


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_apply_changes_equals_replay(spark, seed, n):
    base = [(k, k, "base") for k in range(0, 12, 2)]
    changes = random_changes(seed, n, list(range(12)))
    target, batch = spark.createDataFrame(base, TARGET), spark.createDataFrame(changes, CHANGE)
    wanted = replay(base, changes)
    assert sorted((tuple(r) for r in apply_changes(target, batch, ["id"]).collect()), key=str) == wanted
    # the way for small batches gives the same
    net = stage(net_changes(target, batch, ["id"]), "net")
    assert sorted((tuple(r) for r in apply_net(target, net, ["id"], lookup=True).collect()), key=str) == wanted


def test_hot_key_with_many_changes(spark):
    target = spark.createDataFrame([(1, 0, "base")], TARGET)
    changes = spark.range(20_000).select(
        F.col("id").alias("seq"), F.lit("UPDATE").alias("op"),
        F.struct(F.lit(1).alias("id"), F.col("id").cast("int").alias("a"), F.lit("n").alias("b")).alias("after"),
    ).withColumn("before", F.col("after"))
    assert [tuple(r) for r in apply_changes(target, changes, ["id"]).collect()] == [(1, 19_999, "n")]


def test_small_batch_does_not_shuffle_the_target(spark, plan, tmp_path):
    spark.range(1000).select(F.col("id").cast("int"), F.lit(1).alias("a"), F.lit("x").alias("b")).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    net = stage(net_changes(target, spark.createDataFrame([(1, "UPDATE", None, (5, 9, "z"))], CHANGE), ["id"]), "net")
    text = plan(apply_net(target, net, ["id"], lookup=True))
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 2


def test_null_keys_are_refused(spark):
    target = spark.createDataFrame([(1, 0, "x")], TARGET)
    bad = spark.createDataFrame([(1, "INSERT", None, (None, 1, "x"))], CHANGE)
    with pytest.raises(Exception, match="key column id is null"):
        apply_changes(target, bad, ["id"]).collect()
    with pytest.raises(Exception, match="key column id is null"):
        upsert(target, spark.createDataFrame([(None, 1, "x")], TARGET), ["id"]).collect()


def test_upsert_update_delete(spark, rows):
    target = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], TARGET)
    part = spark.createDataFrame([(2, 5), (3, 6)], "id int, a int")
    assert rows(upsert(target, part, ["id"])) == [(1, 10, "x"), (2, 5, None), (3, 6, None)]
    assert rows(update_rows(target, part, ["id"])) == [(1, 10, "x"), (2, 5, None)]
    assert rows(delete_rows(target, part, ["id"])) == [(1, 10, "x")]
    seen = spark.createDataFrame([(3, 1, 1), (3, 2, 2)], "id int, a int, seq int")
    assert rows(upsert(target, seen, ["id"], "seq"), "id", "a") == [(1, 10), (2, 20), (3, 2)]


def test_composite_keys(spark, rows):
    target = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, l string, v int")
    changes = spark.createDataFrame([(1, "UPDATE", 1, "b", 9), (2, "DELETE", 1, "a", None), (3, "INSERT", 2, "a", 7)],
                                    "seq int, op string, k int, l string, v int")
    assert rows(apply_changes(target, changes, ["k", "l"], before=None)) == [(1, "b", 9), (2, "a", 7)]


def test_custom_write(spark, rows):
    target = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], TARGET)
    changes = spark.createDataFrame([
        (1, "UPDATE", 1, 5, "u"),   # sets a only
        (2, "DELETE", 1, 0, None),  # soft delete
        (3, "INSERT", 3, 7, "i"),
        (4, "UPDATE", 3, 8, "u"),
        (5, "UPDATE", 4, 8, "u"),   # no such row
        (6, "DELETE", 2, 0, None),
        (7, "INSERT", 2, 1, "again"),
    ], "seq int, op string, id int, a int, b string")
    templates = {"UPDATE": {"a": "${A} * 100"}, "DELETE": {"b": "'gone'"}}
    assert rows(custom_write(target, changes, templates, ["id"])) == [(1, 500, "gone"), (2, 1, "again"), (3, 800, "i")]
    with pytest.raises(ValueError, match="nope"):
        custom_write(target, changes, {"UPDATE": {"a": "${nope}"}}, ["id"])


def test_custom_write_without_templates_is_apply_changes(spark, rows):
    base = [(k, k, "base") for k in range(0, 8, 2)]
    target = spark.createDataFrame(base, TARGET)
    flat = [(s, op, *(after or before)) for s, op, before, after in random_changes(3, 50, list(range(8)))]
    changes = spark.createDataFrame(flat, "seq int, op string, id int, a int, b string")
    assert rows(custom_write(target, changes, {}, ["id"])) == rows(apply_changes(target, changes, ["id"], before=None))


def test_a_batch_merged_again_changes_nothing(spark, rows, tmp_path):
    table = KeyedTable(str(tmp_path / "table"), TARGET, ("id",), 2)
    table.replace(spark.createDataFrame([(1, 10, "x")], TARGET))
    batch = spark.createDataFrame([(1, "INSERT", None, (2, 20, "y")), (2, "UPDATE", None, (7, 1, "none")), (3, "INSERT", None, (3, 1, "a")), (4, "DELETE", (3, 1, "a"), None)], CHANGE)
    for _ in range(2):
        table.merge(batch)
        assert rows(table.read(spark)) == [(1, 10, "x"), (2, 20, "y")]
    table.merge(spark.createDataFrame([(9, "DELETE", (1, 0, ""), None)], CHANGE))
    assert rows(table.read(spark)) == [(2, 20, "y")]
    table.merge(spark.createDataFrame([(9, "DELETE", (2, 0, ""), None)], CHANGE))
    assert rows(table.read(spark)) == []
    table.replace(spark.createDataFrame([], TARGET))
    table.merge(batch)
    assert rows(table.read(spark)) == [(2, 20, "y")]


def test_merged_batches_equal_a_replay(spark, rows, tmp_path):
    base = [(i, i, "s") for i in range(0, 30, 2)]
    table = KeyedTable(str(tmp_path / "t"), TARGET, ("id",), 5)
    table.replace(spark.createDataFrame(base, TARGET))
    state = spark.createDataFrame(base, TARGET)
    for seed in range(3):
        batch = spark.createDataFrame(random_changes(seed, 40, list(range(30))), CHANGE)
        table.merge(batch)
        state = apply_changes(state, batch, ["id"])
        assert rows(table.read(spark)) == rows(state)


def test_merge_statement():
    text = merge_statement("t", "net", ["id"], ["id", "a"])
    assert text.startswith("MERGE INTO t t USING net n ON t.`id` = n.`id`")
    assert "WHEN MATCHED AND n._state = 'DROP' THEN DELETE" in text and "SET t.`a` = n._new.`a`" in text


def test_columns_match_ignoring_case(spark, rows):
    target = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], TARGET)
    flat = spark.createDataFrame([(1, 7, "n")], "ID int, A int, B string")
    assert rows(upsert(target, flat, ["id"])) == [(1, 7, "n"), (2, 0, "y")]
    assert rows(update_rows(target, flat, ["id"])) == [(1, 7, "n"), (2, 0, "y")]
    image = "struct<ID int, A int, B string>"
    batch = spark.createDataFrame([(1, "UPDATE", None, (1, 7, "n")), (2, "DELETE", (2, 0, ""), None)], f"seq int, op string, before {image}, after {image}")
    assert rows(apply_changes(target, batch, ["id"])) == [(1, 7, "n")]
    change = spark.createDataFrame([(1, "UPDATE", 1, 7, "n")], "seq int, op string, ID int, A int, B string")
    assert rows(custom_write(target, change, {}, ["id"])) == [(1, 7, "n"), (2, 0, "y")]


def test_keys_have_to_be_known_and_single(spark):
    target = spark.createDataFrame([(1, 0, "x")], TARGET)
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], TARGET)
    for write in (upsert, update_rows):
        with pytest.raises(Exception, match="several rows"):
            write(target, twice, ["id"]).collect()
        with pytest.raises(Exception, match="key column id is null"):
            write(target, spark.createDataFrame([(None, 1, "a")], TARGET), ["id"]).collect()
    with pytest.raises(Exception, match="key column id is null"):
        delete_rows(target, spark.createDataFrame([(None, 1, "a")], TARGET), ["id"]).collect()


def test_only_touched_buckets_are_written(spark, rows, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), TARGET, ("id",), 8)
    table.replace(spark.range(200).selectExpr("int(id) id", "0 a", "'x' b"))

    def files():
        return {str(p) for p in (tmp_path / "t").glob("_bucket=*/*.parquet")}

    before = files()
    one = spark.createDataFrame([(1, "UPDATE", None, (5, 9, "z"))], CHANGE)
    assert table.merge(one) == 1 and len({p.rsplit("/", 2)[1] for p in files() - before}) == 1
    before = files()
    assert table.merge(one.limit(0)) == 0 and files() == before
    table.merge(spark.createDataFrame([(1, "INSERT", None, (900, 1, "n")), (2, "DELETE", (7, 0, ""), None)], CHANGE))
    found = {r[0]: r[1] for r in rows(table.read(spark))}
    assert len(found) == 200 and found[5] == 9 and found[900] == 1 and 7 not in found
    gone = spark.range(200).selectExpr("id seq", "'DELETE' op", "struct(int(id) id, 0 a, 'x' b) before", "struct(int(id) id, 0 a, 'x' b) after")
    table.merge(gone)
    assert rows(table.read(spark)) == [(900, 1, "n")]

from datetime import date, datetime

from pyspark.sql import functions as F

from sluice.operators import align as al
from sluice.operators.upserts import apply_changes

COLS = "k int, a int, b string"


def sides(spark):
    left = spark.createDataFrame([(1, 1, "x"), (2, None, "y"), (3, 3, None), (4, 4, "same"), (None, 5, "n")], COLS)
    right = spark.createDataFrame([(1, 9, "x"), (2, None, "y"), (3, 3, "z"), (4, 4, "same"), (6, 6, "r")], COLS)
    return left, right


def test_count(spark, rows):
    left, right = sides(spark)
    assert rows(al.align_count(left, right)) == [(5, 5, True)]
    assert (6, 0, 1, False) in rows(al.align_count(left, right, ["k"]))
    empty = left.filter("k > 99")
    assert rows(al.align_count(empty, empty)) == [(0, 0, True)]


def test_content_null_equals_null(spark, rows):
    assert rows(al.align_content(*sides(spark), ["k"])) == [
        (None, "LEFT_ONLY"), (1, "DIFFERENT"), (3, "DIFFERENT"), (6, "RIGHT_ONLY"),
    ]
    assert rows(al.align_content(*sides(spark), ["k"], ["a"])) == [(None, "LEFT_ONLY"), (1, "DIFFERENT"), (6, "RIGHT_ONLY")]


def test_content_with_copies_of_a_key(spark, rows):
    left = spark.createDataFrame([(1, 1, "x")] * 3 + [(2, 2, "y")] * 2, COLS)
    right = spark.createDataFrame([(1, 1, "x")] * 3 + [(2, 2, "y")], COLS)
    assert rows(al.align_content(left, right, ["k"])) == [(2, "DIFFERENT")]


def test_hot_key_does_not_multiply(spark, rows, plan):
    left = spark.range(30_000).select(F.lit(1).alias("k"), F.lit(1).alias("a"))
    diff = al.align_content(left, left, ["k"])
    assert rows(diff) == []
    assert "Join" not in plan(diff)


def test_diff_fields(spark, rows):
    assert rows(al.align_diff_fields(*sides(spark), ["k"])) == [(1, "a", "1", "9"), (3, "b", None, "z")]


def test_sample_takes_the_same_keys_on_both_sides(spark, rows):
    left = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("a"))
    right = spark.range(1000).select(F.col("id").alias("k"), F.lit(2).alias("a"))
    parts = [rows(al.align_sample(left, right, ["k"], 4, n)) for n in (1, 4)]
    assert 150 < len(parts[0]) < 350 and len(parts[1]) == 1000 and set(parts[0]) < set(parts[1])


def test_range_reaches_both_scans(spark, plan, tmp_path):
    df = spark.range(10).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    out = al.align_range(t, t.filter("id <> 5"), "ts", datetime(1970, 1, 1, 0, 0, 5), datetime(1970, 1, 1, 0, 0, 7), ["id"])
    assert [tuple(r) for r in out.collect()] == [(5, "LEFT_ONLY")]
    assert plan(out).count("GreaterThanOrEqual(ts") == 2


def test_repair_makes_right_equal_left(spark, rows):
    left, right = [df.filter("k IS NOT NULL") for df in sides(spark)]
    repair = al.align_repair(left, right, ["k"]).withColumn("seq", F.lit(1))
    assert sorted(r["op"] for r in repair.collect()) == ["DELETE", "UPDATE", "UPDATE"]
    assert rows(apply_changes(right, repair, ["k"], before=None)) == rows(left)


def test_report(spark, rows):
    runs = spark.createDataFrame([("t", datetime(2024, 1, 7, 5), True), ("t", datetime(2024, 1, 7, 6), False), ("t", datetime(2024, 1, 5), True),
                                  ("old", datetime(2023, 1, 1), True)], "task string, day timestamp_ntz, ok boolean")
    out = rows(al.align_report(runs, date(2024, 1, 7)).filter("runs > 0"), "task", "date", "runs", F.col("success_rate").cast("string"), "is_today")
    assert out == [("t", date(2024, 1, 5), 1, "100.00", False), ("t", date(2024, 1, 7), 2, "50.00", True)]
    assert al.align_report(runs, date(2024, 1, 7)).count() == 14

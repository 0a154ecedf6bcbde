import json
import os

import pytest
from pyspark.sql import functions as F

from sluice import plans
from sluice.sources import (
    assign_pages, bucket_count, deep_page_query, include_tables, kafka_options, open_source, page_query, parse_change_events, read_shards, scroll_pages,
    scroll_query, shard_route, snapshot_then_changes, sql_query, write_buckets, write_shards,
)
from sluice.sources import tables
from sluice.sources.tables import jdbc_options

FOLDER = "/root/testdata/sf0.001"

IMAGE = "id bigint, name string"


def envelopes(spark, *events):
    return spark.createDataFrame(
        [(i, topic, value if isinstance(value, str) else json.dumps(value)) for i, (topic, value) in enumerate(events)],
        "seq long, topic string, value string",
    )


def test_sql_query_binds_arguments(spark):
    df = spark.range(5)
    assert sql_query(spark, {"t": df}, "SELECT id FROM t WHERE id >= :low", {"low": 3}).count() == 2


def test_open_source_formats(spark, tmp_path):
    df = spark.range(3)
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert open_source(spark, {"format": kind, "path": str(tmp_path / kind)}).count() == 3
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    assert open_source(spark, {"format": "csv", "path": str(tmp_path / "csv"), "header": "true"}).columns == ["id"]


def test_jdbc_options():
    whole = jdbc_options("jdbc:x", "SELECT 1")
    assert whole["query"] == "SELECT 1" and "dbtable" not in whole
    split = jdbc_options("jdbc:x", "SELECT 1", 500, {"column": "id", "lower": 0, "upper": 100, "count": 8})
    assert (split["partitionColumn"], split["numPartitions"], split["fetchsize"]) == ("id", "8", "500")
    assert split["dbtable"] == "(SELECT 1) src"


def test_kafka_options():
    plain = kafka_options("h:1", "t", "g")
    assert plain["kafka.group.id"] == "g" and "minOffsetsPerTrigger" not in plain
    batch = kafka_options("h:1", "t", batch=True, batch_size=50, timeout_ms=200)
    assert (batch["minOffsetsPerTrigger"], batch["maxTriggerDelay"]) == ("50", "200ms")


def test_pages_agree_with_single_page_queries(spark, rows):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 5).alias("k"))
    paged = assign_pages(df, ["k", F.desc("id")], 10)
    assert paged.agg(F.max("page_no")).first()[0] == 11
    for page in (1, 5, 11):
        single = rows(page_query(df, ["k", F.desc("id")], page, 10))
        assert single == rows(paged.filter(F.col("page_no") == page).drop("page_no"))
        deep = deep_page_query(df, ["k", F.desc("id")], page, 10).collect()
        assert rows(spark.createDataFrame(deep).drop("position")) == single
        assert [r["position"] for r in deep] == list(range(page * 10 - 9, page * 10 - 9 + len(single)))
    assert page_query(df, ["id"], 12, 10).count() == 0
    with pytest.raises(ValueError):
        page_query(df, ["id"], 0, 10)


def test_scroll(spark, rows):
    df = spark.createDataFrame([(i if i != 4 else None, str(i)) for i in range(9)], "Id int, v string")
    assert [r["Id"] for r in scroll_query(df, "id", 3).collect()] == [None, 0, 1]
    assert [r["Id"] for r in scroll_query(df, "id", 2, after=1, order_by=[("ID", True)]).collect()] == [8, 7]
    with pytest.raises(ValueError):
        scroll_query(df, "id", 2, order_by=[("v", False)])
    assert [r["Id"] for r in scroll_query(df, "ID", 3, after=5).collect()] == [6, 7, 8]
    assert scroll_query(df, "id", 3, after=8).count() == 0
    assert scroll_pages(df, "id", 3).count() == 9  # the null comes first
    with pytest.raises(ValueError):
        scroll_query(df, "other", 3)


def test_scroll_bound_reaches_the_scan(spark, plan, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    text = plan(scroll_query(spark.read.parquet(str(tmp_path / "t")), "id", 3, after=5))
    assert "GreaterThan(id,5)" in text and "TakeOrderedAndProject" in text


def test_parse_change_events_skips(spark, rows):
    row = {"id": 1, "name": "a"}
    events = envelopes(
        spark,
        ("p.s.t", {"op": "c", "before": None, "after": row}),
        ("p.s.t", {"ts_ms": 5}),                                        # heartbeat
        ("p.s.t", {"op": "?", "before": None, "after": row}),           # unknown operation
        ("p.s.t", {"op": "d", "before": None, "after": None}),          # no image
        ("p.s.t", {"op": "d", "before": {"id": None, "name": None}, "after": None}),  # empty image
        ("s.t", {"op": "u", "before": row, "after": row}),              # topic without a table
        ("p.s.t.x", {"op": "d", "before": row, "after": None}),
        ("p.s.t", {"op": "r", "before": None, "after": row}),           # not listed
        ("p.s.t", {"op": "t", "before": None, "after": row}),           # truncate counts as insert
        ("p.s.t", "not json"),
    )
    parsed = parse_change_events(events, IMAGE, ["CREATE", "UPDATE", "DELETE", "TRUNCATE"])
    assert rows(parsed, "seq", "src_schema", "src_table", "op") == [
        (0, "s", "t", "INSERT"), (5, None, None, "UPDATE"), (6, "s", "t", "DELETE"), (8, "s", "t", "INSERT"),
    ]
    with pytest.raises(ValueError):
        parse_change_events(events, IMAGE, ["UPSERT"])


def test_snapshot_then_changes(spark, rows):
    events = envelopes(spark, ("p.s.t", {"op": "u", "before": None, "after": {"id": 1, "name": "new"}}))
    changes = parse_change_events(events, IMAGE)
    snapshot = spark.createDataFrame([(7, "old", 1.5)], "id int, name string, extra double")
    assert rows(snapshot_then_changes(snapshot, changes), "seq", "op") == [(-1, "INSERT"), (0, "UPDATE")]
    assert snapshot_then_changes(snapshot, changes, ["UPDATE"]).count() == 1


def test_include_tables(spark, rows):
    df = spark.createDataFrame([("s", "a"), ("s", "ab"), ("x", "a"), (None, None)], "src_schema string, src_table string")
    assert rows(include_tables(df, tables="S.A")) == [("s", "a")]
    assert rows(include_tables(df, tables="s.a, x.a")) == [("s", "a"), ("x", "a")]
    assert rows(include_tables(df, schemas="x")) == [("x", "a")]
    assert include_tables(df).count() == 4


def test_shards_round_trip_and_prune(spark, rows, plan, tmp_path):
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    path = str(tmp_path / "shards")
    write_shards(df, path, "k", 10)
    back = read_shards(spark, path)
    assert rows(back, "k", "id") == rows(df)
    routed = shard_route(df, "k", 10, "t_")
    assert rows(back, "k", F.col("shard").cast("int")) == rows(routed, "k", "shard")
    assert "PartitionFilters: [isnotnull(shard" in plan(back.filter("shard = 3"))
    assert read_shards(spark, [df, df]).count() == 400




def test_buckets_join_without_exchange_and_open_one_bucket(spark, plan, tmp_path):
    left = spark.range(1000).selectExpr("id % 97 AS k", "id AS v")
    right = spark.range(97).selectExpr("id AS k", "id * 2 AS w").union(spark.sql("SELECT cast(null AS BIGINT), 5L"))
    a = write_buckets(left, "bucket_test_a", "k", 4, str(tmp_path / "a"))
    b = write_buckets(right, "bucket_test_b", "k", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "k")
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert "Exchange" not in plan(a.groupBy("k").count())
        scan = a.where("k = 7")._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.optionalBucketSet().get().cardinality() == 1
        assert len(list((tmp_path / "a").glob("*.parquet"))) == 4
        assert sorted(map(tuple, joined.collect())) == sorted((i % 97, i, 2 * (i % 97)) for i in range(1000))
        assert b.where("k IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucket_test_a")
        spark.sql("DROP TABLE bucket_test_b")


def test_buckets_grow_with_the_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 100, raising=False)
    counts = [bucket_count(8, spark.range(5), spark.range(n)) for n in (0, 800, 801, 6000)]
    assert counts == [8, 8, 16, 64]
    if os.path.isdir(FOLDER):
        joined = plans.queries()["a11_bucketed_join"](spark, FOLDER)
        scans = joined.select("l_partkey").inputFiles()
        assert len({f.rsplit("_", 1)[1] for f in scans}) > 8  # the bucket's number is in the name of its file


def test_words_stay_with_their_text(spark, plan, monkeypatch):
    """The texts are exchanged, in partitions by their characters, and their words are not."""
    if not os.path.isdir(FOLDER):
        pytest.skip("given tables are not here")
    monkeypatch.setattr(tables, "TASK_CHARS", 1 << 14, raising=False)
    words = plans.queries()["k10_explode"](spark, FOLDER)
    text = plan(words)
    assert text.count("\nArguments: hashpartitioning") == 1 and text.index("hashpartitioning") > text.index("Generate")
    chars = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    assert words.rdd.getNumPartitions() == -(-chars // (1 << 14))
    assert tables.place_texts(spark.sql("SELECT 1 AS k, cast(null AS string) AS t"), "k", "t").count() == 1

"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice import plans
from sluice.operators.upserts import upsert
from sluice.session import build_session, stage, staging_path
from sluice.sinks import KeyedTable
from sluice.sources import read_stream_query
from sluice.streaming import run_changes

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# registered queries timed as they are
REGISTERED = (
    "a4_assign_pages", "a6_parse_change_events", "a10_shard_route", "b5_normalize_document", "b12_mask_texts",
    "c4_apply_changes", "c5_custom_write", "d1_dedupe_messages", "e2_align_content", "e3_align_diff_fields",
    "e6_align_repaired", "f4_page_with_total", "f5_query_log_stats", "g1_distinct_join", "g9_contributors", "g12_json_values",
    "h4_reachable", "i4_flow_series", "i11_silence", "i12_deliver", "i13_alarm_outcome", "i15_parse_log_lines",
    "k1_left_join", "k3_aggregate", "k4_grouping_sets", "k5_ranking", "k10_explode",
)

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def run(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def batch_flow(spark: SparkSession) -> None:
    """Full scan of the lines, upserted into a table that already has them."""
    source = {"format": "parquet", "path": f"{FOLDER}/lineitem.parquet"}
    rows = read_stream_query(spark, source, "SELECT *, l_shipdate AS seq FROM source")
    target = spark.read.parquet(f"{FOLDER}/lineitem.parquet").dropDuplicates(LINE_KEYS)
    upsert(target, rows, LINE_KEYS, "seq").write.parquet(staging_path(spark, "bench"))


def line_envelopes(spark: SparkSession) -> DataFrame:
    """Every line as a change envelope, staged as the input of the stream."""
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    code = F.when(F.col("l_returnflag") == "A", "u").when(F.col("l_returnflag") == "R", "d").otherwise("c")
    image = F.struct(*LINE_KEYS, "l_quantity", "l_extendedprice")
    return stage(lines.select(
        F.monotonically_increasing_id().alias("seq"), F.lit("p.shop.lines").alias("topic"),
        F.to_json(F.struct(
            code.alias("op"), F.when(code == "d", image).alias("before"), F.when(code != "d", image).alias("after"),
        )).alias("value"),
    ), "bench-envelopes")


IMAGE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double"


def stream_flow(spark: SparkSession, envelopes: DataFrame, files_per_batch: int | None = None) -> None:
    """Change envelopes from files, parsed and applied to a table of key buckets, with checkpoint."""
    table = KeyedTable(staging_path(spark, "bench-target"), IMAGE, tuple(LINE_KEYS), 16)
    base = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select(*LINE_KEYS, "l_quantity", "l_extendedprice")
    table.replace(base.dropDuplicates(LINE_KEYS))
    options = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {}
    feed = spark.readStream.schema(envelopes.schema).options(**options).parquet(*envelopes.inputFiles()[0].rsplit("/", 1)[:1])
    began = time.time()
    run_changes(feed, IMAGE, table, staging_path(spark, "bench-progress")).awaitTermination()
    stream_flow.seconds = time.time() - began


def timed(fn) -> float:
    began = time.time()
    fn()
    return time.time() - began


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "bench", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
        spark__checkpoint__dir=os.environ.get("BENCH_STAGING") or tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    known, seconds = plans.queries(), {}
    run(known["k3_aggregate"](spark, FOLDER))  # warm the JVM

    batch_flow(spark)
    print("warm", file=sys.stderr, flush=True)
    seconds["batch_scan_upsert"] = timed(lambda: batch_flow(spark))
    envelopes = line_envelopes(spark)
    stream_flow(spark, envelopes)
    stream_flow(spark, envelopes)
    seconds["stream_parse_apply"] = stream_flow.seconds
    # the same changes over ten micro-batches, each of which rewrites the buckets it touches
    stream_flow(spark, stage(envelopes.repartition(10), "bench-envelopes"), 1)
    seconds["stream_ten_batches"] = stream_flow.seconds
    print(seconds, file=sys.stderr, flush=True)
    for name in REGISTERED:
        seconds[name] = timed(lambda: run(known[name](spark, FOLDER)))
        print(f"{name} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "rows_per_second": {
            "batch_scan_upsert": round(n_lines / seconds["batch_scan_upsert"]),
            "stream_parse_apply": round(n_lines / seconds["stream_parse_apply"]),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()

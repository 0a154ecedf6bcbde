"""Time operators on lines copied ten times, once with even keys and once with a third of all rows under one key."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from sluice.functions import number_rows
from sluice.operators.align import align_content
from sluice.operators.monitor import clear_trailing, last_errors, parse_log_lines
from sluice.operators.relational import contributors, enrich
from sluice.operators.upserts import apply_changes
from sluice.session import build_session, stage
from sluice.streaming import dedupe_messages

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    spark = build_session("local[8]", "skew", spark__sql__shuffle__partitions="16", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    for kind in ("even", "hot"):
        hot = F.lit(kind == "hot") & (F.pmod(F.xxhash64("l_orderkey", "l_partkey", "copy"), F.lit(3)) == 0)
        rows = stage(lines.select(
            F.monotonically_increasing_id().alias("seq"),
            F.when(hot, -1).otherwise(F.col("l_orderkey")).alias("k"),
            F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("type"), "l_shipdate",
        ), "skew")
        target = rows.groupBy("k").agg(F.max("v").alias("v"))
        changes = rows.select("seq", "k", "v", F.when(F.col("type") == "R", "DELETE").otherwise("UPDATE").alias("op"))
        lookup = target.select("k", F.col("v").alias("top"))
        files = number_rows(rows, ["seq"], ["k"], out="line_no").select(
            F.col("k").alias("file"), "line_no", F.concat(F.lit("text "), "seq").alias("text"))
        jobs = {
            "apply_changes": lambda: apply_changes(target, changes, ["k"], before=None),
            "align_content": lambda: align_content(rows.select("k", "v"), rows.filter("v < 50").select("k", "v"), ["k"]),
            "number_rows": lambda: number_rows(rows, ["seq"], ["k"]),
            "dedupe_messages": lambda: dedupe_messages(rows, ["k"], "l_shipdate", "seq", 60 * 24 * 365),
            "last_errors": lambda: last_errors(rows, 5, "k"),
            "clear_trailing": lambda: clear_trailing(rows, "R", "k"),
            "enrich": lambda: enrich(rows, lookup, "k", ["top"]),
            "contributors": lambda: contributors(
                lookup.select(F.col("k").alias("record_id"), F.lit(1).cast("long").alias("creator")),
                rows.select(F.col("k").alias("record_id"), F.col("seq").alias("user_id")), 3),
            "parse_log_lines": lambda: parse_log_lines(files),
        }
        for name, job in jobs.items():
            began = time.time()
            job().write.format("noop").mode("overwrite").save()
            print(f"{kind:5} {name:18} {time.time() - began:6.2f}s", flush=True)


if __name__ == "__main__":
    main()

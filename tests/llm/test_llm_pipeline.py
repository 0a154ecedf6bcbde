"""The pipeline and the registered queries of the text operators."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sluice.llm import queries
from tools.check import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@given
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, FOLDER))
    names, wanted = sql_rows(connect(FOLDER), queries.ORACLES[name])
    assert columns == names and rows == wanted


@given
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_gives_rows(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    table = "pages" if name == "op7_link_trust" else "documents"
    if name != "op2_pigeonhole_decontam":
        assert frame.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    else:
        assert frame.where("distance = 0").count() > 0


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    """Clean documents of two languages, a boilerplate line, copies, a benchmark passage, and rows without a language."""
    rng = random.Random(8)
    kinds = {"aa": ["ba", "no", "ti", "re", "lu"], "bb": ["zu", "ke", "wy", "xo", "qua"]}
    passage = words(rng, kinds["aa"], 30)
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, "cookie notice here\n" + words(rng, kinds[lang], 60), lang, f"s{i % 3}", 0))
    rows.append((60, rows[4][1], "bb", "s1", 0))  # a copy
    near = rows[7][1].split(" ")
    near[20] = "changed"
    rows.append((61, " ".join(near), "aa", "s2", 0))
    rows.append((62, words(rng, kinds["aa"], 20) + "\n" + passage.upper() + "\n" + words(rng, kinds["aa"], 20), "aa", "s0", 0))
    rows += [(63, "12 34 ##", None, "s0", 0), (64, None, "aa", "s0", 0), (65, "", None, None, 0), rows[9]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, folder)
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != "encode":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            assert docs.where(F.col("text").contains("cookie notice")).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    clean = [*range(60)]
    assert kept["language_id"] == sorted([*clean, 9, 60, 61, 62])
    assert kept["line_dedup"] == kept["language_id"]
    assert kept["near_dedup"] == [*clean, 62]
    assert kept["decontaminate"] == kept["encode"] == clean


def test_no_unique_text_is_lost_under_a_shared_id(spark):
    rng = random.Random(3)
    syllables = ["ba", "no", "ti", "re", "lu"]
    a, b, c = (words(rng, syllables, 60) for _ in range(3))
    near_c = c.replace(c.split()[30], "other", 1)
    rows = [(3, b), (5, a), (5, b), (6, None), (6, ""), (6, "  "), (5, c), (5, near_c), (8, near_c), (None, a), (None, words(rng, syllables, 40)), (5, a)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    one_of = [k for k in kept if k in ((5, c), (5, near_c))]
    assert len(one_of) == 1 and kept.pop(one_of[0]) == 1
    assert kept == Counter([(3, b), (5, a), (6, None), (6, ""), (6, "  "), rows[10]])


def test_a_rejected_text_takes_no_other_text_of_its_id_along(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(1).select(F.lit(7).cast("long").alias("doc_id"), F.lit("12 34 ##").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    out = corpus_pipeline.language_id(spark, docs.unionByName(odd), folder).where("doc_id = 7").collect()
    assert len(out) == 1 and out[0].text != "12 34 ##"
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    odd = odd.withColumn("text", F.lit(passage))
    out = corpus_pipeline.decontaminate(spark, docs.unionByName(odd), folder).where("doc_id = 7").collect()
    assert len(out) == 1 and out[0].text != passage


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [*range(60)]
    assert out.where("NOT round_trip").count() == 0 and entry.queries()["pipeline"] is corpus_pipeline.run


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

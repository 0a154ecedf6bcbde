"""A training-text pipeline over the documents table.

Stages take tables with the columns of ``documents`` and give those; further columns are not read and not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.bottomk import near_duplicates
from sluice.llm.common import bound_batches, far_rows, near_rows, read_table, stage, text_code
from sluice.llm.decontam import contaminated
from sluice.llm.langid import held_out, identify
from sluice.llm.linefreq import drop_boilerplate
from sluice.llm.piece_lattice import encode_pieces
from sluice.llm.queries import public_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "__document"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those that the models reject go. Learned from the rows that are not held out.

    Null texts and texts without a letter have no language and go; rows of one id are judged each by its own text, rows without an id too.
    """
    rejected = identify(_keyed(docs), ~held_out(), id_col=KEY).where("rejected").select(F.col("doc_id").alias(KEY)).distinct()
    return _without(docs, rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    No row goes, and a page of nothing but such lines stays whole, for near_dedup to compare. Null texts stay null and empty ones empty; a null source is a site of its own; repeated rows are pages each.
    """
    bound_batches(spark)
    return drop_boilerplate(docs, spare_copies=True).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (five-word shingles, similarity 0.8): that of the smallest id, of its texts one.

    Null and wordless texts are like nothing and stay. Rows of one id with different texts are documents of their own; of a repeated row (id and
    text) one stays. A row without an id goes if its class has a row with one, else it stays.
    """
    found = near_duplicates(docs).where("n_shingles > 0 AND component_id IS NOT NULL")
    found = stage(found.select("kept", "group", "text_code", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_code").alias(KEY)), "decided")
    # an id may stand in one class with several texts
    several = found.where("kept").groupBy("group").agg(F.min("text_code").alias("least"), F.max("text_code").alias("most")).where("least < most")
    later = found.where("kept").join(stage(several, "several"), "group").where("text_code > least").select(KEY)
    return _once(_without(docs, found.where("NOT kept").select(KEY).union(later).distinct()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, row by row; null and empty texts hold none."""
    hits = contaminated(_keyed(docs), read_table(spark, sf_dir, "benchmark"), id_col=KEY)
    return _without(docs, hits.select(F.col("doc_id").alias(KEY)).distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and its four best segmentations with their scores; a null text has no pieces, and every row stays."""
    return encode_pieces(docs, public_tokenizer("piece_bpe_32k.model"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of id and text, as rows of one id may hold different texts."""
    return docs.select(*COLUMNS, F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_code("text"), F.when(F.col("text").isNull(), "null")).alias(KEY))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is not listed. The keys are written first; most documents are cleared in the scan and only the others joined."""
    docs, keys = _keyed(docs), stage(keys, "dropped")
    near = near_rows(docs, KEY, keys, KEY).join(keys, KEY, "left_anti")
    return far_rows(docs, KEY, keys, KEY).select(COLUMNS).unionByName(near.select(COLUMNS))


def _once(docs: DataFrame) -> DataFrame:
    """Of rows with one id and one text the first by its other columns; rows without an id or a word are left as they are."""
    keyed = _keyed(docs.where(F.col("doc_id").isNotNull()))
    twice = stage(keyed.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY), "repeated")
    near = near_rows(_keyed(docs), KEY, twice, KEY)
    of_one = near.join(twice, KEY, "left_semi").groupBy(KEY).agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("r"), F.first("text").alias("text"))
    return far_rows(_keyed(docs), KEY, twice, KEY).select(COLUMNS).unionByName(near.join(twice, KEY, "left_anti").select(COLUMNS)).unionByName(
        of_one.select("r.doc_id", "text", "r.lang", "r.source", "r.n_chars"))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontaminate", decontaminate), ("encode", encode),
]
# language models, similarity classes and piece lattices are beyond SQL: the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written and reread before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

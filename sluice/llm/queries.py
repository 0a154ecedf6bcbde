"""The registered queries of the text operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import filter_audit, licences, linefreq, vafile
from .bottomk import near_duplicates
from .common import read_table
from .decontam import contaminated
from .disclosure import find_personal
from .filter_audit import audit_filters
from .langid import held_out, identify
from .licences import licence_scan
from .linefreq import drop_boilerplate
from .linkrank import url_verdicts
from .outliers import quality_outliers
from .piece_lattice import encode_pieces
from .repair import token_blocks
from .slots import shard_by_slots
from .vafile import cluster


def public_tokenizer(name: str) -> str:
    """Path of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written as grammar-compressed blocks in id order and read back."""
    return token_blocks(read_table(spark, folder, "documents"), public_tokenizer("byte_bpe_50k.json"), 2)


def op2_pigeonhole_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a run of words within the edit budget of a benchmark item."""
    return contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op3_piece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    """The four best segmentations of every document over the piece lattice: score, number of pieces and crc of each."""
    docs = read_table(spark, folder, "documents")
    return encode_pieces(docs, public_tokenizer("piece_bpe_32k.model"), with_ids=False)


def op4_bottomk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    return near_duplicates(read_table(spark, folder, "documents"), num=85)


def op5_kneser_ney_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    out = identify(read_table(spark, folder, "documents"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "cross_entropy", "rejected")


def op6_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of near equal bytes by virtual slots; the map's first version."""
    rows, _ = shard_by_slots(read_table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


# (verdict, host and path)
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op7_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page: by rule, else by trust and distrust of its host."""
    return url_verdicts(read_table(spark, folder, "pages"), URL_RULES)


def op8_mcd_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics of every document, and whether the rules and the robust distance keep it."""
    return quality_outliers(read_table(spark, folder, "documents"))


def op9_site_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that are on over 1.5 % of the pages of their source."""
    return drop_boilerplate(read_table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_licence_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of whole documents and of their lines."""
    return licence_scan(read_table(spark, folder, "documents"))


def op11_va_file_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster and exact distance of every embedding after three rounds."""
    return cluster(read_table(spark, folder, "embeddings"))


def op12_disclosure_control(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document, and the terms that give it away."""
    return find_personal(read_table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from each source in each of their 120 orders."""
    return audit_filters(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


QUERIES = {fn.__name__: fn for fn in (
    op1_repair_tokens, op2_pigeonhole_decontam, op3_piece_nbest, op4_bottomk_dedup, op5_kneser_ney_langid,
    op6_virtual_slots, op7_link_trust, op8_mcd_outliers, op9_site_boilerplate, op10_licence_digests,
    op11_va_file_clusters, op12_disclosure_control, op13_filter_audit,
)}
ORACLES: dict[str, str] = {"op9_site_boilerplate": linefreq.ORACLE, "op10_licence_digests": licences.oracle(), "op11_va_file_clusters": vafile.oracle(),
                           "op13_filter_audit": filter_audit.ORACLE}

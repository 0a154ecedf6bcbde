"""Near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, near_rows, stage, text_batches, text_code
from .components import components

_MASK = (1 << 64) - 1
# odd multipliers of the word positions in a shingle, and the mixing constants of a 64-bit finaliser
_STEP = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
# lists up to this length are paired by a join (rows in proportion to members); longer ones are compared in blocks of members
SHORT_LIST, BLOCK = 32, 1024


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _MIX1
    values = (values ^ (values >> _SHIFT)) * _MIX2
    return values ^ (values >> _SHIFT)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    A-Z become lower case; words are runs of bytes other than space and \\t to \\r. A text with fewer words is one shingle, a text
    without words (or null) has none.
    """
    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, (size * _STEP) & _MASK, dtype=np.uint64)
    for i in range(size):
        total += codes[i:len(words) - size + 1 + i] * np.uint64((pow(_STEP, i + 1, 1 << 64)) | 1)
    return np.unique(_mixed(total))


def least_shared(k: int, num: int, den: int, miss: float = 1e-9) -> int:
    """Shared values among the k smallest of a union that a pair at the similarity bound falls short of with chance ``miss`` at most."""
    below, p = 0.0, num / den
    for t in range(k + 1):
        below += comb(k, t) * p ** t * (1 - p) ** (k - t)
        if below > miss:
            return max(1, t)
    return max(1, k)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(doc, code, n, digest, sketch) per row: hash of the text, set size, 128-bit digest of the whole set, its k smallest hashes."""
    schema = pa.schema([("doc", pa.int64()), ("code", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 2):
            sizes, digests, kept = [], [], []
            for text in texts:
                values = shingle_set(text, width)
                sizes.append(len(values))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                kept.append(values[:k].view(np.int64))
            ends = np.zeros(len(kept) + 1, dtype=np.int32)
            np.cumsum([len(v) for v in kept], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("long"), text_code(text_col), F.col(text_col).cast("string")), run,
                     "doc long, code long, n long, digest binary, sketch array<long>")


def _matrix(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of k values, short ones filled with a value of their own kind, and their lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lengths), k), np.uint64(_MASK), dtype=np.uint64)
    out[np.arange(k)[None, :] < lengths[:, None]] = flat
    return out, lengths


def estimate_filter(k: int, num: int, den: int):
    """Task function: keeps the pairs (a, b) whose union sketch lets them reach the bound.

    The k smallest of the union of two bottom-k sketches are the bottom-k sketch of the united sets; the share of them found in both
    estimates the similarity, and is exact when the union has no more than k values.
    """
    least = least_shared(k, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                if part.num_rows == 0:
                    continue
                left, n_left = _matrix(part.column(2), k)
                right, n_right = _matrix(part.column(3), k)
                both = np.sort(np.concatenate([left, right], axis=1), axis=1)
                same = np.zeros(both.shape, dtype=bool)
                same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.uint64(_MASK))
                rank = np.cumsum(~same, axis=1)
                shared = (same & (rank <= k)).sum(axis=1)
                union = n_left + n_right - same.sum(axis=1)
                whole = (n_left < k) & (n_right < k) & (union <= k)
                keep = np.where(whole, den * shared >= num * union, shared >= np.minimum(least, -(-num * np.minimum(union, k) // den)))
                yield part.select([0, 1]).filter(pa.array(keep))

    return run


def exact_filter(width: int, num: int, den: int):
    """Task function: keeps the pairs (a, b) whose full shingle sets reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            for part, texts in text_batches(iter([batch]), 2):
                keep = []
                for one, two in zip(texts, part.column(3).cast(pa.binary()).to_pylist()):
                    if one is not last:
                        last, known = one, shingle_set(one, width)
                    other = shingle_set(two, width)
                    shared = len(np.intersect1d(known, other, assume_unique=True))
                    keep.append(den * shared >= num * (len(known) + len(other) - shared))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, k: int = 64,
) -> DataFrame:
    """Classes of documents whose word-shingle sets have ``den * |A and B| >= num * |A or B|``, closed over links.

    Returns one row per input row: (doc_id, n_shingles, component_id, kept, text_code, group). ``text_code`` is the hash that tells texts of
    one id apart, ``group`` a number of the row's class of links, null without words. Other columns, whatever their names, are not read.

    Method: one hash function; each set keeps its k smallest hashes. Equal sets become one class first, so copies never multiply.
    Inverted lists of the retained values generate pairs of classes: values are ranked from rare to frequent and only as many of
    a sketch's rarest are listed as a linked pair needs to meet in one (prefix rule); a list ties its members to its smallest
    member, and only members left in different components are paired across. Union-sketch estimation filters with a
    bound that a linked pair misses with a chance of 1e-9; texts of the survivors are compared in full.

    Null or wordless texts: n_shingles 0, component of their own. Rows with a null id are a class member but never its
    name; without any other member component_id is null and kept false. Repeated rows of one id and text share their class and are all kept
    or all dropped. Rows of one id with different texts are documents of their own: each is in the class of its text, and classes
    that are not linked may have the same smallest id (``group`` differs). An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = stage(sketches(docs, id_col, text_col, width, k), "sketches")
    # a class has a number of its own, as its smallest id may also be that of another text
    classes = stage(base.where("digest IS NOT NULL AND doc IS NOT NULL").groupBy("digest").agg(
        F.min("doc").alias("doc"), F.min_by("code", "doc").alias("code"), F.min_by("n", "doc").alias("n"), F.min_by("sketch", "doc").alias("sketch"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")
    lists = stage(_prefix_lists(classes, k, num, den), "lists")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs of classes that pass the estimate and then the full comparison."""
        involved = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sized = near_rows(classes, "rep", involved, "rep").select("rep", "n", "sketch")
        pairs = (pairs.join(sized.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
                 .join(sized.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
                 .where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"))
        likely = stage(arrow_map(pairs.select("a", "b", "s_a", "s_b"), estimate_filter(k, num, den), "a long, b long"), "likely")
        named = likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        texts = stage(_texts_of(docs, id_col, text_col, _named(classes, named)), "texts")
        full = (likely.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("t_a")), "a")
                .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("t_b")), "b"))
        return arrow_map(full.select("a", "b", "t_a", "t_b"), exact_filter(width, num, den), "a long, b long")

    centres = lists.groupBy("value").agg(F.min("rep").alias("a"))
    first = stage(lists.join(centres, "value").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = stage(linked(first), "links")
    labels = stage(components(links), "labels")

    # members of a list that ended in different components: pairs without the list's centre have not been compared yet
    tagged = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = tagged.groupBy("value").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rep").alias("centre"), F.count("*").alias("members")).where("lo < hi")
    open_lists = stage(tagged.join(mixed.select("value", "centre", "members"), "value"), "open")
    short = open_lists.where(F.col("members") <= SHORT_LIST).where("rep <> centre")
    left = short.select("value", F.col("rep").alias("a"), F.col("label").alias("l_a"), F.col("n").alias("n_a"))
    right = short.select("value", F.col("rep").alias("b"), F.col("label").alias("l_b"), F.col("n").alias("n_b"))
    rest = left.join(right, "value").where(
        f"a < b AND l_a <> l_b AND {den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").select("a", "b").distinct()
    long_links = _compare_blocks(docs, id_col, text_col, classes, open_lists.where(F.col("members") > SHORT_LIST), width, num, den)
    rest = stage(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    more = stage(linked(rest).union(long_links), "links")
    if not more.isEmpty():
        labels = stage(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "labels")

    # min_by of one id's several texts in a class may differ from run to run, and so may which of them stands for the class; links do not
    linked_classes = classes.select("digest", "doc", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "group", F.coalesce("label", "rep"))
    linked_classes = stage(linked_classes.select("digest", "doc", "group"), "grouped")
    smallest = linked_classes.groupBy("group").agg(F.min("doc").alias("component"))
    out = base.select("doc", "code", "n", "digest").join(linked_classes.join(smallest, "group").select("digest", "group", "component"), "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"), F.col("code").alias("text_code"), "group")


def _named(classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, doc, code): the document whose text stands for each of the given classes."""
    return stage(near_rows(classes.select("rep", "doc", "code"), "rep", reps, "rep").join(reps, "rep"), "named")


def _texts_of(docs: DataFrame, id_col: str, text_col: str, named: DataFrame) -> DataFrame:
    """(rep, text) of the named documents."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = near_rows(texts, "doc", named, "doc").withColumn("code", text_code("text"))
    return found.join(named, ["doc", "code"]).groupBy("rep").agg(F.min("text").alias("text"))


def _compare_blocks(
    docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, members: DataFrame, width: int, num: int, den: int,
) -> DataFrame:
    """(a, b): links inside long lists, by full sets, without a row per pair.

    A list is dealt into blocks of about ``BLOCK`` members, and each pair of blocks is one bounded task that counts all
    its intersections by matrix products. Of what is linked a task returns the ties of each member to the smallest it reaches.
    """
    texts = _texts_of(docs, id_col, text_col, _named(classes, members.select("rep").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in text_batches(batches, 1):
            values = pa.array([shingle_set(t, width).view(np.int64) for t in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], names=["rep", "set"])

    full = stage(arrow_map(texts, sets, "rep long, set array<long>"), "sets")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "label")

    def run(table: pa.Table) -> pa.Table:
        reps, labels = table.column("rep").to_numpy(), table.column("label").to_numpy()
        lists = table.column("set").combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(reps)), sizes)
        _, ids, counts = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        kept = counts[ids] > 1
        rows, ids = rows[kept], (np.cumsum(counts > 1) - 1)[ids[kept]]
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        shared = np.zeros((len(reps), len(reps)), dtype=np.float32)
        for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
            lo, hi = np.searchsorted(ids, [start, start + 2048])
            part = np.zeros((len(reps), 2048), dtype=np.float32)
            part[rows[lo:hi], ids[lo:hi] - start] = 1
            shared += part @ part.T
        linked = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
        linked |= labels[:, None] == labels[None, :]
        root = labels.copy()
        while True:
            least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (least == root).all():
                break
            root = least
        moved = root < labels
        return pa.table({"a": pa.array(root[moved], pa.int64()), "b": pa.array(labels[moved], pa.int64())})

    return dealt.join(full, "rep").groupBy("value", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _prefix_lists(classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(value, rep, n): the retained values under which a class is listed.

    Values held by one class only cannot meet another; they come first in the order from rare to frequent, so what is
    listed are the ``shared - need + 1`` rarest shared values, where ``need`` is the least overlap of sketches that a link leaves.
    """
    least = least_shared(k, num, den)
    entries = classes.select("rep", F.explode("sketch").alias("value"))
    counts = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(counts, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("found"))
    shared = shared.join(classes.select("rep", "n", F.size("sketch").alias("size")), "rep")
    need = F.least(F.lit(least), F.ceil(F.col("size") * num / den)).cast("int")
    return (shared.withColumn("take", F.size("found") - need + 1).where("take > 0")
            .select("rep", "n", F.explode(F.slice("found", F.lit(1), F.col("take"))).alias("e"))
            .select("e.value", "rep", "n"))

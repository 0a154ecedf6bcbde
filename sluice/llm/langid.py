"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, crc32_of_id, offsets, stage, text_batches

# word boundary in a character sequence, and the start value of its rolling hash
EDGE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
# distinct grams a counting task holds before it passes them on, distinct words a scoring task remembers, and words scored at once
TASK_GRAMS, TASK_WORDS, STEP_WORDS = 300_000, 200_000, 30_000
# margins are calibrated in so many bins
BINS, BIN_WIDTH = 40, 50
# least standard deviation (nats per character) that a text's distance from its language is measured by
LEAST_SD = 0.25
# rightly predicted training rows that a size, or else a language, has at least to be a norm of its own
NORM_ROWS = 30


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word between two edges, concatenated, and the start of each word."""
    joined = b" ".join(words).decode("utf-8", "replace")
    points = np.frombuffer((" " + joined + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    cuts = np.flatnonzero(points == EDGE)
    return points, cuts


def gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` code points that end at each position (positions before ``size - 1`` are left out)."""
    total = np.full(max(0, len(points) - size + 1), size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ (total >> np.uint64(31))) * _STEP + points[i:len(points) - size + 1 + i]
    return total ^ (total >> np.uint64(32))


def gram_counts(docs: DataFrame, lang_col: str, text_col: str, order: int) -> DataFrame:
    """(lang, gram, n) over all rows: runs of ``order`` characters inside edged words, and shorter ones that begin a word.

    Tasks count words first and expand each distinct word once; what they hold is bounded and partial counts are added by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, grams in held.items():
                if grams:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())],
                        names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part, texts in text_batches(iter([batch]), 1):
                words: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), texts):
                    if text:
                        words.setdefault(lang, Counter()).update(text.decode().lower().split())
                for lang, found in words.items():
                    grams = held.setdefault(lang, Counter())
                    for word, n in found.items():
                        edged = f" {word} "
                        for size in range(2, min(order, len(edged) + 1)):
                            grams[edged[:size]] += n
                        for i in range(len(edged) - order + 1):
                            grams[edged[i:i + order]] += n
                if sum(map(len, held.values())) > TASK_GRAMS:
                    yield from flush()
        yield from flush()

    return arrow_map(docs.select(lang_col, text_col), run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _levels(grams: DataFrame, langs: list[str], order: int) -> dict[int, DataFrame]:
    """(gram, c) for each order: counts per language. Below the highest order a gram counts the grams it ends, and its starts of words."""
    sums = lambda values: F.array(*[F.sum(v).cast("double") for v in values]).alias("c")
    full = stage(grams.groupBy("gram").agg(sums([F.when(F.col("lang") == x, F.col("n")).otherwise(0) for x in langs])), "grams")
    levels = {order: full.where(F.length("gram") == order)}
    for size in range(order - 1, 0, -1):
        above = levels[size + 1].select(
            F.expr("substring(gram, 2)").alias("gram"), F.transform("c", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("c"))
        both = above.unionByName(full.where(F.length("gram") == size))
        levels[size] = stage(both.groupBy("gram").agg(sums([F.col("c")[j] for j in range(len(langs))])), "level")
    return levels


def _hashed(table: DataFrame) -> DataFrame:
    """The table with the hash of each gram instead of the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_hashes(np.frombuffer(g.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), len(g))[0] for g in batch.column(1).to_pylist()]
            hashes = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes), batch.column(2), batch.column(3)], names=["size", "hash", "logs", "backs"])

    return arrow_map(table.select("size", "gram", "logs", "backs"), run, "size int, hash long, logs array<double>, backs array<double>")


def _packed(table: DataFrame) -> DataFrame:
    """(size, hashes, logs, backs) as sorted arrays, one row per order and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        sizes, hashes, logs, backs = (np.concatenate(c) for c in zip(*held))
        logs, backs = logs.reshape(len(sizes), -1), backs.reshape(len(sizes), -1)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(hashes[at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), *(pa.array([v[at].tobytes()], pa.binary()) for v in (hashes, logs, backs))],
                names=["size", "hashes", "logs", "backs"])

    return arrow_map(table, run, "size int, hashes binary, logs binary, backs binary")


def fit(grams: DataFrame, order: int, step_grams: int) -> dict | None:
    """The models of all languages as sorted hash arrays; None without any training text.

    For each order the arrays are the sorted hashes of the grams of all languages, the interpolated log probability of the gram's last
    character in each language, and each language's log weight of backing off from the gram. No gram is left out: counts, discounts,
    probabilities and weights are Spark aggregations and joins. The table is broadcast in ranges of hashes, whose number grows with the
    grams; the driver and a task hold about ``step_grams`` grams of it at once.
    """
    spark = grams.sparkSession
    langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    seats = range(len(langs))
    levels = _levels(grams, langs, order)
    facts = reduce(DataFrame.unionByName, [levels[k].select(F.lit(k).alias("size"), "c") for k in levels]).groupBy("size").agg(
        F.count("*").alias("grams"), *[F.array(*[F.sum(f(F.col("c")[j])) for j in seats]).alias(name) for name, f in (
            ("ones", lambda c: (c == 1).cast("long")), ("twos", lambda c: (c == 2).cast("long")),
            ("types", lambda c: (c > 0).cast("long")), ("total", lambda c: c))])
    facts = {r["size"]: r for r in facts.collect()}
    discounts = {k: [min(0.95, max(0.1, a / (a + 2 * b))) if a else 0.5 for a, b in zip(r["ones"], r["twos"])] for k, r in facts.items()}
    weight = [min(d * n / t, 1.0) if t else 1.0 for d, n, t in zip(discounts[1], facts[1]["types"], facts[1]["total"])]
    floor = [w / (facts[1]["grams"] + 1) for w in weight]
    least = lambda p: F.greatest(p, F.lit(1e-12))
    own = lambda k, j, total: F.greatest(F.col("c")[j] - discounts[k][j], F.lit(0.0)) / total
    sizes = sorted(facts)
    # context of a gram of each order: what its language has seen after it, and the weight of backing off from it
    contexts = {k: levels[k].groupBy(F.expr(f"substring(gram, 1, {k - 1})").alias("context")).agg(
        *[F.sum(F.col("c")[j]).alias(f"t{j}") for j in seats], *[F.sum((F.col("c")[j] > 0).cast("long")).alias(f"n{j}") for j in seats]).select(
        "context", F.array(*[F.col(f"t{j}") for j in seats]).alias("t"),
        F.array(*[F.when(F.col(f"t{j}") > 0, F.least(discounts[k][j] * F.col(f"n{j}") / F.col(f"t{j}"), F.lit(1.0))).otherwise(1.0) for j in seats]).alias("w"))
        for k in sizes[1:]}
    probs = {1: stage(levels[1].select("gram", F.array(*[
        least((own(1, j, facts[1]["total"][j]) if facts[1]["total"][j] else F.lit(0.0)) + floor[j]) for j in seats]).alias("p")), "probabilities")}
    for k in sizes[1:]:
        contexts[k] = stage(contexts[k], "contexts")
        whole = levels[k].withColumns({"context": F.expr(f"substring(gram, 1, {k - 1})"), "low": F.expr("substring(gram, 2)")})
        whole = whole.join(contexts[k], "context").join(probs[k - 1].select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
        probs[k] = stage(whole.select("gram", F.array(*[least(
            F.when(F.col("t")[j] > 0, own(k, j, F.col("t")[j])).otherwise(0.0) + F.col("w")[j] * F.col("q")[j]) for j in seats]).alias("p")), "probabilities")
    nothing = F.array(*[F.lit(0.0)] * len(langs))
    parts = []
    for k in sizes:
        logs = F.transform("p", lambda x: F.log(x)).alias("logs")
        if k + 1 in contexts:
            back = contexts[k + 1].select(F.col("context").alias("gram"), F.transform("w", lambda x: F.log(x)).alias("back"))
            parts.append(probs[k].join(back, "gram", "left").select(F.lit(k).alias("size"), "gram", logs, F.coalesce("back", nothing).alias("backs")))
        else:
            parts.append(probs[k].select(F.lit(k).alias("size"), "gram", logs, nothing.alias("backs")))
    table = stage(_hashed(reduce(DataFrame.unionByName, parts)), "hashes")
    tasks = -(-sum(r["grams"] for r in facts.values()) // step_grams)
    ranges: dict[int, list] = {k: [] for k in range(1, order + 1)}
    held: list[tuple] = []

    def send() -> None:
        if held:
            hashes, logs, backs = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            ranges[held[0][0]].append((int(hashes[0]), int(hashes[-1]), spark.sparkContext.broadcast((hashes, logs, backs))))
            held.clear()

    # partitions arrive one after the other, in the order of their hashes
    for size, hashes, logs, backs in _packed(table.repartitionByRange(tasks, "size", "hash")).toLocalIterator():
        hashes = np.frombuffer(hashes, dtype=np.int64)
        if held and (held[0][0] != size or sum(len(h[1]) for h in held) + len(hashes) > step_grams):
            send()
        held.append((size, hashes, *(np.frombuffer(v).reshape(len(hashes), -1) for v in (logs, backs))))
    send()
    return {"langs": langs, "order": order, "floor": np.log(floor), "ranges": ranges}


def _looked_up(model: dict, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, log probabilities, back-off weights) of each hash; zeros where it is unknown. One range of the table is in memory at a time."""
    wanted, place = np.unique(keys.view(np.int64), return_inverse=True)
    known = np.zeros(len(wanted), dtype=bool)
    logs, backs = (np.zeros((len(wanted), len(model["langs"]))) for _ in range(2))
    for first, last, part in model["ranges"][size]:
        lo, hi = np.searchsorted(wanted, first), np.searchsorted(wanted, last, side="right")
        if lo == hi:
            continue
        hashes, own, back = part.value
        part.__dict__.pop("_value", None)  # the value stays in its file
        slot = np.minimum(np.searchsorted(hashes, wanted[lo:hi]), len(hashes) - 1)
        hit = np.flatnonzero(hashes[slot] == wanted[lo:hi])
        known[lo + hit], logs[lo + hit], backs[lo + hit] = True, own[slot[hit]], back[slot[hit]]
    return known[place], logs[place], backs[place]


def word_scores(model: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each edged word in every language, and the number of characters it is over.

    The longest known gram gives the probability; each longer context that is known but not so continued adds its back-off weight.
    """
    points, cuts = _codes(words)
    langs = len(model["langs"])
    total = np.repeat(model["floor"][None, :], len(points), axis=0)
    seat = np.cumsum(points == EDGE)  # which word a position belongs to; an edge opens its word
    at = np.arange(len(points))
    before = None
    for size in range(1, model["order"] + 1):
        hit, logs, weights = np.zeros(len(points), dtype=bool), np.zeros_like(total), np.zeros_like(total)
        if len(points) >= size:
            hit[size - 1:], logs[size - 1:], weights[size - 1:] = _looked_up(model, size, gram_hashes(points, size))
        if size > 1:
            # a gram may end on the edge that closes its word, never reach across it
            inside = at - (size - 1) >= cuts[np.maximum(seat - 1 - (points == EDGE), 0)]
            hit &= inside
            miss = np.flatnonzero(~hit & inside & (at > 0))
            total[miss] += before[miss - 1]
        total[hit] = logs[hit]
        weights[~hit] = 0.0
        if size > 1:
            # as a context a gram that ends on an edge closes a word and has no continuation
            weights[points == EDGE] = 0.0
        before = weights
    total[0] = 0.0
    sums = np.concatenate([np.zeros((1, langs)), np.cumsum(total, axis=0)])
    return sums[cuts[1:] + 1] - sums[cuts[:-1] + 1], np.diff(cuts)


def cross_entropies(docs: DataFrame, text_col: str, keep: list[str], model: dict) -> DataFrame:
    """``keep`` columns, n_chars scored, has_letter, and ``ce``: nats per character in each language, over the whole text."""
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = len(model["langs"])
        known: dict[str, int] = {}
        scores, sizes = np.zeros((0, langs)), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part, texts in text_batches(iter([batch]), batch.num_columns - 1):
                if len(known) > TASK_WORDS:
                    known, scores, sizes = {}, np.zeros((0, langs)), np.zeros(0, dtype=np.int64)
                fresh: list[str] = []
                rows, counts, letters = [], [], []
                for text in texts:
                    text = text.decode() if text else ""
                    words = text.lower().split()
                    letters.append(any(map(str.isalpha, text)))
                    counts.append(len(words))
                    for word in set(words).difference(known):
                        known[word] = len(known)
                        fresh.append(word)
                    rows.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
                for lo in range(0, len(fresh), STEP_WORDS):
                    more, lengths = word_scores(model, [w.encode() for w in fresh[lo:lo + STEP_WORDS]])
                    scores, sizes = np.concatenate([scores, more]), np.concatenate([sizes, lengths])
                ids, ends = np.concatenate(rows), offsets(np.array(counts))
                sums = np.concatenate([np.zeros((1, langs)), np.cumsum(scores[ids], axis=0)])
                total = sums[ends[1:]] - sums[ends[:-1]]
                chars = np.concatenate([[0], np.cumsum(sizes[ids])])
                n = chars[ends[1:]] - chars[ends[:-1]]
                ce = -total / np.maximum(n, 1)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * langs), pa.array(ce.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(part.num_columns - 1)), pa.array(n, pa.int64()), pa.array(letters, pa.bool_()), lists],
                    names=[*keep, "chars", "letter", "ce"])

    return arrow_map(docs.select(*keep, text_col), run, f"{types}, chars long, letter boolean, ce array<double>")


def identify(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = 4, step_grams: int = 200_000, reject_below: float = 0.35, far: float = 12.0,
) -> DataFrame:
    """(doc_id, lang_pred, score, margin, cross_entropy, rejected) per row of ``docs``.

    One interpolated Kneser-Ney model of ``order`` characters per language is learned from the rows where ``training`` holds and the
    language is not null. The prediction is the language of the lowest cross-entropy per character over the whole text, ties going
    to the first name; it reads the text alone. ``score`` (0 to 1) is calibrated on the training rows: the share of right
    answers among rows of a like margin (cross-entropy of the second best minus the best), made monotone, and lowered for a
    text whose cross-entropy lies ``far`` standard deviations above those of its language and length. A length (power of two) with under
    ``NORM_ROWS`` rightly predicted training rows is measured by its whole language, a language with fewer by all of them. Rows under
    ``reject_below`` are rejected, and so are null texts and texts without a letter, whose lang_pred is und and score 0.

    Without training rows every row is und. Repeated rows each get their prediction; an empty table gives no rows.
    """
    spark = docs.sparkSession
    usable = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    grams = stage(gram_counts(usable, lang_col, text_col, order), "grams")
    model = fit(grams, order, step_grams)
    if model is None:
        return docs.select(
            F.col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    narrow = docs.select(F.col(id_col).alias("id"), F.when(training, F.col(lang_col)).alias("known"), F.col(text_col).alias("text"))
    scored = stage(cross_entropies(narrow, "text", ["id", "known"], model), "entropies")
    langs = F.array(*[F.lit(x) for x in model["langs"]])
    best = F.array_min("ce")
    second = F.element_at(F.array_sort("ce"), 2) if len(model["langs"]) > 1 else best + 1.0
    scored = scored.select(
        "id", "known", "letter", F.element_at(langs, F.array_position("ce", best).cast("int")).alias("pred"),
        best.alias("best"), (second - best).alias("margin"), F.floor(F.log2(F.col("chars") + 1)).alias("size"))
    learned = scored.where("known IS NOT NULL AND letter")
    bins = F.least(F.floor(F.col("margin") * BIN_WIDTH), F.lit(BINS - 1)).cast("int")
    right = {r[0]: (r[1], r[2]) for r in learned.groupBy(bins).agg(F.sum((F.col("known") == F.col("pred")).cast("long")), F.count("*")).collect()}
    shares, at_least = [], 0.0
    for i in range(BINS):
        good, n = right.get(i, (0, 0))
        # a bin starts from two rows' worth of the posterior that the margin gives a text of fifty characters
        prior = 1 / (1 + (len(model["langs"]) - 1) * exp(-i / BIN_WIDTH * 50))
        at_least = max(at_least, (good + 2 * prior) / (n + 2))
        shares.append(at_least)
    right_ones = learned.where("known = pred")
    norm = lambda name: [F.count("best").alias(f"{name}_n"), F.avg("best").alias(f"{name}_mean"), F.stddev_pop("best").alias(f"{name}_sd")]
    out = scored.join(F.broadcast(right_ones.groupBy("pred", "size").agg(*norm("size"))), ["pred", "size"], "left")  # a row per language and power of two
    out = out.join(F.broadcast(right_ones.groupBy("pred").agg(*norm("lang"))), "pred", "left")
    every = right_ones.agg(*norm("every")).first()
    pick = lambda what: (F.when(F.col("size_n") >= NORM_ROWS, F.col(f"size_{what}"))
                         .when(F.col("lang_n") >= NORM_ROWS, F.col(f"lang_{what}")).otherwise(F.lit(every[f"every_{what}"]).cast("double")))
    z = (F.col("best") - pick("mean")) / F.greatest(pick("sd"), F.lit(LEAST_SD))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), bins + 1)
    score = share * F.coalesce(F.when(z > far, F.exp(far - z)), F.lit(1.0))
    out = out.withColumn("score", F.when(F.col("letter"), score).otherwise(0.0))
    return out.select(
        F.col("id").alias("doc_id"), F.when(F.col("letter"), F.col("pred")).otherwise("und").alias("lang_pred"), "score",
        F.when(F.col("letter"), F.col("margin")).otherwise(0.0).alias("margin"), F.when(F.col("letter"), F.col("best")).alias("cross_entropy"),
        (~F.col("letter") | (F.col("score") < reject_below)).alias("rejected"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.pmod(crc32_of_id(id_col), F.lit(4)) == 2, F.lit(False))

"""Benchmark passages in documents, within an edit budget, by intact pieces."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, offsets, text_batches

_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def distance_within(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to any run of the text, end of the first such run).

    Bit-parallel columns (Myers, 1999) over words, in the form that lets a run start anywhere.
    """
    size = len(pattern)
    mask, high = (1 << size) - 1, 1 << (size - 1)
    places: dict[int, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        places[word] |= 1 << i
    up, down, score, best, end = mask, 0, size, size, 0
    for j, word in enumerate(text):
        equal = places.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus, minus = (down | ~(horizontal | up)) & mask, up & horizontal
        score += bool(plus & high) - bool(minus & high)
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = (minus | ~(vertical | plus)) & mask, plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class PieceIndex:
    """Items of a test set cut into one piece more than their error budget.

    A run of a document within the budget of an item leaves one piece intact at least, at most a budget away from its place.
    """

    def __init__(self, items: list[tuple[str, str | None]], num: int, den: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[str, list[int], int]] = []
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not words:
                continue
            budget = len(words) * num // den
            cuts = [i * len(words) // (budget + 1) for i in range(budget + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                key = int(self.hashed(np.array(words[lo:hi], dtype=np.uint64), hi - lo)[0])
                pieces[hi - lo][key].append((len(self.items), lo))
            self.items.append((name, words, budget))
        self.pieces = {size: (np.array(sorted(found), dtype=np.uint64), dict(found)) for size, found in pieces.items()}

    @classmethod
    def of(cls, state: dict) -> PieceIndex:
        """The index from its attributes, as they are broadcast."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    @staticmethod
    def hashed(words: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words."""
        total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for i in range(size):
            total = (total ^ (total >> np.uint64(29))) * _STEP + words[i:len(words) - size + 1 + i]
        return total

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, word where the item would start, word of the piece) for each intact piece; 0 stands for words of no item and parts texts."""
        known = np.concatenate([[0], np.cumsum(words == 0)])
        for size, (keys, places) in self.pieces.items():
            if len(words) < size:
                continue
            at = np.flatnonzero(known[size:] == known[:-size])
            if not len(at):
                continue
            total = np.zeros(len(at), dtype=np.uint64)
            for i in range(size):
                total = (total ^ (total >> np.uint64(29))) * _STEP + words[at + i]
            slot = np.minimum(np.searchsorted(keys, total), len(keys) - 1)
            for i in np.flatnonzero(keys[slot] == total):
                for item, lo in places[int(total[i])]:
                    if self.items[item][1][lo:lo + size] == words[at[i]:at[i] + size].tolist():
                        yield item, int(at[i]) - lo, int(at[i])

    def matches(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, str, int, int, int, int]]:
        """(text number, item, distance, budget, words of the item, end word) of each text and item that match."""
        by_item: dict[tuple[int, int], set[int]] = defaultdict(set)
        for item, start, at in self.candidates(words):
            by_item[int(np.searchsorted(starts, at, "right")) - 1, item].add(start)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (text, item), begins in by_item.items():
            _, pattern, budget = self.items[item]
            lo = hi = None
            for start in [*sorted(begins), None]:
                if lo is not None and (start is None or start - budget > hi):
                    left, right = max(lo, int(starts[text])), min(hi, int(starts[text + 1]))
                    found, end = distance_within(pattern, words[left:right].tolist())
                    old = best.get((text, item))
                    if found <= budget and (old is None or found < old[0]):
                        best[text, item] = found, left + end - int(starts[text])
                    lo = None
                if start is not None:
                    lo = start - budget if lo is None else lo
                    hi = start + len(pattern) + budget
        return [(text, self.items[item][0], d, self.items[item][2], len(self.items[item][1]), end)
                for (text, item), (d, end) in sorted(best.items())]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", error_rate: tuple[int, int] = (1, 5), block_items: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, distance, budget, item_words, end_word): documents with a run of words near a test item.

    Words are lower-case runs of letters and digits; an item of w words has a budget of ``w * error_rate`` word edits, rounded down.
    One row per document row and matching item: its least distance and where the first such run ends. Every run within the
    budget is found: an item is cut into budget + 1 pieces, one of which such a run leaves intact.

    The test set is taken in blocks of ``block_items`` rows; a block's index is what executors hold, and each block is a scan of the
    documents without a shuffle. Null or wordless texts and items match nothing. Repeated rows and repeated items each give
    their rows. Items without a budget (under five words) match exactly. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = "id string, item string, distance int, budget int, item_words int, end_word int"
    out = None
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(item_text).cast("string")).toLocalIterator()
    while True:
        block = [(r[0], r[1]) for r in islice(rows, block_items)]
        if not block and out is not None:
            break
        index = spark.sparkContext.broadcast(vars(PieceIndex(block, *error_rate)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            pieces = PieceIndex.of(index.value)
            get = pieces.vocabulary.get
            for part, texts in text_batches(batches, 1):
                found = [words_of(t.decode()) if t else () for t in texts]
                starts = offsets(np.array([len(f) + 1 for f in found]))
                ids = np.fromiter(chain.from_iterable(chain(map(get, f, repeat(0)), (0,)) for f in found), dtype=np.uint64, count=int(starts[-1]))
                rows = pieces.matches(ids, starts)
                if rows:
                    names = part.column(0).cast(pa.string())
                    text, item, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(text)), pa.array(item, pa.string()), *(pa.array(c, pa.int32()) for c in rest)],
                        names=["id", "item", "distance", "budget", "item_words", "end_word"])

        hits = arrow_map(narrow, run, schema)
        out = hits if out is None else out.unionByName(hits)
        if len(block) < block_items:
            break
    return out.select(F.col("id").cast(id_type).alias("doc_id"), F.col("item").cast(item_type).alias("item_id"),
                      "distance", "budget", "item_words", "end_word")

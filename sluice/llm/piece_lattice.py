"""SentencePiece encoding with the N best segmentations, and decoding."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace, nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, offsets, text_batches

SPACE = "▁"
# penalty of a character without a piece, below the worst piece, as in the library's own lattice
UNKNOWN_PENALTY = 10.0
# distinct units a Python worker remembers; characters of a unit up to which units are segmented together, and of such a step
CACHED_UNITS, TOGETHER, STEP_CELLS = 200_000, 40, 100_000
# characters beyond which a unit is looked through for places that no piece crosses
LONG = 1000
# bytes of text whose new units are segmented together
STEP_TEXT = 1 << 20


def load_pieces(path: str) -> dict:
    """Pieces and scores of a model file as plain values.

    The file must add a leading space, escape spaces, and have byte pieces; a piece holds spaces at its start only.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, bytes_of = {}, {}, [0] * 256
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_of[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece holds a space after other characters")
            ids[piece] = i
            # the vocabulary leaves its piece of one space outside the ranking of merges: it counts as the last
            scores[piece] = model.get_score(i)
            spelled.append(piece.replace(SPACE, " ").encode())
    worst = min(s for s in scores.values() if s > -1e8)
    scores = {p: (s if s > -1e8 else worst) for p, s in scores.items()}
    # every beginning of a piece, so that a search from a place can stop: piece to (score, ids), other beginnings to (None, None)
    table = {p[:i]: (None, None) for p in ids for i in range(1, len(p))} | {p: (scores[p], [ids[p]]) for p in ids}
    return {"table": table, "ids": ids, "scores": scores, "bytes": bytes_of, "spelled": spelled, "longest": max(map(len, ids)), "unknown": worst - UNKNOWN_PENALTY,
            "breaks": "\n" not in {c for p in ids for c in p}}


def lattice(unit: str, model: dict) -> tuple[array, array, array, array, dict[int, list[int]], array]:
    """Arcs by their end, as flat arrays: (first arc of each end, start, score, id, byte ids of unknown arcs, best score of each prefix).

    Arcs into one place come by their start. A character without a piece is an arc of its bytes, whose id is -1.
    """
    table, longest, n = model["table"], model["longest"], len(unit)
    best = array("d", [0.0]) + array("d", [float("-inf")]) * n
    first, starts, scores, ids, spelled = array("q", [0, 0]), array("q"), array("d"), array("q"), {}
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            hit = table.get(unit[start:end])
            if hit is not None and hit[0] is not None:
                score, piece = hit[0], hit[1][0]
            elif start == end - 1:
                score, piece = model["unknown"], -1
                spelled[len(ids)] = [model["bytes"][b] for b in unit[start].encode()]
            else:
                continue
            starts.append(start)
            scores.append(score)
            ids.append(piece)
            if best[start] + score > best[end]:
                best[end] = best[start] + score
        first.append(len(ids))
    return first, starts, scores, ids, spelled, best


def segmentations(unit: str, model: dict, wanted: int) -> Iterator[tuple[float, tuple[int, ...]]]:
    """The ``wanted`` best segmentations of a unit, best first, as (score, ids).

    A forward Viterbi pass gives the best score of every prefix. The search then runs backward from the end; what is left is always
    a prefix, so its Viterbi score is the exact rest of the path and a path's first arrival at the start is the next best.
    Equal scores: the path that is further on goes first, then the one found first.

    Paths are links to the rest of the path, so memory is in proportion to the unit. A path that leaves the best one at one place and is completed by
    Viterbi is a segmentation of its own; what scores below ``wanted`` of these is not pursued.
    """
    first, starts, scores, ids, spelled, best = lattice(unit, model)
    at, done, alone = len(unit), 0.0, []
    while at:
        chosen = None
        for i in range(first[at], first[at + 1]):
            total = best[starts[i]] + scores[i]
            if chosen is None and total == best[at]:
                chosen = i
            elif len(alone) < wanted:
                heappush(alone, total + done)
            elif total + done > alone[0]:
                heapreplace(alone, total + done)
        at, done = starts[chosen], done + scores[chosen]
    # rounding differs with the order of additions
    least = alone[0] - 1e-9 * max(1.0, abs(alone[0])) if len(alone) == wanted else float("-inf")
    arc, rest = array("q"), array("q")
    heap, count = [(-best[-1], len(unit), -1, 0.0)], 0
    while heap and count < wanted:
        rank, at, link, done = heappop(heap)
        if at == 0:
            count += 1
            path = []
            while link >= 0:
                path += spelled[arc[link]] if ids[arc[link]] < 0 else (ids[arc[link]],)
                link = rest[link]
            yield -rank, tuple(path)
            continue
        for i in range(first[at], first[at + 1]):
            total = best[starts[i]] + scores[i] + done
            if total >= least:
                heappush(heap, (-total, starts[i], len(arc), scores[i] + done))
                arc.append(i)
                rest.append(link)


def apart(unit: str, model: dict) -> list[str]:
    """A long unit cut wherever no piece reaches across; its segmentations are those of the parts."""
    table, longest = model["table"], model["longest"]
    cuts, reach = [0], 0
    for start in range(len(unit)):
        if start and start >= reach:
            cuts.append(start)
        for end in range(start + 1, min(start + longest, len(unit)) + 1):
            hit = table.get(unit[start:end])
            if hit is None:
                break
            if hit[0] is not None:
                reach = max(reach, end)
    return [unit[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(unit)])]


def best_two(unit: str, model: dict) -> tuple[float, list[int], float]:
    """(score and ids of the best segmentation, score of the second best or -inf).

    What :func:`segmentations` gives first and second, without its queue: the second best leaves the best path at one place, and
    from there on the Viterbi scores complete it.
    """
    first, starts, scores, ids, spelled, best = lattice(unit, model)
    at, done, second, tail = len(unit), 0.0, float("-inf"), []
    while at:
        chosen = None
        for i in range(first[at], first[at + 1]):
            total = best[starts[i]] + scores[i]
            if chosen is None and total == best[at]:
                chosen = i
            elif total + done > second:
                second = total + done
        tail.append(spelled[chosen] if ids[chosen] < 0 else (ids[chosen],))
        done += scores[chosen]
        at = starts[chosen]
    return best[-1], [i for own in reversed(tail) for i in own], second


class PieceTable:
    """Pieces by a 64-bit hash of their characters, for many look-ups at once."""

    FACTOR, BUCKET_BITS = np.uint64(0x9E3779B97F4A7C15), 19

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        pieces = list(ids)
        hashes = np.array([self.hash_of(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64(0))
        self.scores = np.append(np.array([scores[p] for p in pieces])[order], -np.inf)
        self.ids = np.append(np.array([ids[p] for p in pieces], dtype=np.int32)[order], -1)
        bucket = (self.hashes[:-1] >> np.uint64(64 - self.BUCKET_BITS)).astype(np.int64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.starts = np.searchsorted(bucket, np.arange(1 << self.BUCKET_BITS)).astype(np.int32)
        self.deepest = int(np.bincount(bucket).max()) if len(bucket) else 0

    @classmethod
    def hash_of(cls, piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(cls.FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return value * int(cls.FACTOR) & 0xFFFFFFFFFFFFFFFF

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``scores`` and ``ids``; the last one stands for no piece."""
        none = len(self.hashes) - 1
        at = self.starts[(hashes >> np.uint64(64 - self.BUCKET_BITS)).astype(np.int64)]
        out = np.full(hashes.shape, none, dtype=np.int32)
        for i in range(self.deepest):
            near = np.minimum(at + i, none)
            out = np.where(self.hashes[near] == hashes, near, out)
        return out


def best_two_of_many(units: list[str], table: PieceTable, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`best_two` of units of one length at once: (all characters known, scores, seconds, numbers of ids, ids one unit after another).

    Where a character has no piece the other results mean nothing. Sums are made in the same order, so they are equal to the bit.
    """
    n, size = len(units), len(units[0])
    codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0.0
    other, score_at = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1))
    start_at, id_at = np.zeros((n, size + 1), dtype=np.int32), np.zeros((n, size + 1), dtype=np.int32)
    known, every = np.ones(n, dtype=bool), np.arange(n)
    running = np.zeros((n, size), dtype=np.uint64)
    for end in range(1, size + 1):
        low = max(0, end - longest)
        running[:, low:end] = running[:, low:end] * table.FACTOR + codes[:, end - 1, None]
        place = table.find(running[:, low:end] * table.FACTOR)
        scores = table.scores[place]
        known &= scores[:, -1] > -np.inf
        total = best[:, low:end] + scores
        chosen = total.argmax(axis=1)
        best[:, end] = total[every, chosen]
        start_at[:, end] = low + chosen
        score_at[:, end], id_at[:, end] = scores[every, chosen], table.ids[place[every, chosen]]
        total[every, chosen] = -np.inf
        other[:, end] = total.max(axis=1)
    at, done, second = np.full(n, size), np.zeros(n), np.full(n, -np.inf)
    path, lengths = np.zeros((n, size), dtype=np.uint32), np.zeros(n, dtype=np.int64)
    rows = every
    while len(rows):
        here = at[rows]
        second[rows] = np.maximum(second[rows], other[rows, here] + done[rows])
        path[rows, size - 1 - lengths[rows]] = id_at[rows, here]
        lengths[rows] += 1
        done[rows] += score_at[rows, here]
        at[rows] = start_at[rows, here]
        rows = rows[at[rows] > 0]
    return known, best[:, size], second, lengths, path[np.arange(size)[None, :] >= (size - lengths)[:, None]]


class Seats(dict):
    """Unit to its seat in the memo; an unknown unit is segmented and gets the next one."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.blobs: list[bytes] = []
        self.score, self.gap, self.size = array("d"), array("d"), array("q")

    def __missing__(self, unit: str) -> int:
        best, ids, second = best_two(unit, self.model)
        found = self[unit] = len(self.blobs)
        self.blobs.append(struct.pack(f"<{len(ids)}I", *ids))
        self.size.append(4 * len(ids))
        self.score.append(best)
        self.gap.append(best - second)
        return found

    def learn(self, units: set[str]) -> None:
        """Segments many new units, those of one length together; single ones, long ones and unknown characters are left to ``__missing__``."""
        by_size: dict[int, list[str]] = {}
        for unit in units.difference(self):
            by_size.setdefault(len(unit), []).append(unit)
        for size, group in by_size.items():
            if size > TOGETHER or len(group) < 8:
                continue
            for lo in range(0, len(group), max(1, STEP_CELLS // size)):
                part = group[lo:lo + max(1, STEP_CELLS // size)]
                known, best, second, lengths, ids = best_two_of_many(part, self.model["pieces"], self.model["longest"])
                raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(lengths)
                begins = ends - 4 * lengths
                if not known.all():
                    part = [unit for unit, fits in zip(part, known.tolist()) if fits]
                    best, second, lengths, begins, ends = (v[known] for v in (best, second, lengths, begins, ends))
                self.update(zip(part, range(len(self.blobs), len(self.blobs) + len(part))))
                self.blobs += [raw[lo:hi] for lo, hi in zip(begins.tolist(), ends.tolist())]
                for column, values in ((self.size, 4 * lengths), (self.score, best), (self.gap, best - second)):
                    column.frombytes(values.tobytes())


class Encoder:
    """Encodes whole texts; what it learns about units is kept for the next text."""

    def __init__(self, model: dict, n_best: int):
        self.model, self.n_best = model, n_best
        if "pieces" not in model:
            model["pieces"] = PieceTable(model["ids"], model["scores"])
        line = "\n" if model["breaks"] else ""
        # pieces cross neither the start of a run of spaces nor a line end that no piece holds, so units are independent
        self.units = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + ("|\n" if line else ""))
        self.clear()

    def clear(self) -> None:
        self.seats = Seats(self.model)
        self.others: dict[str, list[tuple[float, bytes, bool]]] = {}

    def encode(self, text: str) -> tuple[bytes, list[float]]:
        """(ids of the best segmentation as little-endian 32-bit integers, scores of the N best segmentations)."""
        found = self.segmented([text])[0]
        return found[0][1] if found else b"", [score for score, _, _ in found]

    def segmented(self, texts: list[str]) -> list[list[tuple[float, bytes, bool]]]:
        """The N best segmentations of each whole text, best first: score, ids, and whether they spell what the best one spells."""
        if len(self.seats) > CACHED_UNITS or len(self.others) > CACHED_UNITS:
            self.clear()
        split = []
        for text in texts:
            units = self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []
            if units and len(max(units, key=len)) > LONG:
                units = [part for unit in units for part in (apart(unit, self.model) if len(unit) > LONG else (unit,))]
            split.append(units)
        self.seats.learn(set().union(*split))
        return [self._ranked(units) if units else [] for units in split]

    def _ranked(self, units: list[str]) -> list[tuple[float, bytes, bool]]:
        seats = list(map(self.seats.__getitem__, units))
        at = np.array(seats)
        best = float(np.frombuffer(self.seats.score)[at].sum())
        gaps = np.frombuffer(self.seats.gap)[at]
        whole = b"".join(map(self.seats.blobs.__getitem__, seats))
        ends = np.frombuffer(self.seats.size, dtype=np.int64)[at].cumsum()
        out = []
        for score, changes in self._n_best(best, units, gaps):
            parts, done, same = [], 0, True
            for _, u, ids, spelled in sorted(changes, key=lambda c: c[1]):
                parts += [whole[done:int(ends[u - 1]) if u else 0], ids]
                done, same = int(ends[u]), same and spelled
            out.append((score, b"".join([*parts, whole[done:]]), same))
        return out

    def _others(self, unit: str) -> list[tuple[float, bytes, bool]]:
        """What the 2nd to N-th segmentations of a unit lose, their ids, and whether they spell the same."""
        found = self.others.get(unit)
        if found is None:
            best, *others = segmentations(unit, self.model, self.n_best)
            spelled = self.model["spelled"]
            spell = lambda ids: b"".join([spelled[i] for i in ids])
            found = [(best[0] - s, struct.pack(f"<{len(ids)}I", *ids), spell(ids) == spell(best[1])) for s, ids in others]
            if len(unit) <= LONG:
                self.others[unit] = found
        return found

    def _n_best(self, best: float, units: list[str], gaps: np.ndarray) -> list[tuple[float, list[tuple[float, int, bytes, bool]]]]:
        """(score, changed units) of the N best segmentations of the whole text.

        A segmentation changes some units from their best; none of the N best holds a change that ranks after N - 1 others.
        """
        more = self.n_best - 1
        if more == 0:
            return [(best, [])]
        near = np.argsort(gaps, kind="stable")[:more] if len(gaps) <= more else np.argpartition(gaps, more - 1)[:more]
        changes = []
        for u in near.tolist():
            if np.isfinite(gaps[u]):
                changes += [(loss, u, ids, same) for loss, ids, same in self._others(units[u])]
        changes = nsmallest(more, changes)
        heap: list[tuple[float, int, tuple[int, ...]]] = [(0.0, -1, ())]
        heapify(heap)
        out = []
        while heap and len(out) <= more:
            loss, last, path = heappop(heap)
            out.append((best - loss, [changes[i] for i in path]))
            used = {changes[i][1] for i in path}
            for i in range(last + 1, len(changes)):
                if changes[i][1] not in used:
                    heappush(heap, (loss + changes[i][0], i, (*path, i)))
        return out


def decode(ids: bytes, model: dict) -> str:
    """Text of a sequence of ids: spelled pieces and bytes joined, without the added leading space."""
    spelled = model["spelled"]
    joined = b"".join([spelled[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
    return joined.removeprefix(b" ").decode("utf-8", "replace")


def _lists(blobs: list[bytes]) -> pa.ListArray:
    """One list of ids per blob."""
    ends = offsets(np.array([len(b) // 4 for b in blobs], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int32)))


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n_best: int = 4, with_ids: bool = True,
) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, score, n_best, n_best_pieces, n_best_crc32, round_trip[, ids, segmentations]) per row of ``docs``.

    Encodes each whole text by the best segmentation over the piece lattice (``ids``) and gives the ``n_best`` best ones, the best first
    (``segmentations``), with the score, number of pieces and crc of each. ``round_trip`` says whether all of them decode to the
    text (a text that holds the escape character itself does not: it comes back as a space): the best one is decoded, and the others
    are checked to spell the same. Bytes that are no UTF-8 are read as replacement characters. Crcs are over the ids as little-endian 32-bit integers.

    Null and empty texts: no pieces, crc 0, score null, no n_best, and round_trip true for empty, null for null. Fewer segmentations
    than ``n_best`` give a shorter list. Repeated rows and ties give equal results. Other columns are not read. The vocabulary is
    read on the driver and broadcast, as it has the size of the file. No shuffle; memory is a batch and a bounded memo of units.
    """
    model = load_pieces(model_path)
    # the value stays with a Python worker, and so does the memo in it
    shared = docs.sparkSession.sparkContext.broadcast({"model": model, "memo": {}})
    schema = "doc_id {}, n_pieces long, ids_crc32 long, score double, n_best array<double>, n_best_pieces array<long>, n_best_crc32 array<long>, round_trip boolean".format(
        docs.schema[id_col].dataType.simpleString()) + (", ids array<int>, segmentations array<array<int>>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value["model"], shared.value["memo"]
        encoder = memo.get(n_best)
        if encoder is None:
            encoder = memo[n_best] = Encoder(model, n_best)
        for part, texts in text_batches(batches, 1, STEP_TEXT):
            plain = [t.decode("utf-8", "replace") if t else "" for t in texts]
            found = encoder.segmented(plain)
            blobs = [r[0][1] if r else b"" for r in found]
            same = [None if t is None else decode(b, model) == p and all(r[2] for r in ranked) for t, p, b, ranked in zip(texts, plain, blobs, found)]
            columns = [part.column(0), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                       pa.array([r[0][0] if r else None for r in found], pa.float64()), pa.array([[x[0] for x in r] for r in found], pa.list_(pa.float64())),
                       pa.array([[len(x[1]) // 4 for x in r] for r in found], pa.list_(pa.int64())),
                       pa.array([[zlib.crc32(x[1]) for x in r] for r in found], pa.list_(pa.int64())), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "score", "n_best", "n_best_pieces", "n_best_crc32", "round_trip"]
            if with_ids:
                every = [x[1] for r in found for x in r]
                columns += [_lists(blobs), pa.ListArray.from_arrays(pa.array(offsets(np.array([len(r) for r in found])).astype(np.int32)), _lists(every))]
                names += ["ids", "segmentations"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)


def decode_pieces(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with piece ids; null ids give null, no ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode(np.array(ids, dtype="<u4").tobytes(), shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(rows.select(F.col(id_col), F.col(ids_col)), run, f"doc_id {rows.schema[id_col].dataType.simpleString()}, text string")

"""Token ids in grammar-compressed blocks (Re-Pair), with random access."""

from __future__ import annotations

import codecs
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import STEP_BYTES, arrow_map, offsets, staging_path, text_batches

MAGIC = b"RPR1"
# white space other than spaces, line ends and tabs: texts with it go to the library whole
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
# first byte of U+0500, as letters below it (Latin, Greek and Cyrillic) are such in every version of Unicode; signs behind a word are one word of the pattern
LETTERS_BYTE, SIGNS = 0xD4, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# stands for a line end at which a text is cut
LINE_END = "\x0b"
# characters that stand for the 256 bytes in byte-level vocabularies; a line end is kept here, as the mark between words
PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = "".join("\n" if b == 10 else chr(b) if b in PRINTED else chr(256 + sum(x not in PRINTED for x in range(b))) for b in range(256))
# distinct words and other chunks a worker remembers, chunks given to the library in one text, buckets of the pair counter, pairs replaced in one round
CACHED_CHUNKS, JOINED, BUCKETS, ROUND_PAIRS = 600_000, 64, 1 << 20, 8192
# times a pair is replaced at least: blocks of given texts were smallest at 4 to 6 (rarer rules take more than they save)
LEAST = 6


def _runs(flat: np.ndarray, at: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Picked runs of an array one after another, and where each begins; ``at`` has where the array's runs begin, and its end."""
    begins = offsets(np.diff(at)[picked])
    return flat[np.repeat(at[picked] - begins[:-1], np.diff(begins)) + np.arange(begins[-1])], begins


def _strings(chunks: pa.StringArray) -> list[str]:
    """Chunks as Python strings; one text and a split are much faster than an object for each element, and no chunk has a space."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), " ")[0].as_py().split(" ") if len(chunks) else []


class WordEncoder:
    """Ids of whole texts by the tokenizers library, remembering the chunks between single spaces.

    Byte-level BPE never merges across the words of its pattern, and a single space between other characters always begins a
    word, so a text's ids are those of its chunks, and chunks one after another are encoded as a text is. A line end between other characters than white space is a
    word of its own, so texts without blank lines and carriage returns are cut there as well. Letters are one word of the
    pattern, and so are signs behind them: chunks of these go to the library's model word by word, without its pattern.
    Of other chunks, many go to the library in one text; which ids are a chunk's follows from the bytes that each id stands for.
    Texts with further white space beside a space, rare white space, or the text of a special token go to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.specials = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        # the byte-level alphabet has a character for each byte
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.line_end = self._whole("\n")
        # ids of a word of letters that a space precedes, of one after a line end (with that), of signs behind a word, of other chunks
        self.words: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        self.chunks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.words, self.starts, self.signs, self.chunks = (
            m if len(m) <= CACHED_CHUNKS else dict(islice(m.items(), len(m) - CACHED_CHUNKS // 2, None)) for m in (self.words, self.starts, self.signs, self.chunks))
        # a text is cut as if a line end stood before it, whose ids are left out again
        marked = [
            None if not text or LINE_END in text or any(s in text for s in self.specials)
            else LINE_END + (text if "\n\n" in text or "\r" in text else text.replace("\n", " " + LINE_END)) for text in texts]
        split = pc.split_pattern(pa.array(marked, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        # the ids of each distinct chunk, those of each chunk in turn, where each text's begin, and the texts that have a chunk without ids
        chunks, at = self._ids_of(coded.dictionary)
        ids, begins = _runs(chunks, at, code)
        ids = ids.tobytes()
        ends = offsets(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
        lost = np.diff(offsets((np.diff(at) == 0)[code])[ends]) > 0
        byte, skipped = (4 * begins[ends]).tolist(), len(self.line_end)
        joined = [mark is not None and not bad for mark, bad in zip(marked, lost.tolist())]
        return [ids[lo + skipped:hi] if j else self._whole(text) for text, j, lo, hi in zip(texts, joined, byte, byte[1:])]

    @staticmethod
    def _odd(chunk: str) -> bool:
        """Chunks whose ids depend on the white space around them, or may do so."""
        return not chunk or chunk[0].isspace() or chunk[-1].isspace() or RARE_SPACE.search(chunk) is not None

    def _ids_of(self, distinct: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that a space precedes, and where each chunk's begin; none for odd ones."""
        if not len(distinct):
            return np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        # words of letters with signs behind them, found for all at once
        started = pc.starts_with(distinct, LINE_END).to_numpy(zero_copy_only=False)
        stems = pc.ascii_ltrim(pc.ascii_rtrim(distinct, characters=SIGNS), characters=LINE_END)
        length, kept = (pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in (distinct, stems))
        begins = offsets(length)
        data = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8)[:begins[-1]]
        far = np.diff(offsets(data >= LETTERS_BYTE)[begins]) > 0
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & ~far
        # the bytes behind each word, and a chunk of two pieces: a word or another chunk, and signs or nothing
        behind = begins[:-1] + kept + started
        behind = behind[plain], begins[1:][plain] - behind[plain]
        ends = offsets(behind[1])
        raw = data[np.repeat(behind[0] - ends[:-1], behind[1]) + np.arange(ends[-1])]
        signs = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        blobs, piece = [b""], np.zeros((len(distinct), 2), dtype=np.int64)
        for column, rows, coded, memo, learn in (
            (0, plain & ~started, stems.filter(pa.array(plain & ~started)).dictionary_encode(), self.words, lambda new: self._words(new, "\u0120")),
            (0, plain & started, stems.filter(pa.array(plain & started)).dictionary_encode(), self.starts, lambda new: self._words(new, "", self.line_end)),
            (1, plain, signs, self.signs, lambda new: {s: self._whole(s) for s in new}),
            (0, ~plain, distinct.filter(pa.array(~plain)).dictionary_encode(), self.chunks, self._others),
        ):
            piece[rows, column] = len(blobs) + coded.indices.to_numpy()
            blobs += self._remembered(memo, _strings(coded.dictionary), learn)
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        ids, at = _runs(np.frombuffer(b"".join(blobs), dtype="<u4"), offsets(sizes), piece.ravel())
        return ids, at[::2]

    @staticmethod
    def _remembered(memo: dict[str, bytes], names: list[str], learn: Callable) -> list[bytes]:
        """What the memo holds of names, after it has learned those it lacks."""
        blobs = list(map(memo.get, names))
        missing = [i for i, b in enumerate(blobs) if b is None]
        if missing:
            memo.update(learn([names[i] for i in missing]))
            for i in missing:
                blobs[i] = memo.get(names[i], b"")
        return blobs

    def _words(self, words: list[str], lead: str, before: bytes = b"") -> dict[str, bytes]:
        """Ids of words of letters, each after ``lead``, from the library's model."""
        # flat lists: one for each word would keep Python's garbage collector busy
        tokenize, ids, cuts = self.model.tokenize, [], [0]
        for word in codecs.charmap_decode("\n".join(words).encode(), "strict", ALPHABET)[0].split("\n"):
            ids += [t.id for t in tokenize(lead + word)]
            cuts.append(4 * len(ids))
        raw = np.array(ids, dtype="<u4").tobytes()
        return dict(zip(words, [before + raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]))

    def _others(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of other chunks that are not odd: those after a line end alone, those after a space many in one text."""
        out = {c: self._whole("\n" + c[1:]) for c in chunks if c[0:1] == LINE_END and not self._odd(c[1:])}
        out.update(self._joined([c for c in chunks if not self._odd(c)]))
        return out

    def _joined(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that a space precedes, many in one text; where the bytes of ids and chunks do not meet, the chunk goes alone."""
        out = {}
        groups = [chunks[lo:lo + JOINED] for lo in range(0, len(chunks), JOINED)]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoding.ids, dtype="<u4")
            reached = np.cumsum(self.width[ids])
            wanted = np.cumsum([1 + (len(c) if c.isascii() else len(c.encode())) for c in group])
            ends = np.searchsorted(reached, wanted)
            if not len(reached) or ends[-1] >= len(reached) or (reached[ends] != wanted).any():
                for c in group:
                    out[c] = self._whole(" " + c)
                continue
            raw, cuts = ids.tobytes(), (4 * (ends + 1)).tolist()
            out.update(zip(group, [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts)]))
        return out


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places that follow one another every second."""
    starts = np.ones(len(at), dtype=bool)
    starts[1:] = np.diff(at) > 1
    run = np.flatnonzero(starts)
    return (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(sequence, rules, lengths, rounds): rules are pairs of symbols; a symbol from ``base`` up, the largest id plus one, is a rule.

    A round replaces up to ``ROUND_PAIRS`` of the most frequent pairs from left to right without overlap, each ``least`` times at least. Pairs are counted in
    hashed buckets and exactly within the heavy ones. Rounds end when a
    round over all pairs replaces none so often; what may be left are pairs that take each other's places.
    ``lengths`` are the ids each rule expands to, and ``rounds`` the number of rules after each round.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules, lengths, rounds = np.empty((0, 2), dtype=np.uint32), np.empty(0, dtype=np.int64), []
    every = False  # after a round of heavy buckets that held no such pair, all buckets are looked at
    while len(seq) > 1:
        left, right = seq[:-1], seq[1:]
        bucket = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(12)
        weight = np.bincount(bucket, minlength=BUCKETS)
        heavy = weight >= least
        most = max(4, min(ROUND_PAIRS, len(seq) >> 6))  # pairs that share symbols spoil each other, the more the shorter the sequence
        cut = not every and heavy.sum() > most
        taken = np.flatnonzero(heavy)
        if cut:
            taken = taken[np.argpartition(weight[taken], -most)[-most:]]
            heavy = np.zeros(BUCKETS, dtype=bool)
            heavy[taken] = True
        at = np.flatnonzero(heavy[bucket])
        # exact counts of the pairs in heavy buckets: of one pair a bucket by the bucket's number, of those that share its bucket by sorting
        number = np.zeros(BUCKETS, dtype=np.int32)
        number[taken] = np.arange(len(taken), dtype=np.int32)
        slot = number[bucket[at]]
        seen = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
        pairs = np.zeros(len(taken), dtype=np.uint64)
        pairs[slot] = seen
        others = np.flatnonzero(pairs[slot] != seen)
        if len(others):
            beside, inverse = np.unique(seen[others], return_inverse=True)
            slot[others] = len(pairs) + inverse
            pairs = np.concatenate([pairs, beside])
        chosen = np.bincount(slot, minlength=len(pairs)) >= least
        at, slot = at[chosen[slot]], slot[chosen[slot]]
        apart = _apart(at)
        at, slot = at[apart], slot[apart]
        often = np.bincount(slot, minlength=len(pairs)) >= least
        at, slot = at[often[slot]], slot[often[slot]]
        if not len(at) and cut:
            every = True
            continue
        if not len(at):
            break
        every = False
        used = np.flatnonzero(np.bincount(slot, minlength=len(pairs)))
        used = used[np.argsort(pairs[used])]
        number = np.zeros(len(pairs), dtype=np.uint32)
        number[used] = np.arange(len(used), dtype=np.uint32) + np.uint32(base + len(rules))
        new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        sizes = np.concatenate([np.ones(1, dtype=np.int64), lengths])
        lengths = np.concatenate([lengths, sizes[np.maximum(new.astype(np.int64) - base + 1, 0)].sum(axis=1)])
        rules = np.concatenate([rules, new])
        before = len(seq)
        seq = seq.copy()
        seq[at] = number[slot]
        keep = np.ones(before, dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        rounds.append(len(rules))
    return seq, rules, lengths, rounds


def expand(seq: np.ndarray, rules: np.ndarray, rounds: list[int], base: int) -> np.ndarray:
    """Ids of a run of symbols: the rules of one round after another are written out, from those of the rounds before, and then the run."""
    flat, at = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def written(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = symbols >= base
        rule = symbols[mine].astype(np.int64) - base
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[mine] = at[rule + 1] - at[rule]
        where = offsets(sizes)
        source = np.repeat(at[rule] - where[:-1][mine], sizes[mine])
        out = np.empty(where[-1], dtype=np.uint32)
        if len(rule):
            ours = np.repeat(mine, sizes)
            out[ours] = flat[source + np.flatnonzero(ours)]
        out[where[:-1][~mine]] = symbols[~mine]
        return out, where

    for low, high in zip([0, *rounds], rounds):
        ids, where = written(rules[low:high].ravel())
        at = np.concatenate([at, at[-1] + where[2::2]])
        flat = np.concatenate([flat, ids])
    return written(seq)[0]


def pack(ids: np.ndarray) -> bytes:
    """A block: magic, counts, rounds, then sequence, rules and expansion lengths, as compressed little-endian integers."""
    seq, rules, lengths, rounds = compress(ids)
    base = int(ids.max()) + 1 if len(ids) else 0
    head = struct.pack("<5I", base, len(ids), len(seq), len(rules), len(rounds)) + np.array(rounds, dtype="<u4").tobytes()
    body = seq.astype("<u4").tobytes() + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes()
    return MAGIC + zstandard.compress(head + body, 1)


class Block:
    """A packed block, opened; ``ids(lo, hi)`` expands only the symbols that hold the asked ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        raw = zstandard.decompress(payload[4:])
        self.base, self.count, n_seq, n_rules, n_rounds = struct.unpack_from("<5I", raw)
        arrays = np.frombuffer(raw, dtype="<u4", offset=20)
        cuts = np.cumsum([n_rounds, n_seq, 2 * n_rules, n_rules])
        rounds, self.seq, rules, self.lengths = np.split(arrays, cuts[:3])
        self.rounds, self.rules = rounds.tolist(), rules.reshape(-1, 2)
        self.starts: np.ndarray | None = None

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        if lo == 0 and (hi is None or hi >= self.count):
            return expand(self.seq, self.rules, self.rounds, self.base)
        if self.starts is None:
            sizes = np.concatenate([np.ones(1, dtype=np.int64), self.lengths.astype(np.int64)])
            self.starts = offsets(sizes[np.maximum(self.seq.astype(np.int64) - self.base + 1, 0)])
        hi = self.count if hi is None else min(hi, self.count)
        if lo >= hi:
            return np.empty(0, dtype=np.uint32)
        first, last = np.searchsorted(self.starts, lo, "right") - 1, np.searchsorted(self.starts, hi, "left")
        skipped = int(self.starts[first])
        return expand(self.seq[first:last], self.rules, self.rounds, self.base)[lo - skipped:hi - skipped]


def write_token_blocks(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1_000_000,
) -> None:
    """Writes the ids of all documents in ascending id order as grammar-compressed blocks below ``path``.

    A file row is a block: (part, block, n_ids, docs, sizes, payload), about ``block_ids`` ids of whole documents with ``end_id`` after each. Parts
    are ranges of document ids, so (part, block) is the order of the ids. Null texts count as empty; null ids come
    first; rows of one id are ordered by the hash of their text. Each task holds one block. The vocabulary file is read on the
    driver and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    # the value stays with a Python worker, and so does the memo in it
    shared = spark.sparkContext.broadcast({"content": content, "memo": {}})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shared.value["memo"]
        encoder = memo.get("encoder")
        if encoder is None:
            encoder = memo["encoder"] = WordEncoder(shared.value["content"])
        part, number = TaskContext.get().partitionId(), 0
        names, blobs, held = [], [], 0

        def several(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
            """Ids and texts, batches of few bytes together: words that several texts have are looked up once."""
            ids, texts, size = [], [], 0
            for piece, some in text_batches(batches, 1):
                if texts and size + sum(map(len, some)) > STEP_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids += piece.column(0).to_pylist()
                texts += [t.decode("utf-8", "replace") for t in some]
                size += sum(map(len, some))
            if texts:
                yield ids, texts

        def flush() -> pa.RecordBatch:
            nonlocal names, blobs, held, number
            payload = pack(np.frombuffer(b"".join(blobs), dtype="<u4"))
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                pa.array([[len(b) // 4 for b in blobs]], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], names=["part", "block", "n_ids", "docs", "sizes", "payload"])
            names, blobs, held, number = [], [], 0, number + 1
            return row

        for ids, texts in several(batches):
            for name, blob in zip(ids, encoder.encode(texts)):
                names.append(name)
                blobs.append(blob + end)
                held += len(blob) // 4 + 1
                if held >= block_ids:
                    yield flush()
        if blobs:
            yield flush()

    arrow_map(rows, run, "part int, block int, n_ids long, docs array<long>, sizes array<long>, payload binary").write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before: totals of parts (one row each) are added up in order, blocks within their part, and
    documents within their block. Payloads are decoded block by block and never shuffled.
    """
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, docs, sizes, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw = Block(payload).ids().astype("<u4").tobytes()
                at = offsets(np.array(sizes, dtype=np.int64))
                crcs = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                    pa.array(at[:-1]), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part", "block", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = arrow_map(blocks.select("part", "block", "docs", "sizes", "payload"), run,
                     "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    inside = blocks.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("inner"))
    bases = inside.join(parts, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(bases, ["part", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the blocks to the shared folder and returns what the files hold."""
    path = staging_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_token_blocks(docs.sparkSession, path)

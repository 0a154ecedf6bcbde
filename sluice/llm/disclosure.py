"""Personal data, and the terms that give it away by what the corpus says together with it."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, near_rows, stage, text_batches

KINDS = ("email", "ip", "card", "phone", "term")
_RANK = {k: i for i, k in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# groups of digits tied by single dots; four groups in a row are an address
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
# bits of the table that sifts words before they are emitted
BITS = 1 << 20
EDGE_BYTES, DIGITS = EDGE.encode(), frozenset(b"0123456789")
# state of the checksum after "t:"
T_CRC = zlib.crc32(b"t:")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of emails, addresses, cards and phone numbers by start, then kind; every scan is linear in the text.

    Matches of one kind are the leftmost that do not overlap; one that fails its check is dropped and not tried again from within.
    """
    spans = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            spans.append((start, "email", done))
        at = text.find("@", max(at + 1, done))
    for chain in DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        groups = list(GROUP.finditer(chain[0]))
        for i in range(0, len(groups) - 3, 4):
            parts = [g[0].lstrip("0") or "0" for g in groups[i:i + 4]]
            if all(len(p) < 4 and int(p) < 256 for p in parts):
                spans.append((chain.start() + groups[i].start(), "ip", chain.start() + groups[i + 3].end()))
    for found in CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            spans.append((found.start(), "card", found.end()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in found[0]) <= 15:
                spans.append((found.start(), "phone", found.end()))
    spans.sort(key=lambda s: (s[0], _RANK[s[1]]))
    return spans


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a value."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(c for c in value if c.isdigit())}"


def term_of(word: str) -> tuple[str, int, int] | None:
    """A word without ASCII punctuation at its ends, in lower case, and where it lies in the word; None under two characters."""
    start = len(word) - len(word.lstrip(EDGE))
    bare = word.strip(EDGE)
    return (bare.lower(), start, start + len(bare)) if len(bare) > 1 else None


def shape(term: str) -> str:
    """What a term is generalised to."""
    digits = any("0" <= c <= "9" for c in term)
    return "code" if digits and any(c.isalpha() for c in term) else "number" if digits else "word"


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def free_words(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that no span overlaps."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    if not spans or not words:
        return words
    starts, ends = np.array(words).T
    taken = np.zeros(len(words), dtype=bool)
    for start, _, end in spans:
        taken[np.searchsorted(ends, start, side="right"):np.searchsorted(starts, end)] = True
    return [words[i] for i in np.flatnonzero(~taken)]


def mentions(text: str, spans: list[tuple[int, str, int]], window: int) -> Iterator[tuple[str, str, int]]:
    """(entity, term, context) for the terms up to ``window`` words beside each protected value; each entity and term once.

    Terms are ``t:`` and a word, or ``s:`` and a shape. The context is a minimum hash over the other words of the window, so
    copies of a passage have the same one and passages of their own have different ones.
    """
    if not spans:
        return
    words = free_words(text, spans)
    starts, seen = [w[0] for w in words], set()
    for start, kind, end in spans:
        name, near = entity(kind, text[start:end]), {}
        lo, hi = bisect_left(starts, start), bisect_left(starts, end)
        for a, b in words[max(0, lo - window):lo] + words[hi:hi + window]:
            term = term_of(text[a:b])
            if term and term[0] not in near:
                near[term[0]] = _code(term[0])
        least = nsmallest(2, near.items(), key=lambda x: x[1])
        for term in near:
            other = next((h for t, h in least if t != term), 0)
            for key in ("t:" + term, "s:" + shape(term)):
                if (name, key) not in seen:
                    seen.add((name, key))
                    yield name, key, other - (1 << 63)


def _digest(column: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256))


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def disclosing_terms(docs: DataFrame, id_col: str, text_col: str, window: int, contexts: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(base, revealed): the base spans of every row, and per digest of a text the terms to hide in it and whether their shape may be shown."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in text_batches(batches, 1):
            out = defaultdict(list)
            for value in found:
                text = _text(value)
                spans = base_spans(text)
                for name in KINDS[:4]:
                    out["n_" + name].append(sum(s[1] == name for s in spans))
                out["digest"].append(hashlib.sha256(value or b"").digest())
                out["spans"].append(written(spans))
                out["entities"].append(sorted({entity(k, text[a:b]) for a, k, b in spans}))
                out["pairs"].append([{"entity": e, "term": t, "context": c} for e, t, c in mentions(text, spans, window)])
            pairs = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out["digest"], pa.binary()), *(pa.array(out["n_" + k], pa.int64()) for k in KINDS[:4]),
                 pa.array(out["spans"], pa.string()), pa.array(out["entities"], pa.list_(pa.string())), pa.array(out["pairs"], pairs)],
                names=["id", "digest", "n_email", "n_ip", "n_card", "n_phone", "spans", "entities", "pairs"])

    base = stage(arrow_map(texts, scan, f"id {kind}, digest binary, n_email long, n_ip long, n_card long, n_phone long, spans string, "
                           "entities array<string>, pairs array<struct<entity: string, term: string, context: long>>"), "personal")

    # rows of an entity, a term and a context, then the number of contexts that count as independent (inverse Simpson index)
    together = base.select(F.explode("pairs").alias("p")).groupBy("p.entity", "p.term", "p.context").agg(F.count("*").alias("n"))
    together = together.groupBy("entity", "term").agg(
        F.sum("n").alias("both"), (F.pow(F.sum("n"), F.lit(2.0)) / F.sum(F.col("n").cast("double") * F.col("n"))).alias("contexts"))
    backed = stage(together.where(F.col("contexts") >= contexts - 1e-9), "backed")
    hidden = backed.where("term LIKE 't:%'").select("entity").distinct()
    pairs = backed.join(hidden, "entity", "left_semi")

    # words of the corpus that may be such a term, sifted by a table of BITS bits before they leave their task
    buckets = pairs.select(F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(BITS)).alias("b")).groupBy(F.expr("b div 32").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(b % 32 AS INT)))").alias("bits"))
    sieve = np.zeros(BITS // 32, dtype=np.uint64)
    for r in buckets.toLocalIterator():
        sieve[r.word] = r.bits
    bits = sieve.tobytes()

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, dtype=np.uint64).astype("<u4")
        on = np.unpackbits(table.view(np.uint8), bitorder="little").tobytes()
        shapes = [(s, on[zlib.crc32(b"s:" + s.encode()) % BITS]) for s in ("word", "number", "code")]
        for _, found in text_batches(batches, 0):
            digests, terms = [], []
            for value in found:
                words = {w.strip(EDGE_BYTES) for w in (value or b"").split()}
                # whole words in lower case as bytes; only those of other scripts are decoded
                words = {w.lower() if w.isascii() else w.decode("utf-8", "replace").lower().encode() for w in words}
                hits = [w for w in words if on[zlib.crc32(w, T_CRC) % BITS] and len(w.decode()) > 1]
                hits = ["t:" + w.decode() for w in hits]
                if any(wanted for _, wanted in shapes):
                    forms = {shape(w.decode()) if any(c in DIGITS for c in w) else "word" for w in words if len(w) > 1}
                    hits += ["s:" + s for s, wanted in shapes if wanted and s in forms]
                if hits:
                    digests += [hashlib.sha256(value).digest()] * len(hits)
                    terms += hits
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(terms, pa.string())], names=["digest", "term"])

    wanted = stage(pairs.select("term").distinct(), "terms")
    words = arrow_map(texts.select("text"), occurring, "digest binary, term string")
    holding = stage(words.join(wanted, "term", "left_semi").groupBy("digest", "term").agg(F.count("*").alias("n")), "holding")
    of_term = holding.groupBy("term").agg(F.sum("n").alias("with_term"))
    of_entity = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    total = base.count()
    # what a term tells of an entity as a share of the entity's own information: pmi / ic
    told = pairs.join(of_term, "term").join(of_entity, "entity").where(F.col("with_entity") < total).select(
        "entity", "term", (F.log2(F.lit(float(total)) * F.col("both") / F.col("with_entity") / F.col("with_term"))
                           / F.log2(F.lit(float(total)) / F.col("with_entity"))).alias("share"))
    told = stage(told.where(F.col("share") >= threshold - 1e-9), "told")
    shown = told.where("term LIKE 's:%'").select("entity", F.expr("substr(term, 3)").alias("shape"))
    is_number = F.expr("term RLIKE '[0-9]'")
    form = F.when(is_number & F.expr("term RLIKE '^t:.*\\\\p{L}'"), "code").when(is_number, "number").otherwise("word")
    terms = told.where("term LIKE 't:%'").withColumn("shape", form).join(shown.withColumn("tells", F.lit(True)), ["entity", "shape"], "left").groupBy("term").agg(
        F.coalesce(F.bool_or("tells"), F.lit(False)).alias("remove"))
    revealed = holding.join(terms, "term").groupBy("digest").agg(
        F.collect_list(F.struct(F.expr("substr(term, 3)").alias("term"), "remove")).alias("terms"))
    return base, stage(revealed, "revealed")


def term_spans(text: str, terms: set[str], spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Places of the given terms that no base span overlaps."""
    found = []
    for a, b in free_words(text, spans):
        term = term_of(text[a:b])
        if term and term[0] in terms:
            found.append((a + term[1], "term", a + term[2]))
    return found


def find_personal(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, contexts: float = 3.0, threshold: float = 0.9,
) -> DataFrame:
    """Personal data of every row: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    Base spans are emails, addresses, cards that pass Luhn and phone numbers (:func:`base_spans`). The method adds spans of kind ``term``.

    Method (information-theoretic sanitisation): the values found are the protected entities. A term up to ``window`` words from
    an entity tells pmi(entity, term) = log2(N * n_both / (n_entity * n_term)) of the entity's ic = log2(N / n_entity), over the rows of the whole
    table. Where pmi is at least ``threshold`` of ic, whoever reads the term can tell the entity, so the term is hidden in every text that
    holds it, also where the entity is not named. So that chance and copies prove nothing, the pair must stand in ``contexts`` independent
    contexts: passages are told apart by a minimum hash of their words, and equal ones are weighed together (inverse Simpson index).

    A null text is empty and has no spans; null ids are rows like others; repeated rows have equal results and count each; bytes
    that are no UTF-8 are read as replacement characters. Equality of texts is by sha256. An empty table gives no rows; other columns are not read.
    """
    base, revealed = disclosing_terms(docs, id_col, text_col, window, contexts, threshold)
    texts = _texts_with_terms(docs, text_col, revealed)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in text_batches(batches, 1):
            lists = []
            for value, terms in zip(found, part.column(2).to_pylist()):
                text = _text(value)
                spans = base_spans(text)
                both = spans + term_spans(text, {t["term"] for t in terms}, spans)
                lists.append(written(sorted(both, key=lambda s: (s[0], _RANK[s[1]]))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.string())], names=["digest", "all_spans"])

    added = stage(arrow_map(texts, merge, "digest binary, all_spans string"), "added")
    return base.join(added, "digest", "left").select(
        F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"),
        F.coalesce("all_spans", "spans").alias("spans"))


def _texts_with_terms(docs: DataFrame, text_col: str, revealed: DataFrame) -> DataFrame:
    """(digest, text, terms): each text that holds a revealing term, once."""
    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    found = near_rows(texts, "digest", revealed, "digest").groupBy("digest").agg(F.first("text").alias("text"))
    return found.join(revealed, "digest").select("digest", "text", "terms")


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, contexts: float = 3.0, threshold: float = 0.9,
) -> DataFrame:
    """(id, text): every row with its personal data replaced by ``[EMAIL]`` and so on, and revealing terms generalised or removed.

    A revealing term becomes its shape (``[NUMBER]``, ``[CODE]``, ``[WORD]``) unless the shape itself tells that much of the entity; then it goes. A
    base span inside another one goes with it. Null texts stay null. Parameters and other cases as in :func:`find_personal`.
    """
    _, revealed = disclosing_terms(docs, id_col, text_col, window, contexts, threshold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("digest"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in text_batches(batches, 1):
            out = []
            for value, terms in zip(found, part.column(2).to_pylist()):
                if value is None:
                    out.append(None)
                    continue
                text, gone = _text(value), {t["term"]: t["remove"] for t in terms or ()}
                spans = base_spans(text)
                pieces, at = [], 0
                for start, kind, end in sorted(spans + term_spans(text, set(gone), spans), key=lambda s: (s[0], -s[2], _RANK[s[1]])):
                    if start < at:
                        at = max(at, end)
                        continue
                    term = text[start:end].lower()
                    pieces += [text[at:start], "" if gone.get(term) and kind == "term" else f"[{(shape(term) if kind == 'term' else kind).upper()}]"]
                    at = end
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["id", "text"])

    joined = rows.join(revealed, "digest", "left").select("id", "text", "terms")
    kind = dict(rows.dtypes)["id"]
    return arrow_map(joined, clean, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))

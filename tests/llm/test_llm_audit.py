"""Clustering, disclosure control and filter audit against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluice.llm import disclosure, filter_audit, vafile

DOCS = "doc_id long, text string, source string, `row` string, digest string, mask int, cells string, id string, term string"
EXTRA = ("r", "d", 1, "c", "i", "t")


# ---- clusters


def plain_clusters(rows, k, rounds, dims):
    kept = []
    for vec_id, vec in rows:
        if vec is not None and len(vec) == dims and all(x is not None and math.isfinite(x) for x in vec):
            limit = vafile.component_limit(dims)
            kept.append((vec_id, [math.floor(max(-limit, min(limit, 64 * float(np.float32(x))))) for x in vec]))
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[assign(v)].append(v)
        centroids = [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else centroids[i] for i in range(len(centroids))]
    out = [(i, c := assign(v), far(v, centroids[c])) for i, v in kept]
    own = Counter()
    for _, c, d in out:
        own[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    return sorted(((i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in out), key=key)


def vectors(seed, n, dims):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.6) for x in rng.choice(centres)]) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot) for i in range(n // 2)]
    rows += [(2 * n, None), (2 * n + 1, []), (2 * n + 2, [1.0] * (dims - 1)), (2 * n + 3, [float("nan")] + [0.0] * (dims - 1)),
             (2 * n + 4, [None] + [0.0] * (dims - 1)), (2 * n + 5, [float("-inf")] + [0.0] * (dims - 1)), rows[3], (None, rows[4][1]),
             (2 * n + 6, [3e38] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize("bits, k, dims", [(3, 4, 6), (5, 7, 6), (1, 3, 9)])
def test_clusters_equal_plain_rounds(spark, bits, k, dims):
    rows = vectors(bits, 120, dims)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, `row` string, cluster int, distance int").repartition(5)
    got = vafile.cluster(frame, dims=dims, k=k, rounds=3, bits=bits).collect()
    assert sorted(map(tuple, got), key=lambda r: tuple((v is not None, str(v)) for v in r)) == plain_clusters(rows, k, 3, dims)


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vafile.cluster(spark.createDataFrame([], schema), dims=2).collect() == []
    few = vafile.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), dims=2).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in few) == [(1, 0, 0), (2, 0, 0)]
    alone = vafile.cluster(spark.createDataFrame([(None, [1.0, 2.0])], schema), dims=2).collect()
    assert [tuple(r) for r in alone] == [(None,) * 6]


def test_intervals_hold_the_distance_and_spare_most_fetches():
    rng = np.random.default_rng(3)
    centres = rng.integers(-100, 100, size=(6, 16))
    sample = np.concatenate([c + rng.integers(-9, 10, size=(400, 16)) for c in centres])
    cells = vafile.Cells(sample, sample.min(axis=0), sample.max(axis=0), 5)
    packed = cells.pack(sample)
    assert packed.shape[1] == 16 * 5 // 8
    at = cells.unpack(packed) + cells.shift
    exact = ((sample[:, None, :] - centres[None]) ** 2).sum(axis=2)
    low, high = ([t[at].sum(axis=1) for t in table] for table in cells.tables(centres))
    assert (np.stack(low, axis=1) <= exact).all() and (exact <= np.stack(high, axis=1)).all()
    may = cells.candidates(packed, cells.tables(centres))
    assert may[np.arange(len(sample)), exact.argmin(axis=1)].all()
    assert (may.sum(axis=1) > 1).mean() < 0.1


# ---- personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]
    return [(a, k, b) for a, _, k, b in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "@x", ".", "-", "+", "1", "12", "0", "255", "256", " ", "é", "4111 1111 1111 1111", "4111-1111-1111-1111", "(", ")",
                                 "a@b.c", "1.2.3.4", "+1 (017) 555-7713", "\n", "%", "007"]), max_size=30))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert disclosure.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs_are_linear():
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000 + "@", "@" * 300_000, "+1" + "(" * 400_000, "0" * 5000 + ".1.1.1", "+" * 300_000):
        disclosure.base_spans(text)
    assert disclosure.base_spans("0" * 5000 + ".1.1.1") == [(0, "ip", 5006)]


@pytest.fixture(scope="module")
def personal():
    """A nickname told with one address in passages of their own, a passage copied often, a clean corpus, and odd rows."""
    rng = random.Random(5)
    common = ["".join(rng.choice("bdfglmnr") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)] + ["now", "reach", "call", "mk2"]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [prose(rng.randint(5, 80)) for _ in range(150)]
    for i in range(5):
        texts.append(f"{prose(15)} Zorblax7, reach {'kim@mail.example.com' if i % 2 else 'KIM@mail.example.com'} now {prose(15)}")
    texts.append(f"seen: (zorblax7) {prose(10)}")
    passage = f"{prose(10)} quixotine vermilade +1 (017) 555-7713 {prose(10)}"
    texts += [passage] * 20 + [passage.replace(passage.split()[2], "changed", 1)]
    texts += [None, "", "  \n", "x" * 50_000, "call 4111 1111 1111 1111", f"{prose(3)} {prose(20_000)}"]
    rows = [(i, t, f"s{i % 3}", *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, texts[150], None, *EXTRA)]


def plain_terms(rows, window, contexts, threshold):
    """Revealing terms by plain loops over rows."""
    together, with_entity, with_term = defaultdict(Counter), Counter(), Counter()
    for row in rows:
        text = row[1] or ""
        spans = plain_spans(text)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        bare = lambda a, b: (disclosure.term_of(text[a:b]) or [None])[0]
        every = {t for t in (bare(a, b) for a, b in words) if t}
        with_term.update(every)
        free = [(a, b) for a, b in words if not any(a < e and b > s for s, _, e in spans)]
        with_entity.update({disclosure.entity(k, text[s:e]) for s, k, e in spans})
        seen = {}
        for s, k, e in spans:
            left = [w for w in free if w[0] < s][-window:]
            right = [w for w in free if w[0] >= e][:window]
            near = {t for t in (bare(a, b) for a, b in left + right) if t}
            for term in near:
                others = [disclosure._code(t) for t in near if t != term]
                seen.setdefault((disclosure.entity(k, text[s:e]), term), min(others) if others else 0)
        for pair, context in seen.items():
            together[pair][context] += 1
    out = set()
    for (name, term), found in together.items():
        n = sum(found.values())
        if n * n / sum(c * c for c in found.values()) < contexts - 1e-9 or with_entity[name] == len(rows):
            continue
        pmi = math.log2(len(rows) * n / (with_entity[name] * with_term[term]))
        if pmi / math.log2(len(rows) / with_entity[name]) >= threshold - 1e-9:
            out.add(term)
    return out


@pytest.mark.parametrize("window, contexts, threshold", [(20, 3.0, 0.9), (4, 2.0, 0.5), (20, 1.0, 0.7)])
def test_revealing_terms_equal_plain_counts(spark, personal, window, contexts, threshold):
    terms = plain_terms(personal, window, contexts, threshold)
    got = disclosure.find_personal(spark.createDataFrame(personal, DOCS).repartition(4), window=window, contexts=contexts, threshold=threshold).collect()
    wanted = []
    for row in personal:
        text = row[1] or ""
        base = plain_spans(text)
        more = [(m.start() + t[1], "term", m.start() + t[2]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)
                if (t := disclosure.term_of(m[0])) and t[0] in terms and not any(m.start() < e and m.end() > s for s, _, e in base)]
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in base)
        wanted.append((row[0], *(counts[k] for k in PATTERNS), hashlib.sha256(write(base).encode()).hexdigest(),
                       write(sorted(base + more, key=lambda s: (s[0], disclosure.KINDS.index(s[1]))))))
    assert Counter(map(tuple, got)) == Counter(wanted)
    if contexts == 3.0:
        assert terms == {"zorblax7"}


def test_sanitised_texts(spark, personal):
    out = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(personal, DOCS)).where("doc_id IS NOT NULL").collect()}
    texts = {r[0]: r[1] for r in personal}
    assert all(out[i] == texts[i] for i in range(150))
    assert all("[CODE], reach [EMAIL] now" in out[i] for i in range(150, 155))
    assert out[155].startswith("seen: ([CODE]) ")
    assert "quixotine vermilade [PHONE]" in out[156]
    assert out[177] is None and out[178] == "" and out[181] == "call [CARD]"


def test_a_term_whose_shape_tells_as_much_is_removed(spark, personal):
    rows = [(r[0], r[1].replace("mk2", "mk") if r[1] else r[1], *r[2:]) for r in personal]
    out = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(rows, DOCS)).where("doc_id BETWEEN 150 AND 155").collect()}
    assert all(" , reach [EMAIL] now" in out[i] for i in range(150, 155)) and out[155].startswith("seen: () ")


def test_personal_data_of_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert disclosure.find_personal(none).collect() == [] and disclosure.sanitise(none).collect() == []


# ---- filter audit


def plain_audit(rows, labels):
    least, good, toxic = {}, set(), set()
    for row in rows:
        if row[0] is not None:
            least[row[1] or ""] = min(row[0], least.get(row[1] or "", row[0]))
    for doc_id, quality, bad in labels:
        good |= {doc_id} if quality == 1 else set()
        toxic |= {doc_id} if bad == 1 else set()
    fails = []
    for doc_id, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append((source or "", doc_id, {
            f for f, bad in (
                ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
                ("D", bool(re.search(r"[#$%&*|]", text))), ("E", doc_id is not None and least[text] < doc_id)) if bad}))
    out = []
    for part in {f[0] for f in fails}:
        mine, lines, total = [f for f in fails if f[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            alive = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in alive if name in f[2]]
                dead = [f for f in mine if f not in alive]
                alive = [f for f in alive if name not in f[2]]
                total[name] += len(gone)
                lines.append((name, ("".join(order), step, len(alive), len(gone), sum(name in f[2] for f in mine if f[2] & set(order[:step - 1])),
                                     sum(f[2] == {name} for f in mine), sum(f[1] in good for f in gone if f[1] is not None), sum(f[1] in toxic for f in gone if f[1] is not None))))
                del dead
        out += [(part, *line, total[name]) for name, line in lines]
    return sorted(out)


def audit_rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = []
    for _ in range(60):
        pool = words[:rng.choice([20, 300])]
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([5, 150, 250, 400])))
        text = text.upper() if rng.random() < 0.2 else text
        texts.append(text + rng.choice(["", "", " #", " |é\x0b&", " ü"]))
    texts += [rng.choice(texts) for _ in range(40)] + [None, "", None, " \t\n", "Z" * 300_000, " ".join(words * 30)]
    rows = [(i, t, rng.choice(["s0", "s0", "s1", "", None]), *EXTRA) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 110, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows + [rows[0], (None, rows[1][1], "s1", *EXTRA), (None, rows[1][1], "s1", *EXTRA)], labels


def test_audit_equals_plain_filters(spark):
    rows, labels = audit_rows()
    got = filter_audit.audit_filters(spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_of_no_rows_and_steps(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit_filters(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    masks, places = np.array([[0, 9], [9, 0], [0, 0], [9, 9]]), np.array([[1, 2], [2, 1]])
    assert filter_audit.removal_steps(masks, places).tolist() == [[1, 2], [2, 1], [1, 1], [3, 3]]


def test_a_text_of_a_third_of_all_rows_is_counted(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    out = filter_audit.audit_filters(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").first()
    assert (out.removed, out.kept) == (999, 2001)

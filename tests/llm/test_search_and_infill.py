"""Operators 11 to 13 against plain versions, and what they make of odd rows."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tillflow.llm import fill_middle, lexical, nearest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- fill in the middle ------------------------------------------------------------------------------------------------
def plain_infill(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


ODD_TEXTS = ["", None, " ", "\n\n", "a", " a", "a ", "  a  ", "ab cd\tef\r\n", "é", "é è", "日本 語\x0bx", "😀 😀", "x" * 9000, " " * 9000, "word " * 4000, "has <P> in it", "near <S miss <M P>",
             "a<", "<", "12345678", "1234567 ", " 1234567", "1234567 9", "\x85nbsp\xa0is no space here", "\x00 \x1c \x1f", "a\x08b\x0ec"]


def test_infill_equals_a_plain_version(spark):
    rows = [(i * 7 + j, t) for j, t in enumerate(ODD_TEXTS) for i in range(12)] + [(None, "one two three"), (3, "twice twice"), (3, "twice twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rate, spm in ((50, 80), (100, 50)):
        got = [tuple(r) for r in fill_middle.fill_in_middle(df, rate=rate, spm=spm).collect()]
        assert sorted(got, key=key) == sorted((plain_infill(i, t, rate=rate, spm=spm) for i, t in rows), key=key)


def test_infill_gives_back_the_text(spark, odd, nothing):
    done = fill_middle.fill_in_middle(odd, rate=100)
    back = done.select("doc_id", fill_middle.restored(done.output, done.form).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=str) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=str)
    assert fill_middle.fill_in_middle(nothing).count() == 0
    assert {r.form for r in done.collect()} == {"plain", "psm", "spm"}


def test_unit_ends_by_words_of_eight_bytes():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab \té\n"), rng.integers(0, 40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    units = fill_middle.UnitEnds(np.frombuffer(b"".join(raw), np.uint8), offs)
    want = [offs[i] + len("".join(UNIT.findall(t)[:k + 1]).encode()) for i, t in enumerate(texts) for k in range(len(UNIT.findall(t)))]
    assert list(units.after(np.arange(1, len(want) + 1))) == want
    assert list(units.before(offs)) == [sum(w <= o for w in want) for o in offs]


# ---- ranked search -----------------------------------------------------------------------------------------------------
def plain_ranking(docs, items, k=10):
    of = lambda t: TERM.findall((t or "").translate(LOWER))
    docs = [(d, of(t)) for d, t in docs]
    n_docs, total = sum(bool(u) for _, u in docs), sum(len(u) for _, u in docs)
    df = Counter(g for _, u in docs for g in set(u))
    w = {g: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for g, c in df.items()}
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for d, u in docs:
            tf, m = Counter(u), 10 + 90 * len(u) * n_docs // max(total, 1)
            score = sum(w[g] * (1_000_000_000 * tf[g] // (1000 * tf[g] + 8 * m)) for g in set(of(text)) if tf[g])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=key)


def ranked(spark, docs, items, **more):
    got = lexical.ranking(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted((tuple(r) for r in got.collect()), key=key)


VOCABULARY = ["Alpha", "beta", "GAMMA", "delta9", "éclair", "Éclair", "zeta", "日本", "x", "the", "of"]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(rng.choice(VOCABULARY, rng.integers(1, 30))) + "-") for i in range(300)]
    docs += [(400 + i, "alpha beta, same same") for i in range(30)] + [(5, "the of"), (5, "the of"), (None, "zeta zeta zeta"), (None, None), (6, ""), (7, " \n.;"), (-3, "alpha"), (900, "the " * 5000 + "alpha")]
    items = [(i, " ".join(rng.choice(VOCABULARY, rng.integers(1, 6)))) for i in range(40)] + [(50, None), (51, ""), (52, "unknownterm"), (1, "zeta alpha"), (53, "alpha"), (53, "alpha"), (None, "BETA beta")]
    return docs, items


def test_ranking_equals_a_plain_version(spark, corpus):
    assert ranked(spark, *corpus) == plain_ranking(*corpus)


def test_ranking_in_small_tiles_pieces_and_blocks(spark, corpus, monkeypatch):
    for name, value in (("DOCS", 7), ("ITEMS", 5), ("TERMS", 2), ("POSTINGS", 20)):
        monkeypatch.setattr(lexical, name, value)
    assert ranked(spark, *corpus, k=3) == plain_ranking(*corpus, k=3)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 64)
    monkeypatch.setattr("tillflow.llm.common.CHUNK", 64)
    texts = ["short one", "", "w1 w2 w3 " * 40, "é" * 150 + " tail", "x" * 500, None, "end"]
    got = {}
    for first, data, offs in lexical.pieces(pa.array(texts)):
        for i, (s, e) in enumerate(zip(offs[:-1], offs[1:])):
            got.setdefault(first + i, []).extend(TERM.findall(data[s:e].tobytes().decode()))
    assert [got.get(i, []) for i in range(len(texts))] == [TERM.findall(t or "") for t in texts]


def test_tiles_keep_sums_exact():
    impact, weight = np.array([999_999, 999_998, 1]), np.array([2**33, 2**33 - 1, 1])          # together above 2^53
    got = lexical.products(np.array([0, 0, 0]), np.array([0, 1, 2]), impact, 1, [np.array([0, 1, 2])], weight)
    assert got[0, 0] == sum(int(a) * int(b) for a, b in zip(impact, weight))


def test_ranking_of_odd_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "cat mat"), (2, "größe")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in lexical.ranking(odd, items).collect()), key=key) == plain_ranking(docs, [(1, "cat mat"), (2, "größe")])
    assert lexical.ranking(nothing, items).count() == 0 and lexical.ranking(odd, items.limit(0)).count() == 0


# ---- nearest neighbours ------------------------------------------------------------------------------------------------
def plain_nearest(rows, k=20, every=20):
    ok = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) and (i, tuple(v)) not in ok:
            ok.append((i, tuple(v)))
    out = []
    for q, a in ok:
        if q is None or q % every:
            continue
        found = []
        for c, b in ok:
            if c != q:
                s = 0.0
                for x, y in zip(a, b):
                    s += x * y
                found.append((-s, c is None, c or 0, c))
        out += [(q, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=key)


def near(spark, rows, **more):
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), **more)
    return sorted((tuple(r) for r in got.collect()), key=key)


def vectors(rng, n, d=12, spread=0.2):
    return np.float32(rng.normal(size=(6, d))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, d))).tolist()


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(vectors(rng, 150)))
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(200, rows[0][1]), (400, [0.0] * 12), (401, None), (420, [float("nan")] * 12), (440, [float("inf")] + [1.0] * 11),
                                                         (441, [None] + [1.0] * 11), (460, []), (480, [1.0, 2.0]), (None, rows[3][1]), (-20, rows[5][1]), (140, rows[7][1])]
    got = near(spark, rows)
    want = [r for r in plain_nearest([r for r in rows if not r[1] or len(r[1]) == 12])]
    assert got == want
    assert near(spark, rows[:5]) == plain_nearest(rows[:5]) and len(near(spark, rows[:1])) == 0
    assert near(spark, []) == []


def test_recall_where_the_codes_decide(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = near(spark, list(enumerate(x.tolist())), every=100, wanted=600)
    q = np.arange(0, 6000, 100)
    s = x[q].astype(float) @ x.T.astype(float)
    s[np.arange(len(q)), q] = -9
    best = np.argsort(-s, axis=1)[:, :20]
    found = {}
    for a, _, b, score in got:
        found.setdefault(a, set()).add(b)
        assert abs(score - s[a // 100, b]) < 1e-12
    assert np.mean([len(found[a] & set(best[i])) / 20 for i, a in enumerate(q)]) >= 0.9


def test_queries_with_too_few_codes_search_wider(spark, monkeypatch):
    monkeypatch.setattr(nearest, "AT_LEAST", 1)
    rows = list(enumerate(vectors(np.random.default_rng(6), 400)))
    got = near(spark, rows, wanted=1)
    assert {q: sum(r[0] == q for r in got) for q in range(0, 400, 20)} == {q: 20 for q in range(0, 400, 20)}


def test_probes_miss_no_code_within_the_radius():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (1, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((3000, 256)) < rng.random((3000, 1)) * 0.5, axis=1).view(np.uint64)
    codes = base ^ flips
    index = nearest.Index(codes)
    for radius in (0, 3, 15, 16, 31, 40, 64, 100, 200, 256):
        assert list(index.within(base[0], radius)) == list(np.flatnonzero(nearest.distances(codes, base[0]) <= radius))
        t = nearest.thresholds(radius, 16)
        assert (t + 1).sum() == radius + 1


def test_few_probes_touch_few_codes():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 2**63, (20_000, 4), dtype=np.uint64)
    index, touched = nearest.Index(codes), 0
    real = nearest.distances
    try:
        def counted(some, code):
            nonlocal touched
            touched += len(some)
            return real(some, code)
        nearest.distances = counted
        for q in codes[:50]:
            index.within(q, 20)
    finally:
        nearest.distances = real
    assert touched < 0.1 * 50 * 20_000                                     # unrelated codes are not even compared


def test_the_number_of_passes_does_not_change_the_answers(spark, monkeypatch):
    rows = list(enumerate(vectors(np.random.default_rng(10), 300)))
    once = near(spark, rows, every=5)
    monkeypatch.setattr(nearest, "GROUP", 16)
    assert near(spark, rows, every=5) == once

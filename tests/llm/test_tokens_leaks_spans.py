import random
import unicodedata
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm.bpe_automaton import automaton, decode_ids, encode_corpus
from statuta.llm.codes import window_hashes, winnowed
from statuta.llm.leakage import SuffixAutomaton, folded_places, leaks, without_leaks
from statuta.llm.queries import TOKENIZERS
from statuta.llm.shared_spans import anchors, maximal_repeats, record_pairs, row_repeats, shared_share, shared_spans

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def encoded(texts):
    ids, sizes = automaton(VOCABULARY).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab '\n\tde 资本充", max_size=80)), min_size=1, max_size=8))
def test_encode_equals_library(library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = encoded(texts)
    assert got == want
    assert [automaton(VOCABULARY).decode(i) for i in got] == texts


@needs_vocabulary
def test_encode_special_long_and_null(spark, library):
    texts = ["<|endoftext|>x", None, "", "a" * 30000, "资本" * 5000, " " * 999, "don't I'LL we've", "x\r\n\n y"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")], "doc_id long, text string, ids string")
    out = encode_corpus(df, "doc_id", "text", VOCABULARY)
    rows = [(r.doc_id, list(r.ids)) for r in out.collect()]
    assert sorted(rows) == sorted([(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)] + [(0, library.encode(texts[0], add_special_tokens=False).ids)])
    back = {r.doc_id: r.t for r in out.select("doc_id", decode_ids(out["ids"], VOCABULARY).alias("t")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).collect() == []


def folded(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if unicodedata.category(c)[0] in "LN")


def random_texts(seed, n, size, alphabet):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randrange(20, 90))) for _ in range(8)]
    return ["".join(r.choice(pool)[r.randrange(10) :] if r.random() < 0.5 else r.choice(alphabet) for _ in range(size)) for _ in range(n)]


def test_leaks_against_brute_force(spark):
    docs = [*random_texts(1, 30, 6, "abC資， "), None, "", "x" * 300, "é" * 50]
    items = [*random_texts(1, 6, 2, "abC資， "), "X" * 45, None, "é" * 45, "short"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(items)] * 2, "item_id long, text string")
    grams = defaultdict(set)
    for i, t in enumerate(items):
        f = folded(t or "")
        for k in range(len(f) - 39):
            grams[f[k : k + 40]].add(i)
    want = {(n, i) for n, t in enumerate(docs) for f in [folded(t or "")] for k in range(len(f) - 39) for i in grams.get(f[k : k + 40], ())}
    assert want
    for chars in (2_000_000, 100):
        got = leaks(d, "doc_id", "text", q, "item_id", "text", block_chars=chars)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leaks(d.limit(0), "doc_id", "text", q, "item_id", "text").collect() == []
    assert leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").collect() == []


def test_leaks_are_taken_out(spark):
    item = "The quick brown fox jumps over the lazy dog, twice a day at noon."
    docs = ["Before it. " + item.upper().replace(" ", " \n") + " After it, there is more to tell than was told before, and so on.", item, "nothing", None, "", "ｑ" + "x" * 10]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: (r.text, r.removed) for r in without_leaks(d, "doc_id", "text", q, "item_id", "text").collect()}
    assert rows[0][0] == "Before it. . After it, there is more to tell than was told before, and so on."
    assert rows[1] == ("", len(item)) and rows[2] == ("nothing", 0) and rows[3] == (None, 0) and rows[4] == ("", 0) and rows[5] == (docs[5], 0)
    clean = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id long, text string")
    assert leaks(clean, "doc_id", "text", q, "item_id", "text").collect() == []


def test_blocks_of_items_play_no_part(spark):
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    items = [letters(80) for _ in range(8)]
    # overlapping passages of two items, several of one document, copies, and one that is passages for the most part
    docs = [letters(90) + a[:60] + b[-55:] + letters(300) for a, b in zip(items, items[1:], strict=False)]
    docs += [letters(200) + a[10:70] + a[20:75] + letters(200) for a in items] + [items[0] + items[1] + letters(50), "", None, docs[0]]
    joint = letters(30)
    items += [letters(30) + joint, joint + letters(30)]
    docs += [letters(400) + items[-2] + items[-1][30:] + letters(60)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    results = [sorted((x.doc_id, x.text, x.removed) for x in without_leaks(d, "doc_id", "text", q, "item_id", "text", block_chars=c).collect()) for c in (100_000, 500, 90)]
    assert results[0] == results[1] == results[2]
    assert [x[0] for x in results[0]] == list(range(len(docs)))
    by = {x[0]: x for x in results[0]}
    # the overlap of two items goes as one passage
    assert by[len(docs) - 1][2] == 90


def test_folded_places():
    for t in ["e\u0301a", "ﬁn ㎏", "\u1100\u1161x", "资 本", "İ"]:
        codes, places = folded_places(t)
        assert "".join(map(chr, codes)) == folded(t) and len(places) == len(codes)


def test_leak_lengths():
    t = np.array([ord(c) for c in "abcdefghij" * 6])
    a = SuffixAutomaton([t], [0], 40)
    doc = np.array([ord(c) for c in "zz" + "abcdefghij" * 5 + "zz"])
    assert max(n for _, _, n in a.matches(doc)) == 50


def test_windows_and_winnowing():
    codes = np.array([ord(c) for c in "xabcabcx"], np.uint32)
    h = window_hashes(codes, 3)
    assert h[1] == h[4] and len(set(h.tolist())) == 5
    r = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64)
    picked = set(winnowed(r, 9).tolist())
    assert all(any(r[i] == r[j : j + 9].min() and i in picked for i in range(j, j + 9)) for j in range(392))


def spans_brute(docs, least):
    g = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            g[t[k : k + least]].add(i)
    return {(a, b) for s in g.values() for a in s for b in s if a < b}, g


@pytest.mark.parametrize("least,seed", [(30, 12), (12, 12)])
def test_spans_against_brute_force(spark, least, seed):
    r = random.Random(least)
    texts = [*random_texts(3, 25, 5, "abc資"), None, "", "a" * 100, "b" + "a" * 60 + "c", "ab" * 40, "zab" + "ab" * 20 + "q", "a" * 34 + "tail of it, told once more", "x" * 3 + "a" * 20 + "tail of it, told once more"]
    texts += [texts[0], texts[0], texts[3] + "!"]
    docs = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(docs)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs] + [(*docs[0], "clash")], "doc_id long, text string, rep string")
    spans, members = shared_spans(df, "doc_id", "text", least=least, seed=seed)
    want, g = spans_brute(docs, least)
    assert {(p.a, p.b) for p in record_pairs(spans, members).collect()} == want
    by = dict(docs)
    for s in spans.collect():
        for x in s.spans:
            ta, tb = by[s.rep_a], by[s.rep_b]
            assert x.length >= least and ta[x.start_a : x.start_a + x.length] == tb[x.start_b : x.start_b + x.length]
    for row in shared_share(df, "doc_id", "text", spans, members).collect():
        t = by[row.doc_id] or ""
        c = [False] * len(t)
        for k in range(len(t) - least + 1):
            if len(g[t[k : k + least]]) > 1:
                c[k : k + least] = [True] * least
        assert (row.n_chars, row.shared_chars) == (len(t), sum(c)), row.doc_id


def test_spans_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    spans, members = shared_spans(df, "doc_id", "text")
    assert record_pairs(spans, members).collect() == [] and members.collect() == []


def test_periodic_text_has_few_anchors():
    h, _ = anchors("ab" * 50_000, 120, 64)
    assert len(h) <= 8


def points(text):
    return np.array([ord(c) for c in text], np.uint32)


def repeats_of(a, b, least, seed):
    """All repeats that the anchors of two texts lead to."""
    (ha, pa), (hb, pb) = anchors(a, least, seed), anchors(b, least, seed)
    out = set()
    for h, x in zip(ha.tolist(), pa.tolist(), strict=True):
        for g, y in zip(hb.tolist(), pb.tolist(), strict=True):
            if h == g and (x[2] or y[2]):
                out |= {tuple(s) for s in row_repeats(points(a), points(b), tuple(x), tuple(y), least).tolist()}
            elif h == g:
                out |= set(maximal_repeats(points(a), points(b), np.array([x[0]]), np.array([y[0]]), least))
    return out


def covered(spans, side, n):
    c = np.zeros(n, bool)
    for s in spans:
        c[s[side] : s[side] + s[2]] = True
    return c.tolist()


def covered_brute(a, b, least):
    grams = {b[k : k + least] for k in range(len(b) - least + 1)}
    c = np.zeros(len(a), bool)
    for k in range(len(a) - least + 1):
        if a[k : k + least] in grams:
            c[k : k + least] = True
    return c.tolist()


@pytest.mark.parametrize("least,seed", [(120, 64), (30, 12), (20, 15), (12, 12)])
def test_periodic_stretches_against_brute_force(least, seed):
    r = random.Random(least)
    letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
    hits = 0
    for _ in range(150):
        period = r.randrange(1, least)
        unit = letters(period, r.choice(["ab", "abcdefgh"]))
        other = unit + letters(r.randrange(1, 3), "ab") if r.random() < 0.3 else unit
        cut = lambda u, n: (u * (n // len(u) + 2))[(k := r.randrange(len(u))) : k + n]
        edge = lambda: letters(r.randrange(0, 30), r.choice(["xy", "ab"]))
        a = edge() + cut(unit, r.randrange(least, least + period + 2)) + edge()
        b = edge() + cut(other, r.randrange(2 * least, 5 * least)) + edge() + (cut(unit, 2 * least) + edge() if r.random() < 0.3 else "")
        got = repeats_of(a, b, least, seed)
        for x, y, n in got:
            assert n >= least and a[x : x + n] == b[y : y + n]
            assert (x == 0 or y == 0 or a[x - 1] != b[y - 1]) and (x + n == len(a) or y + n == len(b) or a[x + n] != b[y + n])
        assert covered(got, 0, len(a)) == covered_brute(a, b, least)
        assert covered(got, 1, len(b)) == covered_brute(b, a, least)
        hits += bool(got)
    assert hits > 50


def test_periodic_stretches_in_records(spark):
    unit = "abcdefghijk"
    docs = ["<" + (unit * 30)[:200] + ">", "[" + (unit * 60)[3:503] + "]", "1234567" * 18 + "!", "4" + "567" + "1234567" * 17 + "?", "no part of it"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    spans, members = shared_spans(df, "doc_id", "text")
    want, _ = spans_brute(list(enumerate(docs)), 120)
    assert {(p.a, p.b) for p in record_pairs(spans, members).collect()} == want >= {(0, 1)}
    shared = {r.doc_id: r.shared_chars for r in shared_share(df, "doc_id", "text", spans, members).collect()}
    assert shared[0] == 200 and shared[1] == 500 and shared[4] == 0

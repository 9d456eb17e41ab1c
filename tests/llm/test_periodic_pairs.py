"""Pairs of texts that repeat themselves, against brute force, by way of the parts that are sent to a pair."""

import random

import numpy as np

from statuta.llm.shared_spans import anchors, laid_out, maximal_repeats, row_repeats, stretches


def points(text):
    return np.array([ord(c) for c in text], np.uint32)


def repeats(ta, tb, least, seed):
    """All repeats of two texts, of which each knows only the parts around the seeds that the other has too."""
    (ha, pa), (hb, pb) = anchors(ta, least, seed), anchors(tb, least, seed)
    both = [(tuple(x), tuple(y)) for h, x in zip(ha.tolist(), pa.tolist(), strict=True) for g, y in zip(hb.tolist(), pb.tolist(), strict=True) if h == g]

    def known(text, places, gap):
        kept = stretches([(x[0], x[1]) for x in places], len(text), seed, least)
        return laid_out([a for a, _ in kept], [text[a:b] for a, b in kept], gap)

    a, b = known(ta, {x for x, _ in both}, 0x110001), known(tb, {y for _, y in both}, 0x110002)
    out = set()
    for x, y in both:
        if x[2] or y[2]:
            out |= {tuple(s) for s in row_repeats(a, b, x, y, least).tolist()}
        else:
            out |= set(maximal_repeats(a, b, np.array([x[0]]), np.array([y[0]]), least))
    return out


def covered(spans, side, n):
    c = np.zeros(n, bool)
    for s in spans:
        c[s[side] : s[side] + s[2]] = True
    return c


def brute(a, b, least):
    grams = {b[k : k + least] for k in range(len(b) - least + 1)}
    c = np.zeros(len(a), bool)
    for k in range(len(a) - least + 1):
        if a[k : k + least] in grams:
            c[k : k + least] = True
    return c


def test_three_thousand_periodic_pairs():
    r = random.Random(8)
    letters = lambda n, of="abcdefgh": "".join(r.choice(of) for _ in range(n))
    hits = 0
    for _ in range(3000):
        period = r.randrange(1, 58)
        unit = letters(period)
        times = r.randrange(3, 41)
        a = letters(r.randrange(40), "xyz") + (unit * times)[r.randrange(period) :] + letters(r.randrange(40), "xyz")
        whole = unit * (times + 2)
        k = r.randrange(period)
        b = letters(r.randrange(40), "uvw") + whole[k : k + r.randrange(100, 160)] + letters(r.randrange(40), "uvw")
        got = repeats(a, b, 120, 64)
        want_a, want_b = brute(a, b, 120), brute(b, a, 120)
        assert (covered(got, 0, len(a)) == want_a).all() and (covered(got, 1, len(b)) == want_b).all()
        hits += bool(got)
    assert hits > 1000


def test_plain_and_periodic_parts_together():
    r = random.Random(9)
    letters = lambda n, of="abcdefgh": "".join(r.choice(of) for _ in range(n))
    notice, unit = letters(400), letters(7)
    for _ in range(40):
        parts = [lambda: notice[r.randrange(50) : r.randrange(170, 400)], lambda: unit * r.randrange(10, 60), lambda: letters(r.randrange(300))]
        a, b = ("".join(r.choice(parts)() for _ in range(6)) for _ in range(2))
        got = repeats(a, b, 120, 64)
        assert (covered(got, 0, len(a)) == brute(a, b, 120)).all() and (covered(got, 1, len(b)) == brute(b, a, 120)).all()

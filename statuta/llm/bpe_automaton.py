"""Encoding of a corpus by a byte-level BPE vocabulary, with a token automaton compiled from its merges.

States of the automaton are the last token read, arcs are labelled with tokens. At first the states
are single bytes and every arc is there. A merge ``u v -> uv`` adds its gadget: the new state ``uv``
gets the arcs that leave ``v``, every state with an arc ``u`` gets an arc ``uv``, and the arc ``v``
that leaves ``u`` goes. After all merges the paths through the automaton are exactly the token
sequences that the merges produce, so each prefix of a word has one path, found from its bytes by
table look-ups alone. Arcs are compiled when first met, by running the gadgets backwards, and kept.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how this kind of vocabulary splits a text into words before encoding.
WORDS = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Arcs that a worker keeps compiled, and words whose ids it keeps; both only save time.
ARCS, KEPT_WORDS = 1 << 21, 200_000
#: Characters of texts that a worker holds as words at a time (a longer text is one portion), which bounds its memory.
CHARS_AT_ONCE = 1 << 20
#: Bytes of different words that are encoded in one go.
BYTES_AT_ONCE = 1 << 22


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tables of the token automaton and of the byte automaton that proposes the tokens ending at a byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab: dict[str, int] = model["vocab"]
        n = max(vocab.values()) + 1
        self.labels: list[bytes] = [b""] * n
        self.born = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        tokens = [vocab[c] for c in letter]
        for c, b in letter.items():
            self.labels[vocab[c]] = bytes([b])
        pairs = np.zeros(len(merges), np.int64)
        for i, (a, b) in enumerate(merges):
            t, u, v = vocab[a + b], vocab[a], vocab[b]
            self.labels[t] = self.labels[u] + self.labels[v]
            self.born[t], self.left[t], self.right[t], pairs[i] = i, u, v, u << 32 | v
            tokens.append(t)
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.length = np.array([len(b) for b in self.labels], np.int64)
        live = np.zeros(n, bool)
        made = np.array(tokens[256:], np.int64)
        live[tokens[:256]] = True
        # A merge whose own pair is no arc when its turn comes never fires; its token is no state.
        fires = self._arc(self.left[made], self.right[made], self.born[made])
        for t, ok in zip(made.tolist(), fires.tolist(), strict=True):
            live[t] = ok and live[self.left[t]] and live[self.right[t]]
        self._bytes([t for t in tokens if live[t]])
        self.arc_key = np.full(ARCS, -1, np.int64)
        self.arc_ok = np.zeros(ARCS, bool)
        self.words: dict[str, np.ndarray] = {}

    def _arc(self, x: np.ndarray, y: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Whether the arc ``y`` leaves ``x`` after the first ``turn`` merges; the gadgets, run backwards."""
        out = np.ones(len(x), bool)
        todo = np.arange(len(x))
        x, y, turn = x.copy(), y.copy(), turn.copy()
        while len(todo):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            cut = (self.pairs[at] == key) & (self.order[at] < turn)
            bx, by = self.born[x], self.born[y]
            late_y, late_x = by > bx, bx > by
            # uv follows x if u did, unless x is u and u is v; y follows uv if it followed v; uv follows itself if u followed v.
            cut |= late_y & (x == self.left[y]) & (x == self.right[y])
            out[todo[cut]] = False
            go = ~cut & ((bx >= 0) | (by >= 0))
            todo, lx, ly, x, y, turn = todo[go], late_x[go], late_y[go], x[go], y[go], np.maximum(bx, by)[go]
            x, y = np.where(ly, x, self.right[x]), np.where(lx, y, self.left[y])
        return out

    def _bytes(self, tokens: list[int]) -> None:
        """The byte automaton: for each byte string read, the longest token it ends with, and each token's next shorter one."""
        child: dict[int, int] = {}
        parent, byte, depth, end = [0], [0], [0], {}
        for t in tokens:
            at = 0
            for d, b in enumerate(self.labels[t]):
                key = at << 8 | b
                if key not in child:
                    child[key] = len(parent)
                    parent.append(at)
                    byte.append(b)
                    depth.append(d + 1)
                at = child[key]
            end[at] = t
        n = len(parent)
        up, by, deep = np.array(parent), np.array(byte), np.array(depth)
        self.goto = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int64)
        longest = np.full(n, -1, np.int64)
        longest[list(end)] = list(end.values())
        shorter = np.full(len(self.labels), -1, np.int64)
        for d in range(int(deep.max()) + 1):
            level = np.flatnonzero(deep == d)
            if d > 1:
                fail[level] = self.goto[fail[up[level]], by[level]]
            if d:
                self.goto[level] = self.goto[fail[level]]
                own = longest[level] >= 0
                shorter[longest[level[own]]] = longest[fail[level[own]]]
                longest[level[~own]] = longest[fail[level[~own]]]
            below = np.flatnonzero((deep == d + 1))
            fail_goto = self.goto
            fail_goto[up[below], by[below]] = below
            if d == 0:
                continue
        self.longest, self.shorter = longest.astype(np.int32), shorter.astype(np.int32)

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the arc ``y`` leaves ``x``, from the compiled arcs; arcs met for the first time are compiled."""
        key = x.astype(np.int64) << 32 | y.astype(np.int64)
        h = ((key * -7046029254386353131) >> 20) & (ARCS - 1)
        ok, known = self.arc_ok[h], self.arc_key[h] == key
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            found = self._arc(new >> 32, new & 0xFFFFFFFF, np.full(len(new), len(self.pairs)))
            ok[~known] = found[back]
            at = ((new * -7046029254386353131) >> 20) & (ARCS - 1)
            # of several arcs with one place the last stays, key and answer together
            self.arc_key[at] = new
            kept = self.arc_key[at] == new
            self.arc_ok[at[kept]] = found[kept]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (not empty) words one behind another, and the number of ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        off, size = begin[order], sizes[order]
        last = np.zeros(len(data), np.int32)
        state = np.zeros(len(words), np.int32)
        going = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        for i, m in enumerate(going.tolist()):
            here = off[:m] + i
            state = self.goto[state[:m], data[here]]
            token = self.longest[state]
            start = i + 1 - self.length[token]
            inner = np.flatnonzero(start > 0)
            last[here] = token
            if len(inner):
                token, place, start, base = token[inner], here[inner], start[inner], off[inner]
                while len(token):
                    # a candidate that reaches back to the word's start needs no arc
                    ok = np.ones(len(token), bool)
                    mid = start > 0
                    ok[mid] = self.arcs(last[base[mid] + start[mid] - 1], token[mid])
                    last[place[ok]] = token[ok]
                    no = ~ok
                    token, place, base = self.shorter[token[no]], place[no], base[no]
                    start = place - base + 1 - self.length[token]
        ends = np.zeros(len(data), bool)
        at, low = off + size - 1, off
        while len(at):
            ends[at] = True
            at = at - self.length[last[at]]
            keep = at >= low
            at, low = at[keep], low[keep]
        return last[ends].astype(np.int32), np.add.reduceat(ends.astype(np.int64), begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind another, and the number of ids of each text."""
        place: dict[str, int] = {}
        split = [WORDS.findall(t) for t in texts]
        which = np.fromiter((place.setdefault(w, len(place)) for s in split for w in s), np.int64, sum(map(len, split)))
        kept = self.words
        ids: list[np.ndarray] = [kept.get(w) for w in place]  # type: ignore[misc]
        fresh = [(i, w) for i, w in enumerate(place) if ids[i] is None]
        a = 0
        while a < len(fresh):
            b, total = a, 0
            while b < len(fresh) and total < BYTES_AT_ONCE:
                total += len(fresh[b][1])
                b += 1
            flat, counts = self.encode_words([w.encode() for _, w in fresh[a:b]])
            for (i, w), x in zip(fresh[a:b], np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                ids[i] = x
                if len(w) < 12 and len(kept) < KEPT_WORDS:
                    kept[w] = x.copy()
            a = b
        sizes = np.array([len(x) for x in ids], np.int64)
        per = sizes[which]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        first = np.cumsum(sizes) - sizes
        at = np.repeat(first[which] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        words = np.array([len(s) for s in split], np.int64)
        ends = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(words)])]
        return flat[at].astype(np.int32), np.diff(ends)

    def decode(self, ids: list[int]) -> str:
        """The text whose path has the arcs ``ids``: their labels, one behind another."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


def encode_corpus(rows: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(``key``, ``ids``) of each row: the ids of ``text``, unchanged, by the vocabulary file.

    One row for each row of the input, repeated ones too; a null and an empty text give an empty
    list, a null key stays. What looks like a special token in a text is plain text. Texts may be of
    any length; other columns are ignored. ``vocabulary`` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for batch in batches:
            first, chars = 0, 0
            for i, size in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
                chars += size or 0
                if chars >= CHARS_AT_ONCE or i + 1 == len(batch):
                    part = batch.slice(first, i + 1 - first)
                    ids, sizes = a.encode([t or "" for t in part.column(1).to_pylist()])
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])
                    first, chars = i + 1, 0

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(ids: Column, vocabulary: str) -> Column:
    """The texts of lists of ids; null stays null."""

    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        a = automaton(vocabulary)
        return s.map(lambda x: None if x is None else a.decode(list(x)))

    return run(ids)

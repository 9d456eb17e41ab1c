"""Evaluation texts that leaked into training texts, found with a generalised suffix automaton."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.codes import window_hashes
from statuta.session import cut

#: Code points of the grams by which the stream enters the automaton; a match of ``least`` has one at a sampled place.
ENTRY = 16
#: Characters of test items that go into one automaton, of about 160 MB; more items make more automata, one block of items after another.
BLOCK_CHARS = 200_000
_KEPT: list[np.ndarray] = []
#: The automaton that this worker built last, by the name of its block.
_BUILT: dict[tuple[str, int], tuple[list, SuffixAutomaton]] = {}


def _letters() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    if not _KEPT:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LN"]] = True
        _KEPT.append(table)
    return _KEPT[0]


def folded(text: str) -> np.ndarray:
    """Code points of the letters and digits of ``text`` in form NFKC, lower-cased."""
    t = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[_letters()[codes]]


class SuffixAutomaton:
    """Generalised suffix automaton of several texts, with the texts that hold each string of ``least`` or more."""

    def __init__(self, texts: list[np.ndarray], names: list[int], least: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.least = least
        for t in texts:
            last = 0
            for c in t.tolist():
                last = self._extend(last, c)
        n = len(self.next)
        holds: list[set[int]] = [set() for _ in range(n)]
        for t, name in zip(texts, names, strict=True):
            v = 0
            for c in t.tolist():
                v = self.next[v][c]
                u = v
                while u > 0 and self.size[u] >= least and name not in holds[u]:
                    holds[u].add(name)
                    u = self.link[u]
        # the state of a string's last ``least`` characters: its texts are all that share so much with the string
        self.top = list(range(n))
        for v in sorted(range(1, n), key=self.size.__getitem__):
            if self.size[self.link[v]] >= least:
                self.top[v] = self.top[self.link[v]]
        self.holds = [tuple(sorted(h)) for h in holds]
        self.entry = np.unique(np.concatenate([np.zeros(0, np.uint64), *(window_hashes(t, ENTRY) for t in texts)]))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        r = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = r
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = r
            p = link[p]
        return r

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, end, length) of matches of ``least`` or more in ``codes``: of each item all ends where one is as long as it gets.

        Every ``least - ENTRY + 1``-th gram is looked up among the items' grams; a match holds one
        of those places, so the stream enters the automaton only there, starting a step before it,
        and leaves when the match falls below the entry gram past that place.
        """
        step = self.least - ENTRY + 1
        n = len(codes) - ENTRY + 1
        if len(codes) < self.least or not len(self.entry):
            return []
        h = window_hashes(codes, ENTRY)[np.arange(0, n, step)]
        at = np.minimum(np.searchsorted(self.entry, h), len(self.entry) - 1)
        hits = (np.flatnonzero(self.entry[at] == h) * step).tolist()
        out: list[tuple[int, int, int]] = []
        done = 0
        for hit in hits:
            if hit + ENTRY <= done:
                continue
            i = max(done, hit - step + 1)
            v = length = 0
            tail = codes[i:].tolist() if len(codes) - i < 4096 else None
            start = i
            while i < len(codes):
                c = tail[i - start] if tail is not None else int(codes[i])
                while v and c not in self.next[v]:
                    v = self.link[v]
                    length = self.size[v]
                if c in self.next[v]:
                    v = self.next[v][c]
                    length += 1
                i += 1
                if length >= self.least:
                    # ``v`` may hold longer strings than the match; the state of the match itself is it or above it
                    out += [(name, i, length) for name in self.holds[self.top[v]]]
                elif length < ENTRY and i >= hit + ENTRY:
                    break
            done = max(done, i - length)
        return out


def _item_blocks(items: DataFrame, item: str, item_text: str, least: int, block_chars: int) -> list[Broadcast]:
    """The test items in blocks of about ``block_chars`` characters, each sent to the tasks: names, and (number of the name, text)."""
    if least < ENTRY:
        raise ValueError(f"least must be {ENTRY} or more")
    asked = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).dropna().distinct()
    total = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    out = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        names = sorted({r.i for r in block})
        number = {x: k for k, x in enumerate(names)}
        out.append(items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, names, [(number[r.i], r.t) for r in block])))
    return out


def _automaton(shipped: Broadcast, least: int) -> tuple[list, SuffixAutomaton]:
    """Names and automaton of a block; a worker keeps its last one for the tasks that follow."""
    token, names, own = shipped.value
    if (token, least) not in _BUILT:
        _BUILT.clear()
        _BUILT[token, least] = names, SuffixAutomaton([folded(t) for _, t in own], [k for k, _ in own], least)
    return _BUILT[token, least]


def folded_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``folded``, with the place in ``text`` that each character comes from.

    A character and the marks and vowel parts that join it are folded together and count for its place.
    """
    codes, places = [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or "\u1160" <= text[j] <= "\u11ff"):
            j += 1
        own = folded(text[i:j])
        codes.append(own)
        places += [i] * len(own)
        i = j
    return np.concatenate([np.zeros(0, np.uint32), *codes]), np.array(places, np.int64)


def passages(documents: DataFrame, text: str, items: DataFrame, item: str, item_text: str, *, least: int = 40, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``digest``, ``other``, ``parts``): of each text that holds passages of test items, the (start, end) of all of them in its folded form.

    The passages are those of the text as it stands, of all blocks of items, united; texts are named by 128 bits.
    """
    texts = documents.select(F.xxhash64(text), F.xxhash64(F.lit("second"), F.col(text)), F.col(text).alias("t")).where(F.length("t") > 0)
    found = None
    for shipped in _item_blocks(items, item, item_text, least, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            _, a = _automaton(shipped, least)
            for batch in batches:
                rows, starts, ends = [], [], []
                for row, t in enumerate(batch.column(2).to_pylist()):
                    for start, end in sorted({(end - length, end) for _, end, length in a.matches(folded(t))}):
                        if rows and rows[-1] == row and start <= ends[-1]:
                            ends[-1] = max(ends[-1], end)
                        else:
                            rows.append(row)
                            starts.append(start)
                            ends.append(end)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["digest", "other", "s", "e"])

        part = texts.mapInArrow(run, "digest long, other long, s int, e int")
        found = part if found is None else found.unionByName(part)
    # a text has no more parts than its length over ``least`` for each block
    return found.distinct().groupBy("digest", "other").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("parts"))


def without_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, *, least: int = 40, coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``key``, ``text``, ``removed``) of every document, passages of test items taken out.

    A passage as in ``leaks`` goes with all that stands between its letters. The passages of all
    items are looked for in the text as it stands, united, and taken out once, so that the blocks of
    items play no part. Where they hold more than ``coverage`` of a document's folded characters, the
    whole text goes and is empty. ``removed`` is the number of characters taken out. Null texts stay
    null; one row for each row.
    """
    found = cut(passages(documents, text, items, item, item_text, least=least, block_chars=block_chars))
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("digest"), F.xxhash64(F.lit("second"), F.col(text)).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(1).to_pylist(), [0] * len(batch)
            for row, (t, parts) in enumerate(zip(texts, batch.column(2).to_pylist(), strict=True)):
                if not t or not parts:
                    continue
                codes, places = folded_places(t)
                hit = np.zeros(len(codes), bool)
                for x in parts:
                    hit[x["s"] : x["e"]] = True
                if hit.sum() > coverage * len(codes):
                    kept = ""
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    kept, last = "", 0
                    for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        kept += t[last : places[b]]
                        last = int(places[e - 1]) + 1
                    kept += t[last:]
                gone[row] = len(t) - len(kept)
                texts[row] = kept
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], ["k", "t", "removed"])

    # the findings are written and of known size: Spark sends them to the texts only if they are small enough for that
    out = rows.join(found, ["digest", "other"], "left").select("k", "t", "parts").mapInArrow(run, f"k {kind}, t string, removed int")
    return out.select(F.col("k").alias(key), F.col("t").alias("text"), "removed")


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, *, least: int = 40, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``key``, ``item``, ``longest``, ``covered``) for each document and test item that share a passage.

    Both texts are folded: form NFKC, lower-cased, letters and digits only. A passage is a run of at
    least ``least`` folded characters that both have. ``longest`` is its length where it is longest,
    ``covered`` how many of the document's folded characters lie in passages of that item. Null keys
    and null or shorter texts give nothing; repeated rows of a table give one row; an empty table
    gives an empty result; other columns are ignored, also where the tables' names clash.

    Test items are a stated query set: they are held against all documents in blocks of at most
    ``block_chars`` characters, one automaton each, so what is broadcast has that bound (a single
    longer item makes a block of its own).
    """
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    texts = documents.select(F.col(key), F.col(text).alias("t")).dropna().where(F.length("t") > 0)
    parts = []
    for shipped in _item_blocks(items, item, item_text, least, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, a = _automaton(shipped, least)
            for batch in batches:
                where, which, longest, covered = [], [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    best: dict[int, list[int]] = {}
                    for name, end, length in a.matches(folded(t)):
                        x = best.setdefault(name, [0, 0, 0])
                        x[0] = max(x[0], length)
                        x[1] += end - max(x[2], end - length)
                        x[2] = end
                    for name, x in best.items():
                        where.append(row)
                        which.append(names[name])
                        longest.append(x[0])
                        covered.append(x[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(which, type=item_type), pa.array(longest, pa.int32()), pa.array(covered, pa.int32())], ["doc", "item", "longest", "covered"])

        parts.append(texts.mapInArrow(run, f"doc {kind}, item {item_kind}, longest int, covered int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(F.col("doc").alias(key), F.col("item").alias(item)).agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))

"""Noise in texts from scanned pages: found by labelling lines, and repaired into readable paragraphs."""

from __future__ import annotations

import bisect
import marshal
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.scan_lines import BODY, BREAK, DIGIT_LOOKS, MARKS, NUMBER, RUNNING, TITLE, divides, labelled, observations, trained_on, written
from statuta.session import cut, small_enough

_WORD = re.compile(r"[A-Za-z0-9]*[a-z][A-Za-z0-9]*")
_COMPOUND = re.compile(r"[A-Za-z]+-[a-z]+")
# Letters that stand for digits within a number.
_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?=[lIiOoSBZ.]*[0-9])(?=[0-9.]*[lIiOoSBZ])[0-9lIiOoSBZ]+(?:\.[0-9lIiOoSBZ]+)?(?![A-Za-z0-9])|(?<=[一-鿿])[lIOSBZ]{1,2}(?=[一-鿿%])")
# Pairs of letters that are read as one, and the other way round.
PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"))
#: A character is taken for misread where another one is this many times as frequent in the same surroundings.
TIMES = 8
#: How often a character must stand in surroundings to be the usual one there, and which share of all places a usual character must have.
USUAL, LEAST_MASS = 20, 2e-4
#: Different surroundings, or words, in which a confusion must be met before it counts as one.
SEEN = 3
#: Letters of a word that is judged; in words of one letter every letter would be off by one. Words of more than the second meet by their ends.
LEAST_WORD, MOST_WORD = 2, 40
#: How often a word must occur to be a usual one, and how many times as often as one that is misread for it.
OFTEN = 15
_LATIN, _IDEOGRAPH = re.compile(r"[A-Za-z]"), re.compile(r"[㐀-鿿豈-﫿]")
#: Context counts that a task gathers before it adds them up.
HELD = 6_000_000

FINDINGS = "body binary, noise string, page int, line int, place int, w string, k long, c int, n long"
_FINDINGS = pa.schema([("body", pa.binary()), ("noise", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("place", pa.int32()), ("w", pa.string()), ("k", pa.int64()), ("c", pa.int32()), ("n", pa.int64())])


def _pages(value: list | None) -> tuple[list[int], list[list[str]]]:
    value = [p for p in value or [] if p is not None]
    return [-1 if p["page_num"] is None else p["page_num"] for p in value], [(p["text"] or "").split("\n") for p in value]


class Body:
    """The body of a file as one text: where each of its lines starts, which lines end a paragraph, and which words line ends divide."""

    def __init__(self, pages: list[int], where: list[tuple[int, int]], lines: list[str], states: list[int]):
        own = [i for i, y in enumerate(states) if y in (BODY, BREAK, TITLE)]
        texts = [lines[i] for i in own]
        self.pages, self.numbers = [pages[where[i][0]] for i in own], [where[i][1] + 1 for i in own]
        #: the title that opens the file is part of the text, but no line to look for noise in
        self.titles = [k for k, i in enumerate(own) if states[i] == TITLE]
        #: lines that end their paragraph
        self.breaks = [k for k, i in enumerate(own) if states[i] == BREAK]
        # lines that meet are joined with a blank where more letters than ideographs stand in them
        western = [len(_LATIN.findall(t)) - len(_IDEOGRAPH.findall(t)) for t in texts]
        parts, starts, at = [], [], 0
        #: line, what stands before and behind the mark, and the mark
        self.divided: list[tuple[int, str, str, str]] = []
        for i, t in enumerate(texts):
            following = texts[i + 1] if i + 1 < len(texts) else ""
            if following and states[own[i]] == BODY and (d := divides(t, following)):
                self.divided.append((i, *d))
                t = t[:-1]
            elif following and western[i] + western[i + 1] > 0:
                t += " "
            starts.append(at)
            parts.append(t)
            at += len(t)
        self.starts = starts
        self.text = "".join(parts)

    def line_of(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place) - 1

    def packed(self) -> bytes:
        return zlib.compress(marshal.dumps((self.text, self.starts, self.pages, self.numbers, self.titles, self.breaks)), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Body:
        own = cls.__new__(cls)
        own.text, own.starts, own.pages, own.numbers, own.titles, own.breaks = marshal.loads(zlib.decompress(data))
        own.divided = []
        return own


def _table(columns: dict[str, list | np.ndarray], n: int) -> list[pa.Array]:
    return [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FINDINGS]


def findings(files: DataFrame, key: str, title: str, pages: str) -> DataFrame:
    """One reading of all files: their bodies, the noise that a file shows by itself, and counts for the rest.

    Rows are of four kinds. ``body``: the packed body of the file ``key``. ``noise``: a line labelled
    ``running`` or ``page_no``, a ``number`` with a letter in it, or a word ``divided`` at a line's
    end, with their ``place`` in the body and the word ``w`` or its repair. ``w`` and ``n`` without ``noise``:
    how often a word stands in the bodies of one task. ``k``, ``c`` and ``n``: how often character
    ``c`` stands in surroundings ``k`` in the bodies of one task.

    The hidden Markov model of the lines is trained on the lines of all files, which then are labelled by it.
    """
    kind = files.schema[key].dataType.simpleString()
    page = "array<struct<page_num:int,text:string>>"
    rows = files.select(F.col(key).alias("k"), F.col(title).cast("string"), F.col(pages).cast(page).alias("p")).where(F.col("k").isNotNull())

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [observations(_pages(p)[1], t or "")[2] for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.astype(np.int16) for s in seqs], pa.list_(pa.int16()))], ["k", "p", "symbols"])

    seen = cut(rows.mapInArrow(symbols, f"k {kind}, p {page}, symbols array<short>"))
    model = trained_on(seen)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[np.ndarray] = []
        words: Counter[str] = Counter()
        kind = pa.int64()

        def counted() -> Iterator[pa.RecordBatch]:
            both, n = np.unique(np.concatenate([np.zeros(0, np.int64), *contexts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), kind), *_table({"k": both >> 16, "c": both & 0xFFFF, "n": n}, len(n))], [key, *_FINDINGS.names])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), kind), *_table({"w": list(words), "n": list(words.values())}, len(words))], [key, *_FINDINGS.names])

        for batch in batches:
            keys, kind = batch.column(0), batch.column(0).type
            seqs = [np.array(x or [], np.int64) for x in batch.column(2).to_pylist()]
            states = [y.tolist() for y in labelled(seqs, model)]
            files = [(numbers, *written(own)) for numbers, own in map(_pages, batch.column(1).to_pylist())]
            bodies, owner = [], []
            out: dict[str, list] = {x: [] for x in ("noise", "page", "line", "place", "w")}

            def put(row: int, *values: object) -> None:
                owner.append(row)  # noqa: B023
                for col, v in zip(out.values(), values, strict=True):  # noqa: B023
                    col.append(v)

            for row, ((numbers, where, lines), ys) in enumerate(zip(files, states, strict=True)):
                for (p, i), y in zip(where, ys, strict=True):
                    if y in (RUNNING, NUMBER):
                        put(row, "page_no" if y == NUMBER else "running", numbers[p], i + 1, None, None)
                b = Body(numbers, where, lines, ys)
                bodies.append(b)
                for i, x, y, mark in b.divided:
                    put(row, "divided", b.pages[i], b.numbers[i], b.starts[i + 1], f"{x}{mark}{y}")
                    words[(x + y).lower()] -= 1
                for m in _NUMBER.finditer(b.text):
                    for j, ch in enumerate(m.group()):
                        if ch.isalpha() and (i := b.line_of(m.start() + j)) not in b.titles:
                            put(row, "number", b.pages[i], b.numbers[i], m.start() + j, ch.translate(DIGIT_LOOKS))
                words.update(map(str.lower, _WORD.findall(b.text)))
                words.update(map(str.lower, _COMPOUND.findall(b.text)))
            _, k, c = context_keys(_points("\n\n".join(b.text for b in bodies)))
            contexts.append((k << 16) | c)
            yield pa.RecordBatch.from_arrays([keys, *_table({"body": [b.packed() for b in bodies]}, len(keys))], [key, *_FINDINGS.names])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), *_table(out, len(owner))], [key, *_FINDINGS.names])
            if sum(map(len, contexts)) > HELD or len(words) > HELD // 10:
                yield from counted()
                contexts, words = [], Counter()
        if contexts:
            yield from counted()

    return cut(seen.mapInArrow(read, f"`{key}` {kind}, {FINDINGS}"))


def context_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, surroundings and character of each ideograph: two characters before, one to either side, two behind."""
    c = codes.astype(np.int64)
    c = np.where(c > 0xFFFF, 0xFFFD, c)
    at = np.flatnonzero(((c >= 0x3400) & (c <= 0x4DBF)) | ((c >= 0x4E00) & (c <= 0x9FFF)) | ((c >= 0xF900) & (c <= 0xFAFF)))
    p = np.concatenate([[0, 0], c, [0, 0]])
    i = at + 2
    keys = [(0 << 32) | (p[i - 2] << 16) | p[i - 1], (1 << 32) | (p[i - 1] << 16) | p[i + 1], (2 << 32) | (p[i + 1] << 16) | p[i + 2]]
    return np.tile(at, 3), np.concatenate(keys), np.tile(c[at], 3)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def confused_characters(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confusions learned from all bodies: (``c``, ``y``, ``pure``) and the surroundings (``k``, ``c``, ``y``) that show them.

    A character ``c`` is shown to stand for ``y`` by surroundings where ``y`` is ``TIMES`` as
    frequent. A confusion is taken for one if at least half of the places of ``c`` (``pure``) are
    shown so, in several surroundings; or, as ``c`` may be right elsewhere, if ``c`` turns up
    wherever ``y`` is usual: a misreading comes with ``y`` itself, another word only in some of its
    surroundings. The second is measured for each kind of surroundings by the share of the places
    of ``y`` that lie where ``c`` is met too. Surroundings with a null ``y`` are those where ``c``
    itself is usual; they speak against a misreading.
    """
    # one shuffle by surroundings serves the sum and the comparison within them
    summed = counts.repartition("k").groupBy("k", "c").agg(F.sum("n").alias("n"))
    inside = W.partitionBy("k")
    judged = summed.withColumn("top", F.max("n").over(inside)).withColumn("y", F.max_by("c", F.struct("n", "c")).over(inside))
    judged = cut(judged.where(f"top >= {SEEN}").withColumn("side", F.expr("cast(shiftright(k, 32) as int)")))
    total = counts.where("shiftright(k, 32) = 1").groupBy("c").agg(F.sum("n").alias("all"))
    sides = lambda name: [F.sum(F.when((F.col("side") == i) & (F.col("top") >= USUAL), F.col("top")).otherwise(0)).alias(f"{name}{i}") for i in range(3)]
    mass = judged.where("c = y").groupBy("y").agg(*sides("mass"))
    shown = judged.where(f"c <> y and top >= {TIMES} * n")
    pairs = shown.groupBy("c", "y").agg(F.count("*").alias("every"), F.count(F.when(F.col("side") == 1, 1)).alias("m"), F.sum("n").alias("n"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("shown"), *sides("with"))
    pairs = pairs.join(total, "c").join(mass, "y").crossJoin(F.broadcast(total.agg(F.sum("all").alias("places"))))  # one row
    share = F.array_sort(F.array(*[F.col(f"with{i}") / F.greatest(F.lit(1), F.col(f"mass{i}")) for i in range(3)]))
    pairs = pairs.withColumn("pure", F.col("shown") / F.col("all")).withColumn("share", share)
    rare = f"pure >= 0.5 and m >= {SEEN} and every >= {2 * SEEN}"
    mixed = f"n >= {2 * SEEN} and share[1] >= 0.45 and share[2] >= 0.9 and greatest(mass0, mass1, mass2) >= {LEAST_MASS} * places"
    pairs = cut(pairs.where(f"{rare} or {mixed}").select("c", "y", "pure"))
    mine = judged.join(pairs.select("c").distinct(), "c", "left_semi")
    against = mine.where(f"c = y and n >= {SEEN}").select("k", "c", F.lit(None).cast("int").alias("y"))
    return pairs, cut(mine.where(f"c <> y and top >= {TIMES} * n").join(pairs, ["c", "y"]).select("k", "c", "y").unionByName(against))


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("change", T.StringType())]))
def _one_change(w: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Where ``w`` has another letter than ``right``, or one of ``PAIRS`` for the other; null if they differ otherwise."""

    def one(a: str, b: str) -> tuple[int | None, str | None]:
        p = len(os.path.commonprefix([a, b]))
        q = len(os.path.commonprefix([a[p:][::-1], b[p:][::-1]]))
        x, y = a[p : len(a) - q], b[p : len(b) - q]
        return (p, f"{x}>{y}") if len(x) == len(y) == 1 or (x, y) in PAIRS or (y, x) in PAIRS else (None, None)

    return pd.DataFrame([one(a, b) for a, b in zip(w, right, strict=True)], columns=["at", "change"])


def _confused_long_words(known: DataFrame) -> DataFrame:
    """(``w``, ``right``, ``at``, ``change``, ``top``) as in ``confused_words``, for long words, without a form for each of their letters.

    A change of one place leaves the first or the last third as it is, by which rare and frequent words meet.
    """
    third = lambda n: F.floor(n / 3).cast("int")
    ends = lambda n: F.array(F.struct(F.lit("l").alias("side"), F.substring("w", F.lit(1), n).alias("part")), F.struct(F.lit("r").alias("side"), F.substring("w", -n, n).alias("part")))
    size = F.length("w")
    usual = known.where(F.col("n") >= OFTEN).select(F.col("w").alias("right"), F.col("n").alias("top"), F.explode(ends(third(size))).alias("e"))
    rare = known.select("w", "n", F.explode(F.array_distinct(F.concat(*[ends(third(size + d)) for d in (-1, 0, 1)]))).alias("e"))
    met = rare.join(usual, "e").where(f"right <> w and top >= {OFTEN} * n and abs(length(w) - length(right)) <= 1").select("w", "right", "top").distinct()
    return met.withColumn("x", _one_change("w", "right")).where("x.change is not null").select("w", "right", "x.at", "x.change", "top")


def confused_words(words: DataFrame, divided: DataFrame) -> DataFrame:
    """(``w``, ``right``, ``at``): rare words, the frequent word each stands for, and where they differ first.

    Words meet through what is left when one letter is blotted out, or when a pair of letters is
    read as one; the change must be met in ``SEEN`` different words. Words of one letter are not
    judged, and short numbers with a letter in them are left to the numbers.
    """
    # words that line ends divide may be misread, but tell nothing about what is usual
    more = divided.select(F.lower(F.regexp_replace("w", f"[{MARKS}]", "")).alias("w"), F.lit(0).cast("long").alias("n"))
    known = words.unionByName(more).groupBy("w").agg(F.greatest(F.lit(1), F.sum("n")).alias("n")).where((F.length("w") >= LEAST_WORD) & ~F.col("w").contains("-"))
    longer = _confused_long_words(known.where(F.length("w") > MOST_WORD))
    known = known.where(F.length("w") <= MOST_WORD).where("length(w) > 3 or not w rlike '^[lio]*[0-9][0-9lio]*$'")

    def changed(i: Column, size: int, put: str) -> Column:
        return F.concat(F.substring("w", F.lit(1), i - 1), F.lit(put), F.substring("w", i + size, F.lit(64)))

    def option(at: Column, form: Column, letter: Column, right: Column) -> Column:
        return F.struct((at - 1).alias("at"), form.alias("form"), letter.alias("letter"), right.alias("right"))

    def as_read(right: str, wrong: str) -> Column:
        """The word with ``right`` read as ``wrong``, for each place where it stands."""
        here = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.when(F.substring("w", i, F.lit(len(right))) == right, option(i, changed(i, len(right), wrong), F.lit(f"{wrong}>{right}"), F.lit(True))))
        return F.filter(here, lambda v: v.isNotNull())

    blots = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: option(i, changed(i, 1, "*"), F.substring("w", i, F.lit(1)), F.lit(False)))
    itself = F.array(option(F.lit(1), F.col("w"), F.lit(""), F.lit(False)))
    pairs = F.concat(*[as_read(*p) for a, b in PAIRS for p in ((a, b), (b, a))])
    forms = known.select("w", "n", F.explode(F.concat(blots, itself, F.when(F.col("n") >= OFTEN, pairs).otherwise(F.slice(itself, 1, 0)))).alias("v")).select("w", "n", "v.*")
    usual = F.when((F.col("n") >= OFTEN) & (F.col("right") | F.contains("form", F.lit("*"))), F.struct("n", "w", "letter", "at"))
    best = F.max(usual).over(W.partitionBy("form"))
    met = forms.withColumn("b", best).where(f"not right and b is not null and b.w <> w and b.n >= {OFTEN} * n")
    change = F.when(F.contains("form", F.lit("*")), F.concat("letter", F.lit(">"), F.col("b.letter"))).otherwise(F.col("b.letter"))
    both = met.select("w", F.col("b.w").alias("right"), F.col("b.at").alias("at"), change.alias("change"), F.col("b.n").alias("top"))
    both = cut(both.unionByName(longer))
    common = both.groupBy("change").agg(F.count_distinct("w").alias("m")).where(f"m >= {SEEN}")
    found = both.join(common, "change")
    return found.groupBy("w").agg(F.max_by(F.struct("right", "at"), F.struct("m", "top", "right")).alias("b")).select("w", "b.right", "b.at")


SUSPECT = "kind string, page int, line int, place int, w string, k array<long>, c int, lo int, hi int"
_SUSPECT = pa.schema([("kind", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("place", pa.int32()), ("w", pa.string()), ("k", pa.list_(pa.int64())), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def suspects(bodies: DataFrame, key: str, chars: list[int], hints: set[int] | None, words: set[str] | None) -> DataFrame:
    """Places of the bodies to be judged: those of ``chars`` with their surroundings, and ``words`` (null: all words).

    Of the characters only those come that surroundings in ``hints`` (null: any) speak for, or that are never right.

    A word that stands on two lines comes for each, with the part ``lo`` to ``hi`` that is there.
    """
    kind = bodies.schema[key].dataType.simpleString()
    wanted = np.zeros(0x110000, bool)
    wanted[chars] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            cols: list[list] = [[] for _ in _SUSPECT]

            def put(row: int, *values: object) -> None:
                owner.append(row)  # noqa: B023
                for col, v in zip(cols, values, strict=True):  # noqa: B023
                    col.append(v)

            for row, data in enumerate(batch.column(1).to_pylist()):
                b = Body.unpacked(data)
                text, starts = b.text, [*b.starts, len(b.text)]
                for m in _WORD.finditer(text):
                    w = m.group().lower()
                    if len(w) >= LEAST_WORD and (words is None or w in words):
                        for i in range(b.line_of(m.start()), b.line_of(m.end() - 1) + 1):
                            if i not in b.titles:
                                put(row, "word", b.pages[i], b.numbers[i], m.start(), w, None, None, max(0, starts[i] - m.start()), min(m.end(), starts[i + 1]) - m.start())
                if chars:
                    codes = _points(text)
                    at = np.flatnonzero(wanted[codes])
                    p = np.concatenate([[0, 0], np.where(codes > 0xFFFF, 0xFFFD, codes), [0, 0]]).astype(np.int64)
                    for i, around in zip(at.tolist(), np.stack([p[at + d] for d in range(5)], 1).tolist(), strict=True):
                        a2, a1, c, b1, b2 = around
                        k = [a2 << 16 | a1, 1 << 32 | a1 << 16 | b1, 2 << 32 | b1 << 16 | b2]
                        if hints is None or -c in hints or any((x << 16 | c) in hints for x in k):
                            line = b.line_of(i)
                            if line not in b.titles:
                                put(row, "char", b.pages[line], b.numbers[line], i, None, k, c, 0, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(col, f.type) for col, f in zip(cols, _SUSPECT, strict=True))], [key, *_SUSPECT.names])

    return bodies.mapInArrow(run, f"`{key}` {kind}, {SUSPECT}")


#: Surroundings that speak for a misreading and are sent to all tasks; where there are more, all places of the characters are judged.
HINTS_AT_MOST = 500_000
#: Misread words that are sent to all tasks; where there are more, all words meet them in a join.
WORDS_AT_MOST = 200_000


def scan_noise(files: DataFrame, key: str, title: str, pages: str) -> tuple[DataFrame, DataFrame]:
    """Noise of scanned files, and their bodies (``key``, packed ``body``) that it was found in.

    First result: ``key``, ``page``, ``line``, ``noise`` and for ``misread`` and ``broken`` also
    ``place`` (in the file's body text, see ``Body``) and ``repair``. ``noise`` is ``running`` or
    ``page_no`` for lines that the line model labels so, ``broken`` for a body line whose last word
    goes on in the next body line behind a mark that isn't the word's own, and ``misread`` for each
    wrong character of a body line. Lines count from 1 within a page, blank ones included.

    Files without pages, with null pages or texts have no noise; null keys are left out; a file that
    comes twice counts twice, also under one key; other columns are ignored. Statistics of
    characters and words are taken over all bodies; the order of the files plays no part.
    """
    read = findings(files, key, title, pages)
    bodies = read.where("body is not null").select(key, "body")
    pairs, shown = confused_characters(read.where("k is not null").select("k", "c", "n"))
    # no more entries than there are ideographs
    never = {r.c for r in pairs.groupBy("c").agg(F.sum("pure").alias("all")).where("all >= 0.8").select("c").collect()}
    chars = sorted(r.c for r in pairs.select("c").distinct().collect())
    speak = shown.where("y is not null").select(F.expr("k * 65536 + c").alias("h"))
    hints = {r.h for r in speak.collect()} | {-c for c in never} if small_enough(speak, HINTS_AT_MOST) else None
    words = cut(read.where("w is not null and noise is null").groupBy("w").agg(F.sum("n").alias("n")).where("n > 0"))
    bad = cut(confused_words(words, read.where("noise = 'divided'")))
    few = {r.w for r in bad.select("w").collect()} if small_enough(bad, WORDS_AT_MOST) else None
    places = cut(suspects(bodies, key, chars, hints, few))
    spot = [key, "page", "line", "place"]
    same = lambda noise, repair: [*spot, F.lit(noise).alias("noise"), repair.alias("repair")]
    plain = read.where("noise in ('running', 'page_no')").select(*spot, "noise", F.col("w").alias("repair"))
    number = read.where("noise = 'number'").select(*same("misread", F.col("w")))
    word = places.where("kind = 'word'").join(bad, "w").where("at >= lo and at < hi").select(*same("misread", F.col("right")))
    divided = read.where("noise = 'divided'").select(*spot, F.lower(F.regexp_replace("w", f"[{MARKS}]", "-")).alias("x")).withColumn("z", F.regexp_replace("x", "-", ""))
    counted = lambda name: words.select(F.col("w").alias(name), F.col("n").alias(f"n{name}"))
    broken = divided.join(counted("x"), "x", "left").join(counted("z"), "z", "left").where("nx is null or nz > nx").select(*same("broken", F.col("z")))
    char = places.where("kind = 'char'")
    voted = char.select(*spot, "c", F.explode("k").alias("k")).join(shown, ["k", "c"])
    # for and against, in one pass over the places
    against = F.max(F.col("y").isNull().cast("int")).over(W.partitionBy(*spot))
    voted = voted.withColumn("against", against).where("against = 0").groupBy(*spot, "c", "y").agg(F.count("*").alias("votes")).join(pairs, ["c", "y"]).where("votes >= 2 or pure >= 0.5")
    always = pairs.groupBy("c").agg(F.sum("pure").alias("all"), F.max_by("y", F.struct("pure", "y")).alias("y")).where("all >= 0.8").select("c", "y")
    rest = char.select(*spot, "c").join(always, "c").select(*spot, "y", F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("pure"))
    best = voted.select(*spot, "y", "votes", "pure").unionByName(rest).groupBy(*spot).agg(F.max_by("y", F.struct("votes", "pure", "y")).alias("y"))
    misread = best.select(*same("misread", F.expr("decode(unhex(lpad(hex(y), 4, '0')), 'UTF-16BE')")))
    out = plain
    for part in (number, word, broken, misread):
        out = out.unionByName(part)
    return out, bodies


def repaired(body: Body, repairs: list[tuple[int, str]]) -> list[str]:
    """The paragraphs of a body, in reading order, with the characters and words at the given places put right."""
    text, starts = body.text, [*body.starts, len(body.text)]
    ends = {*body.titles, *body.breaks}
    cuts = [starts[i] for i in range(len(body.starts)) if i == 0 or i in body.titles or i - 1 in ends]
    edges = [*cuts, len(text)]
    by_place = dict(repairs)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        piece = text[a:b]
        for place in sorted((p for p in by_place if a <= p < b), reverse=True):
            right, at = by_place[place], place - a
            old = m.group() if len(right) > 1 and (m := _WORD.match(text, place)) else text[place]
            piece = piece[:at] + (right.capitalize() if old[0].isupper() and len(right) > 1 else right) + piece[at + len(old) :]
        if piece.strip():
            out.append(piece.strip())
    return out


def paragraphs(files: DataFrame, key: str, title: str, pages: str) -> DataFrame:
    """(``key``, ``paragraph``, ``text``): the continuous text of each file, noise repaired.

    Headers, footers and page numbers are left out, divided words joined, misread characters put
    right, and lines put together into paragraphs, which go on over pages. The keys must be unique.
    Files without body text give no rows.
    """
    noise, bodies = scan_noise(files, key, title, pages)
    fixes = noise.where("noise = 'misread' and repair is not null").select(key, F.struct("place", "repair").alias("r")).distinct().groupBy(key).agg(F.collect_list("r").alias("repairs"))
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [repaired(Body.unpacked(b), [(r["place"], r["repair"]) for r in rs or []]) for b, rs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], [key, "texts"])

    whole = bodies.join(fixes, key, "left").select(key, "body", "repairs").mapInArrow(run, f"`{key}` {kind}, texts array<string>")
    return whole.select(key, F.posexplode("texts").alias("paragraph", "text"))

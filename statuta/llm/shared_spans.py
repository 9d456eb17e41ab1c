"""Spans that stand verbatim in more than one record: seed by winnowed anchors, extend, keep maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.llm.codes import window_hashes, winnowed
from statuta.session import cut

#: Code points of one seed. A span of ``least`` holds ``least - SEED + 1`` seeds, the window of the winnowing.
SEED = 64
#: Records of one block of a seed's list; longer lists are joined block by block.
BLOCK = 256
#: A row of seeds is sent as one number: its reach, and its step in so many bits.
STEP_BITS = 24
STEP_MASK = (1 << STEP_BITS) - 1
#: Code points of neighbouring short texts that are hashed together.
CHUNK = 1 << 21


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(text: str, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds that winnowing picks, and where they are; every shared span of ``least`` has one at the same place.

    Places are (first, reach, step). A seed that comes back at equal distances of no more than its
    length, as in a text that repeats itself, is one row: it stands at ``first``, ``first + step``
    and so on to ``first + reach``. Any other seed has a reach and step of 0.
    """
    w = least - seed + 1
    codes = _points(text)
    hashes, places = [], []
    step = CHUNK
    for a in range(0, max(1, len(codes) - least + 1), step):
        h = window_hashes(codes[a : a + step + least - 1], seed)
        p = winnowed(h, w)
        hashes.append(h[p])
        places.append(p + a)
    h, p = np.concatenate(hashes), np.concatenate(places)
    order = np.lexsort((p, h))
    h, p = h[order], p[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])]) if len(h) else np.zeros(0, bool)
    h, p = h[fresh], p[fresh]
    gap = np.where((h[1:] == h[:-1]) & (p[1:] - p[:-1] <= seed), p[1:] - p[:-1], 0)
    edge = np.flatnonzero(np.concatenate([[True], gap[1:] != gap[:-1], [True]])) if len(gap) else np.zeros(1, np.int64)
    first, last = edge[:-1], edge[1:]
    row = (gap[first] > 0) & (last - first > 1) if len(gap) else np.zeros(0, bool)
    first, last = first[row], last[row]
    inside = np.zeros(len(h) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    alone = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    places = np.zeros((len(alone) + len(first), 3), np.int64)
    places[: len(alone), 0] = p[alone]
    places[len(alone) :] = np.stack([p[first], p[last] - p[first], gap[first] if len(gap) else first], 1)
    return np.concatenate([h[alone], h[first]]), places


def maximal_repeats(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in ``a``, start in ``b``, length) of each repeat of ``least`` or more that covers one of the anchors.

    On the diagonal of an anchor the first difference to either side ends the match.
    """
    out: list[tuple[int, int, int]] = []
    for d in np.unique(at_a - at_b).tolist():
        low, high = max(0, d), min(len(a), len(b) + d)
        differs = np.flatnonzero(a[low:high] != b[low - d : high - d]) + low
        edges = np.concatenate([[low - 1], differs, [high]])
        k = np.unique(np.searchsorted(edges, at_a[at_a - at_b == d], "right"))
        k = k[(k > 0) & (k < len(edges))]
        start, end = edges[k - 1] + 1, edges[k]
        long = end - start >= least
        out += [(s, s - d, e - s) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def _stretch(codes: np.ndarray, at: int, step: int) -> tuple[int, int]:
    """Start and end of the part around ``at`` that repeats itself every ``step``."""
    breaks = np.flatnonzero(codes[:-step] != codes[step:])
    i = np.searchsorted(breaks, at)
    return (int(breaks[i - 1]) + 1 if i else 0), (int(breaks[i]) + step if i < len(breaks) else len(codes))


def _around(a: np.ndarray, b: np.ndarray, x: int, y: int) -> tuple[int, int, int]:
    """The match that holds the equal places ``x`` of ``a`` and ``y`` of ``b``."""

    def same(u: np.ndarray, v: np.ndarray) -> int:
        n, have, size = min(len(u), len(v)), 0, 256
        while have < n:
            differs = np.flatnonzero(u[have : min(n, have + size)] != v[have : min(n, have + size)])
            if len(differs):
                return have + int(differs[0])
            have, size = have + size, 2 * size
        return n

    back = same(a[:x][::-1], b[:y][::-1])
    return x - back, y - back, back + same(a[x:], b[y:])


def row_repeats(a: np.ndarray, b: np.ndarray, row_a: tuple[int, int, int], row_b: tuple[int, int, int], least: int) -> np.ndarray:
    """As ``maximal_repeats``, for two rows (first, reach, step) of one seed, at least one of them with a step.

    Rows of one step lie in stretches of that period, and meet on one diagonal for each whole
    period. Their common part ends with the stretch that ends first; only where both stretches
    begin, or end, together may the match go on. Rows of different steps have no two places of the
    seed in common unless at an end of a row, so that a match at an inner place doesn't go beyond
    the neighbouring ones: it is the same at every inner place, and one of them stands for all on the other side.
    """
    (fa, ra, sa), (fb, rb, sb) = row_a, row_b
    if sa == sb:
        (pa_, qa), (pb, qb) = _stretch(a, fa, sa), _stretch(b, fb, sb)
        d = np.arange(fa - fb - rb, fa + ra - fb + 1, sa)
        start, end = np.maximum(pa_, pb + d), np.minimum(qa, qb + d)
        open_ = (d == pa_ - pb) | (d == qa - qb)
        keep = ~open_ & (end - start >= least)
        out = [np.stack([start, start - d, end - start], 1)[keep]]
        more = [_around(a, b, int(s), int(s - e)) for s, e in zip(np.maximum(fa, fb + d)[open_], d[open_], strict=True)]
    else:
        xs, ys = (list(range(f, f + r + 1, s)) if s else [f] for f, r, s in (row_a, row_b))
        ends = lambda v: {v[0], v[min(1, len(v) - 1)], v[-1]}
        met = {(x, y) for x in ends(xs) for y in ys} | {(x, y) for x in xs for y in ends(ys)}
        out, more = [], [_around(a, b, x, y) for x, y in met]
    return np.concatenate([*out, np.array([m for m in more if m[2] >= least], np.int64).reshape(-1, 3)])


def classes(records: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(``id``, ``rep``, ``digest``) of each record with a text of ``least`` or more: ``rep`` is the least id with that very text.

    Texts are told apart by 128 bits; ``digest`` is half of them.
    """
    digests = (F.xxhash64(text).alias("digest"), F.xxhash64(F.lit("second"), F.col(text)).alias("other"))
    long = records.where(F.length(text) >= least).select(F.col(key).alias("id"), *digests).dropna().distinct()
    return long.join(long.groupBy("digest", "other").agg(F.min("id").alias("rep")), ["digest", "other"]).select("id", "rep", "digest")


def stretches(places: list[tuple[int, int]], size: int, seed: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text in which a repeat of ``least`` around one of its seeds can lie.

    ``places``: (first, reach) of the seeds. Each part of ``least`` of a repeat holds a seed of it, and
    so lies within ``least - seed`` before and behind that seed; what lies between the parts takes no part in any repeat.
    """
    out: list[list[int]] = []
    for at, reach in sorted(places):
        a, b = max(0, at - (least - seed)), min(size, at + reach + least)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def laid_out(starts: list[int], pieces: list[str], gap: int) -> np.ndarray:
    """The code points of a text of which only ``pieces`` are known, ``gap`` (no code point) at all other places."""
    parts = [_points(p) for p in pieces]
    out = np.full(max((a + len(p) for a, p in zip(starts, parts, strict=True)), default=0), gap, np.uint32)
    for a, p in zip(starts, parts, strict=True):
        out[a : a + len(p)] = p
    return out


def shared_spans(records: DataFrame, key: str, text: str, *, least: int = 120, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Pairs of different texts that share spans, and the membership of records in texts.

    First result: ``rep_a`` < ``rep_b`` and ``spans``, all maximal repeats of at least ``least`` code
    points as (``start_a``, ``start_b``, ``length``). Second: ``id``, ``rep`` of every record long
    enough; records with the very same text have one ``rep``, the least of their ids, so that
    copies are joined once however many there are. Texts are compared as stored. Null keys, null
    texts and shorter texts are in neither; repeated rows count once; an empty table gives empty
    results; other columns are ignored.

    Seeds of a third of all records are joined in blocks of ``BLOCK`` records, so no task gets a
    whole seed's list. Of each text only the parts around seeds that another text has too go to
    its pairs (``stretches``): a notice that stands in very many texts is sent alone, not with all of them.
    """
    if not 0 < seed <= least:
        raise ValueError("seed must be between 1 and least")
    members = cut(classes(records, key, text, least))
    rows = records.where((F.length(text) >= least) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text whose copies stand in one task is taken apart there once
        met: set[int] = set()
        for batch in batches:
            digests, hs, ps, ns, own = batch.column(0), [], [], [], []
            for row, (d, t) in enumerate(zip(digests.to_pylist(), batch.column(1), strict=True)):
                if d in met:
                    continue
                met.add(d)
                own.append(row)
                h, p = anchors(t.as_py(), least, seed)
                hs.append(h)
                ps.append(p)
                ns.append(len(h))
            if ns:
                at = np.concatenate(ps)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), digests.take(pa.array(np.repeat(own, ns))), pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1] << STEP_BITS | at[:, 2])], ["h", "digest", "at", "row"])

    kind = records.schema[key].dataType.simpleString()
    found = cut(rows.select(F.xxhash64("text"), "text").mapInArrow(seeds, "h long, digest long, at int, row long"))
    lists = found.groupBy("h").agg(F.min("digest").alias("a"), F.max("digest").alias("z"), F.count("*").alias("n")).where("a < z").select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # the seeds that several texts have, few of all, get the ids; two texts of one digest would get each other's seeds too, which the texts then don't bear out
    shared = found.join(lists, "h").join(members.where("id = rep").select("digest", "id"), "digest").drop("digest").distinct()
    shared = cut(shared.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = shared.select("h", F.col("block").alias("x"), other.alias("y"), F.col("id").alias("rep_a"), F.col("at").alias("at_a"), F.col("row").alias("row_a"))
    right = shared.select("h", other.alias("x"), F.col("block").alias("y"), F.col("id").alias("rep_b"), F.col("at").alias("at_b"), F.col("row").alias("row_b"))
    met = left.join(right, ["h", "x", "y"]).where("rep_a < rep_b").select("rep_a", "rep_b", "at_a", F.expr("at_a - at_b").alias("diagonal"), "row_a", "row_b")
    # seeds that overlap on one diagonal lie in one repeat: the first of each stretch stands for them, and so do rows of one make
    met = met.groupBy("rep_a", "rep_b", "diagonal", "row_a", "row_b", F.expr(f"at_a div {seed}").alias("stretch")).agg(F.min("at_a").alias("at_a"))
    pairs = cut(met.groupBy("rep_a", "rep_b").agg(F.collect_list(F.struct("at_a", F.expr("at_a - diagonal").alias("at_b"), "row_a", "row_b")).alias("anchors")))
    reach = F.shiftright("row", STEP_BITS).cast("int").alias("reach")
    places = shared.select("id", F.struct("at", reach).alias("x")).distinct().groupBy("id").agg(F.collect_list("x").alias("places"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, parts = [], []
            for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept = stretches([(x["at"], x["reach"]) for x in own], len(t), seed, least)
                starts.append([a for a, _ in kept])
                parts.append([t[a:b] for a, b in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.string()))], ["id", "starts", "pieces"])

    texts = cut(rows.join(places, "id").select("id", "text", "places").mapInArrow(pieces, f"id {kind}, starts array<int>, pieces array<string>").distinct())
    side = lambda s: texts.select(F.col("id").alias(f"rep_{s}"), F.struct("starts", "pieces").alias(f"text_{s}"))
    both = pairs.join(side("a"), "rep_a").join(side("b"), "rep_b")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start_a", pa.int32()), ("start_b", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            out, sizes = [], []
            for ta, tb, an in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                at_a, at_b, row_a, row_b = (an.values.field(i).to_numpy().astype(np.int64) for i in range(4))
                ta, tb = ta.as_py(), tb.as_py()
                # places that are not known differ from each other too
                a, b = laid_out(ta["starts"], ta["pieces"], 0x110001), laid_out(tb["starts"], tb["pieces"], 0x110002)
                alone = (row_a | row_b) == 0
                found = [np.array(maximal_repeats(a, b, at_a[alone], at_b[alone], least), np.int64).reshape(-1, 3)]
                for x, y, ra, rb in zip(*(v[~alone].tolist() for v in (at_a, at_b, row_a, row_b)), strict=True):
                    found.append(row_repeats(a, b, (x, ra >> STEP_BITS, ra & STEP_MASK), (y, rb >> STEP_BITS, rb & STEP_MASK), least))
                out.append(np.unique(np.concatenate(found), axis=0).astype(np.int32))
                sizes.append(len(out[-1]))
            flat = np.concatenate([np.zeros((0, 3), np.int32), *out])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], fields=list(span.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["rep_a", "rep_b", "spans"])

    spans = both.select("rep_a", "rep_b", "text_a", "text_b", "anchors").mapInArrow(extended, f"rep_a {kind}, rep_b {kind}, spans array<struct<start_a int, start_b int, length int>>")
    return spans.where("size(spans) > 0"), members.select("id", "rep")


def record_pairs(spans: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records ``a`` < ``b`` that share a span: those of different texts, and those of copies."""
    ma, mb = members.select(F.col("id").alias("a"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("b"), F.col("rep").alias("rep_b"))
    apart = spans.select("rep_a", "rep_b").join(ma, "rep_a").join(mb, "rep_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    copies = ma.join(mb, F.col("rep_a") == F.col("rep_b")).where("a < b").select("a", "b")
    return apart.unionByName(copies).distinct()


def shared_share(records: DataFrame, key: str, text: str, spans: DataFrame, members: DataFrame) -> DataFrame:
    """(``key``, ``n_chars``, ``shared_chars``) of every record with a key: how much of it stands in other records too.

    The spans of a text with all others are united; a record with copies is shared throughout.
    Records that are null, empty or share nothing have 0.
    """
    side = lambda r, s: spans.select(F.col(r).alias("rep"), F.explode("spans").alias("x")).select("rep", F.col(f"x.{s}").alias("s"), (F.col(f"x.{s}") + F.col("x.length")).alias("e"))
    each = side("rep_a", "start_a").unionByName(side("rep_b", "start_b")).groupBy("rep", "s").agg(F.max("e").alias("e"))
    reach = F.max("e").over(W.partitionBy("rep").orderBy("s").rowsBetween(W.unboundedPreceding, -1))
    covered = each.withColumn("r", reach).groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.col("r"), F.lit(0))))).alias("c"))
    many = members.groupBy("rep").agg(F.count("*").alias("n"))
    known = members.join(many, "rep").join(covered, "rep", "left").select("id", "n", "c").groupBy("id").agg(F.max("n").alias("n"), F.max("c").alias("c"))
    size = F.coalesce(F.length(text), F.lit(0))
    all_ = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(size).cast("long").alias("n_chars"))
    shared = F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).cast("long")
    return all_.join(known, "id", "left").select(F.col("id").alias(key), "n_chars", shared.alias("shared_chars"))

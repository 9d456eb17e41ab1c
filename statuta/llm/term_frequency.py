"""How often every distinct term occurs in a collection and in how many records."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.llm.codes import joined
from statuta.session import cut

# The block of Chinese characters of which two neighbours make a term.
FIRST, LAST = 0x4E00, 0x9FFF
SPAN = LAST - FIRST + 1
#: Identifiers aimed at for one range of the dictionary.
IDS_PER_RANGE = 32768
#: Distinct (record, term) pairs that a block gathers before it is given out.
PAIRS_PER_BLOCK = 4_000_000


def record_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Each distinct term of each record: record, code, occurrences there; and the strings of codes from SPAN² on."""
    texts = [t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts]
    whole, codes, starts = joined([t.lower() for t in texts])
    n = len(codes)
    cjk = (codes >= FIRST) & (codes <= LAST)
    at = np.flatnonzero(cjk[:-1] & cjk[1:])
    pairs = (codes[at].astype(np.int64) - FIRST) * SPAN + (codes[at + 1].astype(np.int64) - FIRST)
    word = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    local: dict[str, int] = {}
    runs = np.fromiter((local.setdefault(whole[b:e], len(local)) for b, e in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
    record = np.searchsorted(starts, np.concatenate([at, begin]), "right") - 1 if n else np.zeros(0, np.int64)
    keys, counts = np.unique((record << 30) | np.concatenate([pairs, runs + SPAN * SPAN]), return_counts=True)
    return keys >> 30, keys & ((1 << 30) - 1), counts, list(local)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes with their occurrences and records."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts, np.diff(np.append(first, len(codes)))


def _strings(codes: np.ndarray, words: list[str]) -> list[str]:
    two = codes[codes < SPAN * SPAN]
    text = (np.stack([two // SPAN, two % SPAN], 1) + FIRST).astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 2] for i in range(0, len(text), 2)] + [words[c - SPAN * SPAN] for c in codes[codes >= SPAN * SPAN].tolist()]


BLOCK = "term string, occurrences long, records long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each block of records by term, and one row with a null term and the block's number of records."""
    held: dict[str, list[int]] = {}
    two: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    records = pairs = 0

    def given() -> pa.RecordBatch:
        codes, occ, rec = (np.concatenate(x) for x in zip(*two, strict=True)) if two else (np.zeros(0, np.int64),) * 3
        order = np.argsort(codes, kind="stable")
        codes, occ, rec = codes[order], occ[order], rec[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        o = np.add.reduceat(occ, first) if len(first) else occ
        r = np.add.reduceat(rec, first) if len(first) else rec
        return pa.RecordBatch.from_arrays(
            [pa.array(_strings(codes[first], []) + list(held) + [None], pa.string()), pa.array(np.concatenate([o, [c[0] for c in held.values()], [0]]).astype(np.int64)), pa.array(np.concatenate([r, [c[1] for c in held.values()], [records]]).astype(np.int64))],
            ["term", "occurrences", "records"],
        )

    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t is not None]
        _, code, counts, words = record_terms(texts)
        codes, occ, rec = _summed(code, counts)
        low = codes < SPAN * SPAN
        two.append((codes[low], occ[low], rec[low]))
        for term, o, r in zip(_strings(codes[~low], words), occ[~low].tolist(), rec[~low].tolist(), strict=True):
            c = held.setdefault(term, [0, 0])
            c[0] += o
            c[1] += r
        records += len(texts)
        pairs += len(codes)
        if pairs > PAIRS_PER_BLOCK:
            yield given()
            held, two, records, pairs = {}, [], 0, 0
    yield given()


RANGE = "range int, occurrences array<long>, records array<long>"


def _range_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up count arrays by identifier range; rows come sorted by ``range``, so one range's arrays are held at a time."""
    now, size = None, 0
    occ = rec = np.zeros(0, np.int64)

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([occ[:size]], pa.list_(pa.int64())), pa.array([rec[:size]], pa.list_(pa.int64()))], ["range", "occurrences", "records"])

    for batch in batches:
        ranges, ids, o, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranges)], strict=True):
            if a == b:
                continue
            if ranges[a] != now:
                if now is not None:
                    yield given()
                now, size, occ, rec = int(ranges[a]), 0, np.zeros(IDS_PER_RANGE, np.int64), np.zeros(IDS_PER_RANGE, np.int64)
            most = int(ids[a:b].max()) + 1
            if most > len(occ):
                occ, rec = (np.concatenate([x, np.zeros(max(most, 2 * len(x)) - len(x), np.int64)]) for x in (occ, rec))
            size = max(size, most)
            np.add.at(occ, ids[a:b], o[a:b])
            np.add.at(rec, ids[a:b], r[a:b])
    if now is not None:
        yield given()


def term_frequency(texts: DataFrame, text: Column, *, rare_at_most: int = 2, common_one_in: int = 5) -> DataFrame:
    """(``term``, ``occurrences``, ``records``, ``mark``) of every distinct term of ``text``.

    The text is taken in Unicode form NFKC and lower-cased. Terms are every two neighbouring
    characters of U+4E00 to U+9FFF (overlapping) and every longest run of ``a-z0-9``. Every row with
    a text that is not null is one record, repeated rows and empty texts too; null texts are none.
    ``mark``: ``rare`` for a term in at most ``rare_at_most`` records, else ``common`` for one in
    more than one of ``common_one_in`` records, else null. An empty table gives an empty result.

    Blocks of records are counted once and written. Their distinct terms make the global dictionary:
    a term's hash names its range, its rank in the range is its number. The blocks' counts, encoded,
    are added up as arrays range by range, and the dictionary decodes the sums.
    """
    blocks = cut(texts.select(text.alias("text")).mapInArrow(_blocks, BLOCK))
    counts = blocks.where("term is not null")
    ranges = max(1, -(-counts.agg(F.approx_count_distinct("term")).first()[0] // IDS_PER_RANGE))
    dictionary = counts.select("term").distinct().withColumn("range", F.pmod(F.xxhash64("term"), F.lit(ranges)).cast("int"))
    dictionary = dictionary.withColumn("id", F.row_number().over(W.partitionBy("range").orderBy("term")).cast("long") - 1)
    encoded = counts.join(dictionary, "term").select("range", "id", "occurrences", "records")
    arrays = encoded.repartition("range").sortWithinPartitions("range").mapInArrow(_range_arrays, RANGE)
    sums = arrays.select("range", F.posexplode(F.arrays_zip("occurrences", "records")).alias("id", "x"))
    decoded = sums.join(dictionary, (sums["range"] == dictionary["range"]) & (sums["id"] == dictionary["id"])).select("term", "x.occurrences", "x.records")
    total = blocks.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("__n"))
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") * common_one_in > F.col("__n"), "common")
    return decoded.join(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))

"""References to records that do not exist at the time of the reference, by bitmaps over dictionary-encoded keys."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import cut

#: Bits of one bitmap, as Spark's bitmap functions fix it.
BITS = 32768
#: Keys aimed at for one range of the dictionary; a range that hashing overfills continues in further bitmaps.
KEYS_PER_RANGE = 24576
PERIOD = "yyyy-MM"


def key_dictionary(keys: DataFrame, ranges: int) -> DataFrame:
    """(``__range``, ``__id``) of each distinct ``__key``: the key's hash names the range, its rank there the number.

    Numbers are dense in their range, so no task sees more than one range's keys and nothing is
    counted on the driver.
    """
    w = W.partitionBy("__range").orderBy("__key")
    return keys.distinct().withColumn("__range", F.pmod(F.xxhash64("__key"), F.lit(ranges)).cast("int")).withColumn("__id", F.row_number().over(w).cast("long") - 1)


def _bitmaps(rows: DataFrame, *by: str) -> DataFrame:
    """One bitmap of ``__id`` for each range, block of ``BITS`` numbers and ``by``; combined on the map side."""
    block = F.expr(f"__id div {BITS}").cast("int").alias("__block")
    return rows.groupBy("__range", block, *by).agg(F.expr(f"bitmap_construct_agg(__id % {BITS})").alias("__bits"))


@F.pandas_udf(T.BinaryType())
def _packed(bits: pd.Series) -> pd.Series:
    return bits.map(lambda b: zlib.compress(b, 1))


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _and_not(group: pd.DataFrame) -> pd.DataFrame:
    """Numbers of the block's keys that are referred to in a period and were not there when it began.

    ``group`` has at most two bitmaps of 4 kB a period: ``kind`` 0 those keys that are there for
    good from some time in the period on, 1 those that are referred to in it.
    """
    there = np.zeros(BITS // 8, np.uint8)
    found: list[tuple[str, np.ndarray]] = []
    for period, rows in group.sort_values(["period", "kind"], ascending=[True, False]).groupby("period", sort=True):
        for kind, packed in zip(rows["kind"], rows["packed"], strict=True):
            bits = _unpacked(packed)
            if kind == 1:
                ids = np.flatnonzero(np.unpackbits(bits & ~there, bitorder="little"))
                found.append((period, ids))
            else:
                there = there | bits
    r, b = int(group["__range"].iat[0]), int(group["__block"].iat[0])
    ids = np.concatenate([i for _, i in found]) if found else np.zeros(0, np.int64)
    return pd.DataFrame({"__range": np.full(len(ids), r, np.int32), "__id": ids.astype(np.int64) + b * BITS, "__period": np.repeat([p for p, _ in found], [len(i) for _, i in found]) if found else np.zeros(0, object)})


def suspects(refs: DataFrame, parents: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (``__key``, ``__period``) of references to keys that were not there for good when the period began.

    ``refs``: ``__key``, ``__period``; ``parents``: one row a key with ``__for_good``, the time from
    which it is there without end, or null. For each block of keys and period a bitmap has the keys
    referred to, another those whose ``__for_good`` falls into the period. The second kind, joined
    up over the periods before, is taken from the first (AND-NOT), and the bits left are decoded.
    """
    asked = refs.select("__key", "__period").distinct()
    coded = cut(key_dictionary(asked.select("__key").unionByName(parents.select("__key")), ranges))
    asked_bits = _bitmaps(asked.join(coded, "__key"), "__period").select("__range", "__block", F.col("__period").alias("period"), F.lit(1).alias("kind"), "__bits")
    there = parents.where("__for_good is not null").select("__key", F.date_format("__for_good", PERIOD).alias("__period"))
    there_bits = _bitmaps(there.join(coded, "__key"), "__period").select("__range", "__block", F.col("__period").alias("period"), F.lit(0).alias("kind"), "__bits")
    both = asked_bits.unionByName(there_bits).withColumn("packed", _packed("__bits")).drop("__bits")
    left = both.groupBy("__range", "__block").applyInPandas(_and_not, "__range int, __id long, __period string")
    return left.join(coded, ["__range", "__id"]).select("__key", "__period")


def _alive_at(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Column ``__alive`` for each of ``refs`` (``__key``, ``__t``): how many of ``spans`` hold its time.

    ``spans`` (``__key``, ``__from``, ``__to``) count +1 at their start and -1 at their end. The
    counts are summed by key and hour first, so that a key with very many spans or references is
    swept hour by hour in different tasks, with one row an hour carried over.
    """
    ends = spans.select("__key", F.explode(F.array(F.struct(F.col("__from").alias("__t"), F.lit(1).alias("__d")), F.struct(F.col("__to").alias("__t"), F.lit(-1).alias("__d")))).alias("__e"))
    events = ends.groupBy("__key", F.col("__e.__t").alias("__t")).agg(F.sum("__e.__d").alias("__d"))
    events = events.withColumn("__m", F.date_trunc("hour", "__t"))
    sums = events.groupBy("__key", "__m").agg(F.sum("__d").alias("__d"))
    moments = refs.withColumn("__m", F.date_trunc("hour", "__t"))
    all_hours = sums.unionByName(moments.select("__key", "__m", F.lit(0).cast("long").alias("__d")).distinct()).groupBy("__key", "__m").agg(F.sum("__d").alias("__d"))
    before = all_hours.withColumn("__d", F.coalesce(F.sum("__d").over(W.partitionBy("__key").orderBy("__m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # the carried count takes part as an event before the hour's first moment
    lines = moments.withColumn("__d", F.lit(0).cast("long")).withColumn("__kind", F.lit(2))
    lines = lines.unionByName(events.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    lines = lines.unionByName(before.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy("__key", "__m").orderBy(F.col("__kind") != 0, "__t", "__kind").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("__alive", F.sum("__d").over(w)).where("__kind = 2").drop("__kind", "__d", "__m")


def orphan_references(refs: DataFrame, parents: DataFrame, tag: list[str], *, ranges: int | None = None) -> DataFrame:
    """References whose key has no parent at their time, with ``period`` and ``orphan_kind``.

    ``refs``: ``key``, ``at`` (time of the reference) and the columns ``tag``; ``parents``: ``key``,
    ``loaded_at``, ``deleted_at`` (null while the record is there), any number of rows a key.
    ``orphan_kind``: ``missing`` no parent row has the key; ``late`` all of them were loaded after
    the reference; ``deleted`` some were loaded by then and all of these deleted at or before it.
    References with a null key or time are no cases; parents with a null key or ``loaded_at`` are no
    parents. Repeated references come out each. Empty tables give an empty result, or ``missing``
    throughout. Other columns are ignored.

    A bitmap AND-NOT per key range and period finds the references that may be orphans
    (``suspects``); only these are held against the exact times.
    """
    asked = cut(refs.select(F.col("key").alias("__key"), F.col("at").alias("__t"), *tag).dropna(subset=["__key", "__t"]).withColumn("__period", F.date_format("__t", PERIOD)))
    rows = parents.select(F.col("key").alias("__key"), F.col("loaded_at").alias("__from"), F.col("deleted_at").alias("__to")).dropna(subset=["__key", "__from"])
    once = cut(rows.groupBy("__key").agg(F.min("__from").alias("__first"), F.min(F.when(F.col("__to").isNull(), F.col("__from"))).alias("__for_good"), F.count("__to").alias("__ended")))
    if ranges is None:
        ranges = max(1, -(-(once.count() + asked.select("__key").distinct().count()) // KEYS_PER_RANGE))
    left = suspects(asked, once, ranges)
    doubtful = asked.join(left, ["__key", "__period"], "left_semi").join(once, "__key", "left")
    kind = F.when(F.col("__first").isNull(), "missing").when(F.col("__first") > F.col("__t"), "late")
    doubtful = cut(doubtful.withColumn("orphan_kind", kind).where((F.col("__for_good") > F.col("__t")) | F.col("__for_good").isNull()))
    sure = doubtful.where("orphan_kind is not null")
    open_ = doubtful.where("orphan_kind is null").drop("orphan_kind")
    spans = rows.where("__to > __from").distinct().join(open_.select("__key").distinct(), "__key", "left_semi")
    gone = _alive_at(open_.select("__key", "__t", "__period", *tag), spans).where("__alive = 0").withColumn("orphan_kind", F.lit("deleted"))
    out = [*tag, F.col("__period").alias("period"), "orphan_kind"]
    return sure.select(*out).unionByName(gone.select(*out))

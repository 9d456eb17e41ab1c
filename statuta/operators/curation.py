"""Ordered work on rows: positions, first-wins distinct, batches, splits, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.session import cut


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, from 1 in the order of the columns ``order``, whose values together should be unique.

    Rows are put into ranges by samples of their values, however these are spread, sorted within
    each range, and written with their place there; places move by the rows of the ranges before. So
    no task orders all rows, and more partitions make smaller ranges. Nulls come first.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    # the number holds the partition above 33 bits, and the place in it below
    placed = cut(placed).withColumn("__b", F.shiftright("__m", 33)).withColumn("__i", F.col("__m") - F.shiftleft("__b", 33) + 1).drop("__m")
    # a row a range
    sums = placed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return placed.join(F.broadcast(before), "__b").withColumn("pos", (F.col("__before") + F.col("__i")).cast("long")).drop("__b", "__i", "__before")


def first_of(rows: DataFrame, value: str, order: str) -> DataFrame:
    """One row for each value that isn't null: the first by ``order``; ``max_by`` combines before the shuffle."""
    cols = [c for c in rows.columns if c not in (value,)]
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min_by(F.struct(*cols), F.struct(order)).alias("__x")).select(value, "__x.*")


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of two tables side by side, by their places in order; what one has more of stands alone."""
    a = positions(left, left_order)
    b = positions(right, right_order)
    return a.join(b, "pos", "full")


def split_in_order(rows: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """``rows`` with ``part``: ``train`` for the first ``share`` of them in order, else ``validation``."""
    placed = positions(rows, order)
    n = rows.agg(F.floor(F.count("*") * share).alias("__cut"))
    return placed.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("pos") <= F.col("__cut"), "train").otherwise("validation")).drop("__cut")  # one row


def pending(wanted: DataFrame, done: DataFrame, value: str) -> DataFrame:
    """Rows of ``wanted`` whose value isn't among those done."""
    return wanted.join(done.select(value).distinct(), value, "left_anti")


def hash_sample(rows: DataFrame, key: Column, share: float) -> DataFrame:
    """About ``share`` of the rows, always the same: those whose key's hash lies in the first part of its range."""
    return rows.where(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") < int(share * 2**32))


def prompt_blocks(hits: DataFrame, most: int = 5) -> DataFrame:
    """(``qid``, ``context``): the best ``most`` hits of a query as numbered blocks of source and text.

    ``hits``: ``qid``, ``rank``, ``id``, ``source``, ``text``; only the ``most`` best are gathered.
    """
    w = W.partitionBy("qid").orderBy("rank", "id")
    kept = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    block = F.concat(F.col("__n").cast("string"), F.lit(". 【"), F.coalesce("source", F.lit("")), F.lit("】\n"), F.coalesce("text", F.lit("")))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))

"""A property graph of laws, articles, authorities and terms as node and edge tables, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that introduce a definition.
DEFINING = ("是指", "包括", "称为", "以下简称", "定义为")
# Words that tell how a document relates to another, in the order in which they decide.
RELATIONS = (("根据", "basis"), ("依据", "basis"), ("依照", "basis"), ("按照", "basis"), ("遵循", "basis"), ("落实", "implements"), ("贯彻", "implements"), ("适用", "applies"), ("参照", "references"), ("配合", "supporting"), ("配套", "supporting"), ("上位法", "parent_law"))


def relation(text: Column, first: int = 400) -> Column:
    """The relation of the first word of ``RELATIONS`` within the first characters of a text, else ``related``."""
    head = F.substring(text, 1, first)
    out = F.lit("related")
    for word, name in reversed(RELATIONS):
        out = F.when(F.contains(head, F.lit(word)), name).otherwise(out)
    return out


def cited_articles(text: Column) -> Column:
    """Distinct (``law``, ``article``) of citations like 《…》第…条, in order; articles as written."""
    pattern = r"《([^》]{2,60})》\s*第\s*([零一二三四五六七八九十百千\d]+)\s*条"
    law, number = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.zip_with(law, number, lambda a, b: F.struct(a.alias("law"), b.alias("article"))))


def cited_titles(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("《([^》]{2,80})》"), F.lit(1)))


def defines(text: Column) -> Column:
    out = F.lit(False)
    for word in DEFINING:
        out = out | F.contains(text, F.lit(word))
    return out


def first_each(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of each ``key``."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(``src``, ``dst``) over two edges, without those back to the start."""
    return first.select("src", F.col("dst").alias("mid")).join(second.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst").distinct()


def nearest_paths(branches: list[tuple[int, DataFrame]], most: int = 10) -> DataFrame:
    """(``src``, ``dst``, ``path_length``): each target of a start by its shortest path, at most ``most`` a start, shorter ones and smaller ids first."""
    united = None
    for length, b in branches:
        b = b.select("src", "dst", F.lit(length).alias("path_length"))
        united = b if united is None else united.unionByName(b)
    best = united.groupBy("src", "dst").agg(F.min("path_length").alias("path_length"))
    return first_each(best, "src", most, "path_length", "dst")

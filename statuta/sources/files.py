"""Readers of text, dictionary and question files, and the writers that go with them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.text import clean_text, without_number
from statuta.operators.curation import positions

# Marks at a file's start and the encodings they stand for.
MARKS = ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of file contents: by the mark at the start, else UTF-8, else GB18030; what no encoding reads is dropped."""

    def one(b: bytes) -> str:
        for mark, name in MARKS:
            if b.startswith(mark):
                return b.decode(name, "ignore")
        for name in ("utf-8", "gb18030"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass
        return b.decode("utf-8", "ignore")

    return content.map(one)


def read_texts(spark: SparkSession, folder: str, suffixes: str = "*.txt") -> DataFrame:
    """(``title``, ``file_path``, ``text``) of all text files below a folder; the title is the file's name without its end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("title"), F.col("path").alias("file_path"), clean_text(decoded("content")).alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(``question``, ``query``) of a JSON-lines file; lines that aren't JSON are skipped."""
    return spark.read.schema("question string, query string").option("mode", "DROPMALFORMED").json(path).where("question <> ''")


def read_question_array(spark: SparkSession, path: str, field: str = "question") -> DataFrame:
    """(``question``) of files that hold one JSON array each, of texts or of objects with ``field``; blank ones are left out.

    The array is a value of one row of its file, as a JSON text can't be cut: for lists of questions, not for tables.
    """
    whole = spark.read.format("binaryFile").load(path).select(decoded("content").alias("text"))
    each = whole.select(F.explode(F.from_json("text", "array<string>")).alias("x"))
    question = F.trim(F.coalesce(F.get_json_object("x", f"$.{field}"), F.when(~F.col("x").startswith("{"), F.col("x"))))
    return each.select(question.alias("question")).where("question <> ''")


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``question``) of text files with one question a line, without the number in front of it; blank lines are left out."""
    return spark.read.text(path).select(F.trim(without_number(F.col("value"))).alias("question")).where("question <> ''")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(``kind``, ``name``, ``short``, ``aliases``, ``category``) of a JSON dictionary with maps of terms, laws and authorities."""
    entry = "map<string, struct<short:string, aliases:array<string>, category:string>>"
    whole = spark.read.schema(f"terms {entry}, law_names {entry}, authorities {entry}").option("multiLine", "true").json(path)
    out = None
    for column, kind in (("terms", "term"), ("law_names", "law"), ("authorities", "authority")):
        part = whole.select(F.lit(kind).alias("kind"), F.explode(column).alias("name", "e")).select("kind", "name", "e.*")
        out = part if out is None else out.unionByName(part)
    return out


def write_table(df: DataFrame, path: str, *, by: str | None = None, mode: str = "overwrite") -> None:
    """A table as Parquet files, in folders by a column if one is named."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def corpus_file(texts: DataFrame) -> DataFrame:
    """(``value``): each text under a heading with its place in the order of titles, ready to be written as text."""
    placed = positions(texts, "title", "file_path").orderBy("pos")
    heading = F.concat(F.lit("# 文件 "), F.col("pos").cast("string"), F.lit(": "), F.col("title"))
    return placed.select(F.concat(heading, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value"))

"""Queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.bpe_automaton import encode_corpus
from statuta.llm.leakage import leaks, without_leaks
from statuta.llm.name_mapping import map_cases
from statuta.llm.scan_repair import paragraphs, scan_noise
from statuta.llm.shared_spans import record_pairs, shared_share, shared_spans
from statuta.llm.term_frequency import term_frequency
from statuta.session import table

#: Where the vocabulary files are; a path that all executors can read.
TOKENIZERS = "/opt/tokenizers"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency(table(spark, folder, "chunks"), F.col("text")).where("mark is not null").select("term", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks, candidates, canonical = (table(spark, folder, t) for t in ("chunks", "dictionary_candidates", "canonical_names"))
    typed = candidates.select("kind", F.col("candidate_id").alias("row_key"), F.explode(F.concat(F.array(F.struct(F.lit("short").alias("field"), F.col("short").alias("value"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("aliases").alias("field"), a.alias("value"))))).alias("x"))
    authority = chunks.select(F.lit("authority").alias("kind"), F.col("row_id").alias("row_key"), F.lit("authority").alias("field"), F.col("authority").alias("value"))
    entries = canonical.select("kind", F.col("canon_id").alias("entry"), F.explode(F.array("full_name", "short")).alias("name"))
    cases = typed.select("kind", "row_key", "x.field", "x.value").unionByName(authority)
    return map_cases(cases, entries).select("field", "row_key", F.col("value").alias("raw_value"), F.col("entry").alias("canon_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    noise, _ = scan_noise(table(spark, folder, "parsed_docs"), "parsed_id", "title", "pages")
    return noise.select("parsed_id", F.col("page").cast("long").alias("page_num"), F.col("line").cast("long").alias("line_no"), "noise").distinct()


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "parsed_docs"), "parsed_id", "title", "pages")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    spans, members = shared_spans(table(spark, folder, "documents"), "doc_id", "text")
    return record_pairs(spans, members).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return shared_share(documents, "doc_id", "text", *shared_spans(documents, "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_ids": p6_ids, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_share": p8_share}
SQL: dict[str, str] = {}

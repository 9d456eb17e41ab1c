"""Queries of the general corpus problems: entity history and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.notation import article_key, clean_date, clean_name, clean_status
from statuta.operators.history import attribute_history
from statuta.operators.orphans import orphan_references
from statuta.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").select(
        clean_name(F.col("law_name")).alias("law_name"), clean_date(F.col("effective_date")).alias("effective_date"), clean_status(F.col("status")).alias("status"), "snapshot_date", "loaded_at", "row_id"
    )
    return attribute_history(rows, "law_name", "snapshot_date", ["effective_date", "status"], ["loaded_at", "row_id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks, refs, hits = (table(spark, folder, t) for t in ("chunks", "article_refs", "search_hits"))
    law_article = lambda law, article: F.concat(F.lit("a\n"), clean_name(F.col(law)), F.lit("\n"), article_key(F.col(article)))
    chunk = lambda c: F.concat(F.lit("c\n"), F.when(F.trim(c) != "", F.col(c)))
    times = ["loaded_at", "deleted_at"]
    keys = F.explode(F.array(chunk("chunk_id"), law_article("law_name", "article_num")))
    parents = chunks.select(keys.alias("key"), *times)
    field = lambda name, key: F.struct(F.lit(name).alias("ref_field"), key.alias("key"))
    both = F.explode(F.array(field("chunk_id", chunk("chunk_id")), field("target_article", law_article("target_law", "target_article")))).alias("x")
    asked = refs.select(F.lit("article_refs").alias("ref_table"), "ref_id", F.col("created_at").alias("at"), both).select("ref_table", "x.ref_field", "ref_id", "at", "x.key")
    found = hits.select(F.lit("search_hits").alias("ref_table"), F.lit("chunk_id").alias("ref_field"), F.col("hit_id").alias("ref_id"), F.col("searched_at").alias("at"), chunk("chunk_id").alias("key"))
    out = orphan_references(asked.unionByName(found), parents, ["ref_table", "ref_field", "ref_id"])
    return out.select("ref_table", "ref_field", "ref_id", "period", "orphan_kind")


_STRIP = r"[\s\x{A0}\x{2000}-\x{200F}\x{3000}\x{FEFF}]"
_NAME = rf"nullif(regexp_replace(law_name, '^([《》〈〉]|{_STRIP})+|([《》〈〉]|{_STRIP})+$', '', 'g'), '')"
_DATE = r"""try_cast(coalesce(
    nullif(regexp_replace(regexp_extract(effective_date, '^\D*(\d{4}[-./年]\d{1,2}[-./月]\d{1,2})', 1), '[./年月]', '-', 'g'), ''),
    nullif(regexp_replace(regexp_extract(effective_date, '^\s*(\d{8})\s*$', 1), '^(....)(..)', '\1-\2-'), '')) as date)"""
P2_SQL = rf"""
with told as (
  select {_NAME} law_name, strftime({_DATE}, '%Y-%m-%d') effective_date,
    case when regexp_matches(status, '^{_STRIP}*有效{_STRIP}*$') then '有效' when regexp_matches(status, '^{_STRIP}*已修订{_STRIP}*$') then '已修订' end status,
    snapshot_date, loaded_at, row_id from chunks),
held as (
  select * from told where law_name is not null and effective_date is not null and status is not null
  qualify row_number() over (partition by law_name, snapshot_date order by loaded_at desc, row_id desc) = 1),
starts as (
  select * from (
    select *, lag(effective_date) over w d, lag(status) over w s from held window w as (partition by law_name order by snapshot_date))
  where d is distinct from effective_date or s is distinct from status)
select law_name, effective_date, status, snapshot_date valid_from,
  coalesce(lead(snapshot_date) over (partition by law_name order by snapshot_date), '9999-12-31') valid_to
from starts
"""


def _article(c: str) -> str:
    """DuckDB's number of the article in column ``c``."""
    s = rf"translate(regexp_replace({c}, '{_STRIP}+', '', 'g'), '０１２３４５６７８９零一二三四五六七八九', '01234567890123456789')"
    n = rf"regexp_extract({s}, '^第?([0-9十百千]+)(条|$)', 1)"
    unit = lambda mark, worth: rf"case when {n} like '%{mark}%' then coalesce(try_cast(nullif(regexp_extract({n}, '([0-9]?){mark}', 1), '') as int), 1) * {worth} else 0 end"
    rest = rf"coalesce(try_cast(nullif(regexp_extract({n}, '([0-9]*)$', 1), '') as int), 0)"
    return rf"case when {n} <> '' then cast({unit('千', 1000)} + {unit('百', 100)} + {unit('十', 10)} + {rest} as varchar) else nullif({s}, '') end"


P3_SQL = rf"""
with parents as (
  select 'c' || chunk_id as k, loaded_at, deleted_at from chunks where trim(chunk_id) <> ''
  union all
  select 'a' || {_NAME} || '/' || {_article("article_num")}, loaded_at, deleted_at from chunks),
asked as (
  select 'article_refs' ref_table, 'chunk_id' ref_field, ref_id, created_at t, 'c' || chunk_id as k from article_refs where trim(chunk_id) <> ''
  union all
  select 'article_refs', 'target_article', ref_id, created_at, 'a' || {_NAME.replace("law_name", "target_law")} || '/' || {_article("target_article")} from article_refs
  union all
  select 'search_hits', 'chunk_id', hit_id, searched_at, 'c' || chunk_id from search_hits where trim(chunk_id) <> ''),
judged as (
  select ref_table, ref_field, ref_id, t, count(p.k) n, count(*) filter (where p.loaded_at <= t) loaded, count(*) filter (where p.loaded_at <= t and p.deleted_at <= t) deleted
  from asked left join parents p using (k) where k is not null and t is not null group by all)
select ref_table, ref_field, ref_id, strftime(t, '%Y-%m') period,
  case when n = 0 then 'missing' when loaded = 0 then 'late' else 'deleted' end orphan_kind
from judged where loaded = deleted
"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found}
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL}

"""Queries on documents and chunks: splitting, metadata, versions, graph, mining, curation; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.notation import article_key, clean_date, clean_name, cn_number
from statuta.functions.text import articles, char_windows, clean_text, first_article, title_authority, title_date, title_law, without_number
from statuta.operators.curation import first_of, hash_sample, pending, positions, prompt_blocks, split_in_order, zipped
from statuta.operators.graph import cited_articles, cited_titles, defines, first_each, hop, nearest_paths, relation
from statuta.operators.mining import BODY_PATTERNS, merged, most_common, pattern_counts, tfidf, unknown
from statuta.operators.splitting import split_documents
from statuta.plans.general import _DATE, _NAME, _article
from statuta.plans.retrieval import EVERY, _ALIASES, _CHUNKS, TOK, _aliases, _chunks, _chunk_terms, _contained, _document_index, _heads, _own_aliases, _OWN, _strip
from statuta.operators.dictionary import contained, resolved
from statuta.session import kept, spread, table

#: Chunks that a value, and a query, is related to.
MOST_RELATED = 10


# --- splitting and metadata


def q_clean_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("cleaned"), F.length(clean_text(F.col("text"))).cast("long").alias("n"))


def q_char_windows(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "documents").select("doc_id", F.posexplode(char_windows(F.col("text"))).alias("i", "w"))
    return w.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("w").alias("piece"))


def q_section_split(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "parsed_docs").select("parsed_id", F.posexplode(articles(F.col("full_text"))).alias("i", "piece"))
    return p.select("parsed_id", F.col("i").cast("long").alias("i"), F.md5("piece").alias("piece"))


def q_recursive_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.concat_ws("_", "source", "doc_id").alias("source"), "text", "doc_type")
    return split_documents(spread(docs, "source"))


def q_chunk_articles(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "chunks").select("row_id", first_article(F.col("text")).alias("heading")).where("heading <> ''")
    return found.select("row_id", "heading", article_key(F.col("heading")).alias("number"))


def q_cn_number(s: SparkSession, d: str) -> DataFrame:
    inner = F.regexp_extract("article_num", "第([零一二三四五六七八九十百千0-9]+)条", 1)
    return table(s, d, "chunks").select("article_num", cn_number(F.nullif(inner, F.lit(""))).alias("n")).where("n is not null").groupBy("article_num", "n").agg(F.count("*").alias("rows"))


def q_title_metadata(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(s, d, "parsed_docs").select("parsed_id", title_law(t).alias("law_name"), title_date(t).alias("effective_date"), title_authority(t, F.col("file_path")).alias("authority"))


def q_paragraph_chunks(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n\n")).alias("i", "p"))
    return p.where("length(p) >= 30").select("doc_id", F.col("i").cast("long").alias("i"), F.md5(F.substring("p", 1, 300)).alias("piece"))


def q_ocr_decision(s: SparkSession, d: str) -> DataFrame:
    sizes = F.transform(F.coalesce("pages", F.array().cast("array<struct<page_num:int,text:string>>")), lambda p: F.length(F.regexp_replace(F.coalesce(p["text"], F.lit("")), r"^\s+|\s+$", "")))
    p = table(s, d, "parsed_docs").select("parsed_id", F.size(sizes).alias("n"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("chars"), F.size(F.filter(sizes, lambda x: x == 0)).alias("empty"))
    return p.select("parsed_id", F.expr("n = 0 or chars < 80 or empty >= 0.5 * n").alias("needs_ocr"))


# --- versions


def _dated(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").select(clean_name(F.col("law_name")).alias("law_name"), clean_date(F.col("effective_date")).alias("effective_date"))
    return rows.dropna().distinct()


def q_version_status(s: SparkSession, d: str) -> DataFrame:
    dated = _dated(s, d)
    last = dated.groupBy("law_name").agg(F.max("effective_date").alias("last"))
    return dated.join(last, "law_name").select("law_name", "effective_date", F.when(F.col("effective_date") == F.col("last"), "有效").otherwise("已修订").alias("derived"))


def q_single_file_status(s: SparkSession, d: str) -> DataFrame:
    """Status of each parsed file against the chunks' latest version of its law."""
    files = table(s, d, "parsed_docs").select("parsed_id", title_law(F.col("title")).alias("law_name"), title_date(F.col("title")).alias("date"))
    last = _dated(s, d).groupBy("law_name").agg(F.max("effective_date").alias("last"))
    return files.join(last, "law_name", "left").select("parsed_id", F.when(F.col("date") < F.col("last"), "已修订").otherwise("有效").alias("derived"))


def q_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("chunk_id", "row_id", F.md5("text").alias("text"))


# --- graph


def _articles_by_number(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chunks").where("trim(chunk_id) <> ''").select(clean_name(F.col("law_name")).alias("law"), article_key(F.col("article_num")).alias("article"), F.col("chunk_id").alias("dst"))
    return rows.dropna().distinct()


def _cited(s: SparkSession, d: str) -> DataFrame:
    """Citations (``src``, ``law``, ``article``, ``relation_type``) of chunks, clean."""
    refs = table(s, d, "article_refs").select(F.col("chunk_id").alias("src"), clean_name(F.col("target_law")).alias("law"), article_key(F.col("target_article")).alias("article"), "relation_type")
    return refs.dropna(subset=["src", "law", "article"]).distinct()


def _references(s: SparkSession, d: str) -> DataFrame:
    """Chunk to chunk: each reference to an article leads to the chunks of that article of that law."""
    return _cited(s, d).join(_articles_by_number(s, d), ["law", "article"])


def _belongs(s: SparkSession, d: str) -> DataFrame:
    return _heads(s, d).select(F.col("chunk_id").alias("src"), clean_name(F.col("law_name")).alias("dst")).dropna()


def _issued(s: SparkSession, d: str) -> DataFrame:
    """Laws and the authorities that stand in the column, source or text of their chunks."""
    named = _chunk_terms(s, d).where("kind = 'authority'").select(F.col("id").alias("src"), F.col("canonical").alias("authority"))
    return _belongs(s, d).join(named, "src").select(F.col("dst").alias("src"), F.col("authority").alias("dst")).distinct()


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """Chunk to term; the texts are read only for chunks that have one."""
    found = _chunk_terms(s, d).where("kind = 'term'").select(F.col("id").alias("src"), F.col("canonical").alias("dst"))
    named = _heads(s, d).join(found.select(F.col("src").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select("chunk_id", "row_id")
    told = named.join(table(s, d, "chunks").select("row_id", F.coalesce(defines(F.col("text")), F.lit(False)).alias("defines")), "row_id")
    return found.join(told.select(F.col("chunk_id").alias("src"), "defines"), "src").select("src", "dst", F.when(F.col("defines"), "DEFINES").otherwise("MENTIONS").alias("type"))


def _relates(s: SparkSession, d: str) -> DataFrame:
    """Law to law, by the references of its chunks, with their kind; also to laws that no chunk belongs to."""
    refs = table(s, d, "article_refs").select(F.col("chunk_id").alias("src"), clean_name(F.col("target_law")).alias("dst"), "relation_type").dropna()
    return refs.join(_belongs(s, d).withColumnsRenamed({"dst": "law"}), "src").where("law <> dst").select(F.col("law").alias("src"), "dst", "relation_type").distinct()


def _edges(s: SparkSession, d: str) -> DataFrame:
    """All edges (``type``, ``src``, ``dst``, ``relation_type``), each once, kept."""

    def make() -> DataFrame:
        articles = _heads(s, d).select(F.col("chunk_id").alias("src"))
        plain = lambda df, name: df.select(F.lit(name).alias("type"), "src", "dst", F.lit(None).cast("string").alias("relation_type"))
        out = plain(_belongs(s, d), "BELONGS_TO").unionByName(plain(_references(s, d).select("src", "dst").distinct().join(articles, "src", "left_semi"), "REFERENCES"))
        out = out.unionByName(plain(_issued(s, d), "ISSUED_BY")).unionByName(_relates(s, d).select(F.lit("RELATES_TO").alias("type"), "src", "dst", "relation_type"))
        return out.unionByName(_mentions(s, d).select("type", "src", "dst", F.lit(None).cast("string").alias("relation_type")))

    return kept(s, d, "edges", ("chunks", "article_refs", "canonical_names", "dictionary_candidates"), make)


def _edge(s: SparkSession, d: str, *types: str) -> DataFrame:
    return _edges(s, d).where(F.col("type").isin(*types)).select("src", "dst", "relation_type")


def q_graph_nodes(s: SparkSession, d: str) -> DataFrame:
    """Laws that chunks belong to or relate to, chunks, authorities and terms."""
    names = table(s, d, "canonical_names")
    laws = _edge(s, d, "BELONGS_TO").select(F.col("dst").alias("node")).unionByName(_edge(s, d, "RELATES_TO").select(F.col("dst").alias("node")))
    labelled = lambda df, label: df.select(F.lit(label).alias("label"), "node").where("node is not null").distinct()
    out = labelled(laws, "Document").unionByName(_heads(s, d).select(F.lit("Article").alias("label"), F.col("chunk_id").alias("node")))
    for kind, label in (("authority", "Authority"), ("term", "Term")):
        out = out.unionByName(labelled(names.where(F.col("kind") == kind).select(F.col("full_name").alias("node")), label))
    return out


def q_graph_edges(s: SparkSession, d: str) -> DataFrame:
    """Number of edges of each type."""
    return _edges(s, d).groupBy("type").agg(F.count("*").alias("n"))


def q_graph_edge_rows(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


def _law_neighbours(s: SparkSession, d: str) -> DataFrame:
    """(``id``, ``other``): each chunk with the first ten chunks of the laws that its own law's references lead to."""
    member = _heads(s, d).select(F.col("chunk_id").alias("id"), clean_name(F.col("law_name")).alias("law")).where("law is not null")
    laws = _relates(s, d).select(F.col("src").alias("law"), "dst").distinct()
    # ten chunks a law are enough for ten of all that it leads to
    w = W.partitionBy("law").orderBy("other")
    few = member.select("law", F.col("id").alias("other")).withColumn("n", F.row_number().over(w)).where("n <= 10").drop("n")
    led = laws.join(few.withColumnRenamed("law", "dst"), "dst").select("law", "other").distinct().withColumn("n", F.row_number().over(w)).where("n <= 10").drop("n")
    return member.join(led, "law").select("id", "other")


def q_related_1hop(s: SparkSession, d: str) -> DataFrame:
    return nearest_paths([(1, _references(s, d))])


def q_related_2hop(s: SparkSession, d: str) -> DataFrame:
    """Laws by way of one reference (1), of two, or of an authority that issued both (2)."""
    direct = _edge(s, d, "RELATES_TO").select("src", "dst").distinct()
    issued = _edge(s, d, "ISSUED_BY").select("src", "dst")
    # of what a law or an authority leads to no more than the first eleven are needed, the start among them: those left out are farther or later
    few = first_each(issued.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src", 11, "dst")
    return nearest_paths([(1, direct), (2, hop(direct, first_each(direct, "src", 11, "dst"))), (2, hop(issued, few))])


def _related(s: SparkSession, d: str) -> DataFrame:
    """(``kind``, ``value``, ``branch``, ``path_length``, ``relation``, ``id``): for each law, term, article number and authority its first ten chunks by each way.

    Each value's list is cut before anything is joined to it, so no hub is spread out.
    """
    belongs, references = (_edge(s, d, t).select("src", "dst") for t in ("BELONGS_TO", "REFERENCES"))
    of_law = first_each(belongs.select(F.col("dst").alias("value"), F.col("src").alias("id")), "value", MOST_RELATED, "id")
    relates = _edge(s, d, "RELATES_TO")
    via = relates.join(of_law.withColumnRenamed("value", "dst"), "dst").select(F.col("src").alias("value"), "id", F.concat(F.lit("related_document_"), "relation_type").alias("relation"))
    term = lambda t: _edge(s, d, t).select(F.col("dst").alias("value"), F.col("src").alias("id"))
    definer = references.join(_edge(s, d, "DEFINES").select(F.col("src").alias("dst"), F.col("dst").alias("value")), "dst").select("value", F.col("src").alias("id"))
    number = _heads(s, d).select(F.col("chunk_id").alias("dst"), article_key(F.col("article_num")).alias("value")).dropna()
    citing = references.join(number, "dst").select("value", F.col("src").alias("id"))
    issued = _edge(s, d, "ISSUED_BY").join(of_law.withColumnRenamed("value", "src"), "src").select(F.col("dst").alias("value"), "id")
    ways = [("law", 1, "belongs_to", of_law), ("law", 2, None, via), ("term", 1, "defines", term("DEFINES")), ("term", 1, "mentions", term("MENTIONS")), ("term", 2, "references_term_definer", definer), ("article", 1, "references_article", citing), ("authority", 2, "issued_by_authority", issued)]
    out = None
    for branch, (kind, length, name, df) in enumerate(ways):
        df = df.withColumn("relation", F.lit(name)) if name else df
        df = first_each(df.select("value", "id", "relation").distinct(), "value", MOST_RELATED, "id", "relation")
        df = df.select(F.lit(kind).alias("kind"), "value", F.lit(branch).alias("branch"), F.lit(length).alias("path_length"), "relation", "id")
        out = df if out is None else out.unionByName(df)
    return out


def q_related_articles(s: SparkSession, d: str) -> DataFrame:
    """Chunks related to what each reference whose id is divisible by 20 names: law, article, and authority and terms of its chunk; the nearest ten."""
    refs = table(s, d, "article_refs").where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("qid"), "chunk_id", clean_name(F.col("target_law")).alias("law"), article_key(F.col("target_article")).alias("article"))
    named = _chunk_terms(s, d).where("kind in ('term', 'authority')").select(F.col("id").alias("chunk_id"), "kind", F.col("canonical").alias("value"))
    own = refs.select("qid", F.explode(F.array(F.struct(F.lit("law").alias("kind"), F.col("law").alias("value")), F.struct(F.lit("article").alias("kind"), F.col("article").alias("value")))).alias("x")).select("qid", "x.*").where("value is not null")
    asked = own.unionByName(refs.join(named, "chunk_id").select("qid", "kind", "value")).distinct()
    found = asked.join(_related(s, d), ["kind", "value"])
    one = found.groupBy("qid", "id").agg(F.min(F.struct("path_length", "branch", "relation")).alias("x")).select("qid", "id", "x.*")
    return first_each(one, "qid", MOST_RELATED, "path_length", "branch", "id").select("qid", "id", "path_length", "relation")


def q_graph_facts(s: SparkSession, d: str) -> DataFrame:
    """Sentences on the edges between laws, of laws and authorities, of articles and terms, and of articles."""
    law = F.format_string("法规关系: %s --%s--> %s", "src", "relation_type", "dst")
    issued = F.format_string("发布关系: %s 发布或关联 %s", "dst", "src")
    told = _heads(s, d).select(F.col("chunk_id").alias("src"), clean_name(F.col("law_name")).alias("law"), article_key(F.col("article_num")).alias("article"))
    terms = _edge(s, d, "DEFINES", "MENTIONS").join(told, "src").where("law is not null")
    term = F.format_string("术语关系: %s 出现在 %s 第%s条", "dst", "law", F.coalesce("article", F.lit("未标注条号")))
    cited = _references(s, d).where("relation_type is not null").select(F.format_string("%s %s 《%s》第%s条", "src", "relation_type", "law", "article").alias("fact"))
    return _edge(s, d, "RELATES_TO").select(law.alias("fact")).unionByName(_edge(s, d, "ISSUED_BY").select(issued.alias("fact"))).unionByName(terms.select(term.alias("fact"))).unionByName(cited).distinct()


def _citing_texts(s: SparkSession, d: str) -> DataFrame:
    """(``chunk_id``, ``text``): the text of each chunk with its references written behind it, as citations of titles and articles."""
    refs = table(s, d, "article_refs").where("trim(chunk_id) <> ''").select("chunk_id", F.concat(F.lit("《"), clean_name(F.col("target_law")), F.lit("》"), F.coalesce("target_article", F.lit(""))).alias("c")).dropna()
    cited = refs.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_set("c")), "；").alias("c"))
    return _chunks(s, d).join(cited, "chunk_id").select("chunk_id", F.concat_ws("\n", "text", "c").alias("text"))


def q_extract_refs(s: SparkSession, d: str) -> DataFrame:
    x = _citing_texts(s, d).select("chunk_id", F.explode(cited_articles(F.col("text"))).alias("x"))
    return x.select("chunk_id", "x.law", article_key(F.col("x.article")).alias("article")).distinct()


def q_doc_references(s: SparkSession, d: str) -> DataFrame:
    return _citing_texts(s, d).select("chunk_id", F.explode(cited_titles(F.col("text"))).alias("title"))


def q_authorities_in_texts(s: SparkSession, d: str) -> DataFrame:
    """Bodies that each parsed file names: those of the dictionary, and what the patterns match, by its dictionary name where it has one."""
    files = table(s, d, "parsed_docs").select(F.col("parsed_id").alias("id"), F.concat_ws("\n", "title", "full_text").alias("text"))
    names = _aliases(s, d).where("kind = 'authority'")
    known = contained(files, names).select("id", "canonical")
    matched = files.select("id", F.explode(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in BODY_PATTERNS])).alias("name")).distinct()
    told = resolved(matched, names, "name", "authority").select("id", F.coalesce("canonical", "name").alias("canonical"))
    return known.unionByName(told).distinct().select(F.col("id").alias("parsed_id"), F.col("canonical").alias("authority"))


def q_relation_rules(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select(F.coalesce(relation(F.col("text")), F.lit("related")).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


# --- mining


def q_regex_mining(s: SparkSession, d: str) -> DataFrame:
    return pattern_counts(spread(table(s, d, "chunks").select("row_id", "text"), "row_id"), F.col("text"))


def q_new_authorities(s: SparkSession, d: str) -> DataFrame:
    """Of the hundred commonest names of bodies, those the dictionary doesn't know, if they occur three times."""
    return unknown(most_common(q_regex_mining(s, d), 100), "name", _aliases(s, d)).where("n >= 3")


def q_law_years(s: SparkSession, d: str) -> DataFrame:
    years = table(s, d, "parsed_docs").select(title_law(F.col("title")).alias("law_name"), F.substring(title_date(F.col("title")), 1, 4).alias("year")).where("year <> ''")
    return years.groupBy("law_name").agg(F.array_join(F.sort_array(F.collect_set("year")), ",").alias("found_years"), F.max("year").alias("latest_year"))


def q_tfidf(s: SparkSession, d: str) -> DataFrame:
    index = _document_index(s, d)
    return tfidf(index.terms, index.stats()[0])


def q_new_terms(s: SparkSession, d: str) -> DataFrame:
    """Terms of candidates that the reference list doesn't have, long enough and of two ideographs at least."""
    c = table(s, d, "dictionary_candidates").where("kind = 'term'").select("candidate_id", "name", "tfidf_weight")
    c = c.where("length(name) >= 3 and regexp_count(name, '[一-鿿]') >= 2")
    return unknown(c, "name", _own_aliases(s, d)).select("candidate_id", "name")


def q_dict_merge(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "canonical_names").select("kind", F.col("full_name").alias("name"), "category", F.col("canon_id").alias("id"))
    new = table(s, d, "dictionary_candidates").select("kind", "name", "category", F.col("candidate_id").alias("id")).where("name is not null")
    return merged([own, new], ["kind", "name"], ["id"]).select("kind", "name", "category", F.col("origin").cast("long").alias("origin"))


# --- curation


def q_ordered_dedup(s: SparkSession, d: str) -> DataFrame:
    first = first_of(table(s, d, "search_hits").select("query_text", "hit_id"), "query_text", "hit_id")
    return positions(first, "hit_id").select("pos", "query_text")


def q_resume_pending(s: SparkSession, d: str) -> DataFrame:
    asked = first_of(table(s, d, "search_hits").select("query_text", "hit_id"), "query_text", "hit_id")
    done = table(s, d, "search_hits").where("searched_at < timestamp '2023-04-01'").select("query_text")
    return pending(asked, done, "query_text").select("query_text", "hit_id")


def q_train_split(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "search_hits").where("query_text <> '' and chunk_id <> ''").select("query_text", "chunk_id", "hit_id")
    return split_in_order(first_of(pairs, "query_text", "hit_id"), "hit_id").select("query_text", "chunk_id", "part")


def q_rewrite_zip(s: SparkSession, d: str) -> DataFrame:
    """Held-out questions and searched texts side by side, in their orders."""
    asked = first_of(table(s, d, "search_hits").select("query_text", "hit_id"), "query_text", "hit_id")
    return zipped(table(s, d, "eval_items").select("item_id"), "item_id", asked, "hit_id").select("pos", "item_id", "query_text")


def q_question_batches(s: SparkSession, d: str) -> DataFrame:
    placed = positions(table(s, d, "eval_items").select("item_id"), "item_id")
    return placed.groupBy(F.floor((F.col("pos") - 1) / 20).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"))


def q_prompt_context(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "search_hits").join(_chunks(s, d).select("chunk_id", "text", "law_name"), "chunk_id")
    rows = hits.select(F.col("query_id").alias("qid"), F.col("hit_rank").alias("rank"), F.col("hit_id").alias("id"), F.col("law_name").alias("source"), F.substring("text", 1, 300).alias("text"))
    return prompt_blocks(rows).select("qid", F.md5("context").alias("context"))


def q_hit_projection(s: SparkSession, d: str) -> DataFrame:
    """Each search hit with what is shown of its chunk: defaults for what is missing, the text's beginning, a rounded score."""
    hits = table(s, d, "search_hits").select("hit_id", "query_id", "hit_rank", "score", "chunk_id")
    shown = lambda c, other: F.coalesce(F.col(c), F.lit(other)).alias(c)
    fields = [shown(c, "") for c in ("law_name", "authority", "article_num", "status")]
    return hits.join(_chunks(s, d), "chunk_id").select("hit_id", "query_id", "hit_rank", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), "chunk_id", shown("source", "未知文件"), shown("doc_type", "law"), *fields, F.md5(F.substring(F.coalesce("text", F.lit("")), 1, 300)).alias("text"))


def q_prompt_with_facts(s: SparkSession, d: str) -> DataFrame:
    """The numbered blocks of each query's best hits, with kind, source and article, and behind them up to eight facts on their laws."""
    # fixed values: what the kinds of documents are called
    kind = F.when(F.col("doc_type") == "case", "案例").when(F.col("doc_type") == "other", "其它资料").otherwise("法规")
    article = F.when(F.coalesce("article_num", F.lit("")) != "", F.concat(F.lit("  "), "article_num")).otherwise("")
    hits = table(s, d, "search_hits").select("query_id", "hit_rank", "hit_id", "chunk_id").join(_chunks(s, d), "chunk_id")
    rows = hits.select(F.col("query_id").alias("qid"), F.col("hit_rank").alias("rank"), F.col("hit_id").alias("id"), F.concat(kind, F.lit(" "), F.coalesce("source", F.lit("未知文件")), article).alias("source"), "text", clean_name(F.col("law_name")).alias("law"))
    best = first_each(rows, "qid", 5, "rank", "id")
    facts = first_each(_edge(s, d, "RELATES_TO").select(F.col("src").alias("law"), F.format_string("- 法规关系: %s --%s--> %s", "src", "relation_type", "dst").alias("fact")), "law", 8, "fact")
    told = first_each(best.select("qid", "law").distinct().join(facts, "law").select("qid", "fact").distinct(), "qid", 8, "fact")
    bullets = told.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("fact")), "\n").alias("facts"))
    both = prompt_blocks(best.drop("law")).join(bullets, "qid", "left")
    return both.select("qid", F.md5(F.concat("context", F.coalesce(F.concat(F.lit("\n\n【图谱补充关系】\n"), "facts"), F.lit("")))).alias("prompt"), F.col("facts").isNotNull().alias("has_facts"))


def q_name_shapes(s: SparkSession, d: str) -> DataFrame:
    """How candidates' names begin and end: with the region or suffix of a reference name of the kind, or neither."""
    own = table(s, d, "canonical_names").select("kind", F.substring("full_name", 1, 2).alias("head"), F.substring("full_name", -2, 2).alias("tail"))
    # as many as there are kinds, of words of two characters
    words = own.groupBy("kind").agg(F.collect_set("head").alias("heads"), F.collect_set("tail").alias("tails"))
    c = table(s, d, "dictionary_candidates").select("kind", "name").join(F.broadcast(words), "kind")
    starts, ends = (F.coalesce(F.exists(w, test), F.lit(False)) for w, test in (("heads", lambda x: F.startswith("name", x)), ("tails", lambda x: F.endswith("name", x))))
    return c.select("kind", starts.alias("starts"), ends.alias("ends")).groupBy("kind", "starts", "ends").agg(F.count("*").alias("n"))


def q_line_parse(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.regexp_replace(without_number(F.col("x")), r"^\s+|\s+$", "").alias("x"))
    return lines.where("length(x) >= 8").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"))


def q_hash_sample(s: SparkSession, d: str) -> DataFrame:
    return hash_sample(table(s, d, "chunks").select("row_id"), F.col("row_id"), 1 / 3)


def q_exact_dups(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


# --- events and summaries


def q_events_hourly(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def q_events_session(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def q_events_json(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


def q_docs_cube(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").cube("lang", "doc_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


_REL = "case " + " ".join(f"when contains(h, '{w}') then '{r}'" for w, r in (("根据", "basis"), ("依据", "basis"), ("依照", "basis"), ("按照", "basis"), ("遵循", "basis"), ("落实", "implements"), ("贯彻", "implements"), ("适用", "applies"), ("参照", "references"), ("配合", "supporting"), ("配套", "supporting"), ("上位法", "parent_law"))) + " else 'related' end"
_DEF = " or ".join(f"contains(text, '{w}')" for w in ("是指", "包括", "称为", "以下简称", "定义为"))
_TDATE = "case when regexp_matches(title, '_\\d{8}$') then regexp_replace(regexp_extract(title, '_(\\d{8})$', 1), '^(....)(..)', '\\1-\\2-') else '' end"
_TLAW = "regexp_replace(title, '_\\d{8}$', '')"
_DATED = f"dated as (select distinct * from (select {_NAME} law_name, strftime({_DATE}, '%Y-%m-%d') effective_date from chunks) where law_name is not null and effective_date is not null)"
_REFS = f"""art as (select distinct * from (select {_NAME} law, {_article("article_num")} article, chunk_id dst from chunks where trim(chunk_id) <> '') where law is not null and article is not null),
  refs as (select * from (select distinct chunk_id src, {_NAME.replace("law_name", "target_law")} law, {_article("target_article")} article, relation_type from article_refs) join art using (law, article) where src is not null),
  bel as (select chunk_id src, {_NAME} dst from cur where {_NAME} is not null),
  iss as (select distinct b.dst src, canonical dst from bel b join ct on ct.id = b.src and kind = 'authority'),
  rel as (select distinct b.dst src, {_NAME.replace("law_name", "target_law")} dst, relation_type from article_refs r join bel b on r.chunk_id = b.src where relation_type is not null and {_NAME.replace("law_name", "target_law")} <> b.dst),
  men as (select ct.id src, canonical dst, case when {_DEF} then 'DEFINES' else 'MENTIONS' end as type from ct join cur on cur.chunk_id = ct.id where kind = 'term'),
  doc as (select dst node from bel union select dst from rel),
  ed as (select 'BELONGS_TO' as type, src, dst, null::varchar relation_type from bel
    union all select 'REFERENCES', src, dst, null from (select distinct src, dst from refs where src in (select chunk_id from cur))
    union all select 'ISSUED_BY', src, dst, null from iss union all select 'RELATES_TO', src, dst, relation_type from rel union all select type, src, dst, null from men)"""
_G = f"with {_CHUNKS}, {_ALIASES}, texts as (select chunk_id id, concat_ws(chr(10), source, authority, text) as text from cur), ct as ({_contained('texts', 'aliases')}), {_REFS}"


def _ways() -> str:
    """SQL of the ways from a law, term, article number or authority to chunks."""
    ways = [
        ("law", 1, "'belongs_to'", "v, id from lawc"), ("law", 2, "'related_document_' || relation_type", "r.src v, l.id from rel r join lawc l on l.v = r.dst"),
        ("term", 1, "'defines'", "dst v, src id from men where type = 'DEFINES'"), ("term", 1, "'mentions'", "dst v, src id from men where type = 'MENTIONS'"),
        ("term", 2, "'references_term_definer'", "m.dst v, e.src id from ed e join men m on m.src = e.dst and m.type = 'DEFINES' where e.type = 'REFERENCES'"),
        ("article", 1, "'references_article'", f"{_article('article_num')} v, e.src id from ed e join cur on cur.chunk_id = e.dst where e.type = 'REFERENCES' and {_article('article_num')} is not null"),
        ("authority", 2, "'issued_by_authority'", "i.dst v, l.id from iss i join lawc l on l.v = i.src"),
    ]
    each = [f"select '{kind}' kind, v, {b} branch, {n} path_length, relation, id from (select distinct {name} relation, {rest}) qualify row_number() over (partition by v order by id, relation) <= 10" for b, (kind, n, name, rest) in enumerate(ways)]
    return "lawc as (select dst v, src id from bel qualify row_number() over (partition by dst order by src) <= 10), ways as (" + " union all ".join(each) + ")"


_CITING = f"""cit as (select chunk_id, array_to_string(list_sort(list(distinct c)), '；') c from (select chunk_id, '《' || {_NAME.replace("law_name", "target_law")} || '》' || coalesce(target_article, '') c from article_refs where trim(chunk_id) <> '') where c is not null group by 1),
  citing as (select chunk_id, concat_ws(chr(10), text, c) as text from cur join cit using (chunk_id))"""
_PATHS = "select src, dst, path_length from (select src, dst, min(path_length) path_length from ({0}) group by all) qualify row_number() over (partition by src order by path_length, dst) <= 10"
_MINED = "select name, count(*) n from (" + " union all ".join(f"select unnest(regexp_extract_all(text, '{p}')) as name from chunks" for p in BODY_PATTERNS) + ") where length(name) >= 4 group by name"
_FIRST = "select query_text, min(hit_id) hit_id from search_hits where query_text is not null group by 1"

_MD5 = "md5({0})"
SQL = {
    "clean_text": r"""with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ' '), '\r\n?', chr(10), 'g'), '[ \t\f]*\n[ \t\f]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\f\n]+|[ \t\f\n]+$', '', 'g') t from documents) select doc_id, md5(t) cleaned, length(t) n from c""",
    "char_windows": "select doc_id, i, md5(substr(text, i * 412 + 1, 512)) piece from (select doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 412))::bigint + 1)) i from documents where length(text) > 0)",
    "section_split": r"with p as (select parsed_id, list_filter(list_transform(string_split(regexp_replace(full_text, '(第[零一二三四五六七八九十百千万\d]+条)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l from parsed_docs) select parsed_id, i - 1 i, md5(l[i]) piece from (select parsed_id, l, unnest(range(1, len(l) + 1)) i from p)",
    "chunk_articles": rf"with h as (select row_id, regexp_extract(text, '第[零一二三四五六七八九十百千万\d]+条') heading from chunks) select row_id, heading, {_article('heading')} number from h where heading <> ''",
    "cn_number": f"with h as (select article_num, {_article('article_num')} n from chunks where regexp_matches(article_num, '第[零一二三四五六七八九十百千0-9]+条')) select article_num, n::bigint n, count(*) as rows from h group by all",
    "title_metadata": rf"""select parsed_id, {_TLAW} law_name, {_TDATE} effective_date,
        case when length(regexp_replace(trim(regexp_extract(title, '^(.*?)关于', 1)), '(办公室|秘书处)$', '')) >= 4 then regexp_replace(trim(regexp_extract(title, '^(.*?)关于', 1)), '(办公室|秘书处)$', '')
          else coalesce(list_filter(string_split(file_path, '/'), lambda p: regexp_matches(p, '监管(分)?局$'))[1], '') end authority from parsed_docs""",
    "paragraph_chunks": r"select doc_id, i - 1 i, md5(substr(l[i], 1, 300)) piece from (select doc_id, l, unnest(range(1, len(l) + 1)) i from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10) || chr(10)) l from documents)) where length(l[i]) >= 30",
    "ocr_decision": r"with p as (select parsed_id, list_transform(coalesce(pages, []), lambda p: length(regexp_replace(coalesce(p.text, ''), '^\s+|\s+$', '', 'g'))) z from parsed_docs) select parsed_id, len(z) = 0 or list_sum(z) < 80 or len(list_filter(z, lambda x: x = 0)) >= 0.5 * len(z) needs_ocr from p",
    "version_status": f"with {_DATED} select law_name, effective_date, case when effective_date = max(effective_date) over (partition by law_name) then '有效' else '已修订' end derived from dated",
    "single_file_status": f"with {_DATED}, l as (select law_name, max(effective_date) last from dated group by 1) select parsed_id, case when {_TDATE} < last then '已修订' else '有效' end derived from parsed_docs left join l on l.law_name = {_TLAW}",
    "upsert_latest": f"with {_CHUNKS} select chunk_id, row_id, md5(text) as text from cur",
    "graph_nodes": f"{_G} select 'Document' label, node from doc union all select 'Article', chunk_id from cur union all select distinct 'Authority', full_name from canonical_names where kind = 'authority' union all select distinct 'Term', full_name from canonical_names where kind = 'term'",
    "graph_edges": f"{_G} select type, count(*) n from ed group by 1",
    "graph_edge_rows": f"{_G} select * from ed",
    "related_1hop": f"{_G} {_PATHS.format('select src, dst, 1 path_length from refs')}",
    "related_2hop": f"""{_G}, dir as (select distinct src, dst from rel) {_PATHS.format('''select src, dst, 1 path_length from dir union all select a.src, b.dst, 2 from dir a join dir b on a.dst = b.src where a.src <> b.dst
      union all select a.src, b.src, 2 from iss a join iss b on a.dst = b.dst where a.src <> b.src''')}""",
    "related_articles": f"""{_G}, {_ways()}, q as (select ref_id qid, chunk_id, {_NAME.replace("law_name", "target_law")} law, {_article("target_article")} article from article_refs where ref_id % 20 = 0),
      asked as (select qid, 'law' kind, law v from q where law is not null union select qid, 'article', article from q where article is not null union select qid, kind, canonical from q join ct on ct.id = q.chunk_id where kind in ('term', 'authority')),
      one as (select qid, id, path_length, branch, relation from asked join ways using (kind, v) qualify row_number() over (partition by qid, id order by path_length, branch, relation) = 1)
      select qid, id, path_length, relation from one qualify row_number() over (partition by qid order by path_length, branch, id) <= 10""",
    "graph_facts": f"""{_G} select distinct fact from (
      select src || ' ' || relation_type || ' 《' || law || '》第' || article || '条' fact from refs where relation_type is not null
      union all select '法规关系: ' || src || ' --' || relation_type || '--> ' || dst from rel
      union all select '发布关系: ' || dst || ' 发布或关联 ' || src from iss
      union all select '术语关系: ' || m.dst || ' 出现在 ' || {_NAME} || ' 第' || coalesce({_article('article_num')}, '未标注条号') || '条' from men m join cur on cur.chunk_id = m.src where {_NAME} is not null)""",
    "extract_refs": rf"""with {_CHUNKS}, {_CITING}, m as (select chunk_id, unnest(regexp_extract_all(text, '《([^》]{{2,60}})》\s*第\s*([零一二三四五六七八九十百千\d]+)\s*条')) x from citing)
      select distinct chunk_id, regexp_extract(x, '《([^》]+)》', 1) law, {_article("regexp_extract(x, '》[^第]*第([^条]+)条$', 1)")} article from m""",
    "doc_references": f"with {_CHUNKS}, {_CITING} select distinct chunk_id, unnest(regexp_extract_all(text, '《([^》]{{2,80}})》', 1)) title from citing",
    "authorities_in_texts": f"""with {_ALIASES}, t as (select parsed_id id, concat_ws(chr(10), title, full_text) as text from parsed_docs), au as (select * from aliases where kind = 'authority'),
      m as (select distinct id, name from ({" union all ".join(f"select id, unnest(regexp_extract_all(text, '{p}')) as name from t" for p in BODY_PATTERNS)}))
      select distinct id parsed_id, canonical authority from (select id, canonical from ({_contained('t', 'au')}) union all select id, coalesce(canonical, name) from m left join au on lower({_strip("name")}) = au.alias)""",
    "relation_rules": f"select {_REL} relation, count(*) n from (select substr(text, 1, 400) h from chunks) group by 1",
    "regex_mining_counts": _MINED,
    "new_authorities": f"with {_ALIASES}, c as ({_MINED} order by n desc, name limit 100) select name, n from c where lower(name) not in (select alias from aliases) and n >= 3",
    "law_years": f"select {_TLAW} law_name, array_to_string(list_sort(list(distinct substr({_TDATE}, 1, 4))), ',') found_years, max(substr({_TDATE}, 1, 4)) latest_year from parsed_docs where {_TDATE} <> '' group by 1",
    "tfidf_topk": rf"""with d as (select doc_id id, unnest({TOK.format('text')}) token from documents), e as (select token, id, count(*) n from d where not regexp_matches(token, '^\d+$|^[一二三四五六七八九十百千万亿]') group by all),
      g as (select token, sum(n)::bigint tf, count(*) df from e group by token)
      select token, tf, df, round(tf * ln((select count(*) from documents) / df), 4) weight from g order by weight desc, token limit 500""",
    "new_terms": f"with {_OWN} select candidate_id, name from dictionary_candidates where kind = 'term' and length(name) >= 3 and len(regexp_extract_all(name, '[一-鿿]')) >= 2 and lower(name) not in (select alias from own)",
    "dict_merge": """with u as (select kind, full_name as name, category, canon_id id, 0 origin from canonical_names union all select kind, name, category, candidate_id, 1 from dictionary_candidates where name is not null)
      select kind, name, category, origin from u qualify row_number() over (partition by kind, name order by origin, id) = 1""",
    "ordered_dedup": f"select row_number() over (order by hit_id) pos, query_text from ({_FIRST})",
    "resume_pending": f"select query_text, hit_id from ({_FIRST}) where query_text not in (select query_text from search_hits where query_text is not null and searched_at < timestamp '2023-04-01')",
    "train_split": """with f as (select query_text, min_by(chunk_id, hit_id) chunk_id, min(hit_id) hit_id from search_hits where query_text <> '' and chunk_id <> '' group by 1)
      select query_text, chunk_id, case when row_number() over (order by hit_id) <= floor((select count(*) from f) * 0.9::double) then 'train' else 'validation' end part from f""",
    "rewrite_zip": f"""with a as (select item_id, row_number() over (order by item_id) pos from eval_items), b as (select query_text, row_number() over (order by hit_id) pos from ({_FIRST}))
      select coalesce(a.pos, b.pos) pos, item_id, query_text from a full join b on a.pos = b.pos""",
    "question_batches": "select (pos - 1) // 20 batch, count(*) n, min(item_id) first_id from (select item_id, row_number() over (order by item_id) pos from eval_items) group by 1",
    "prompt_context": f"""with {_CHUNKS}, k as (select query_id qid, law_name, substr(text, 1, 300) t, row_number() over (partition by query_id order by hit_rank, hit_id) r from search_hits join cur using (chunk_id) qualify r <= 5)
      select qid, md5(string_agg(r || '. 【' || coalesce(law_name, '') || '】' || chr(10) || coalesce(t, ''), chr(10) || chr(10) order by r)) context from k group by qid""",
    "hit_projection": f"""with {_CHUNKS} select hit_id, query_id, hit_rank, round(coalesce(score, 0), 4) score, chunk_id, coalesce(source, '未知文件') source, coalesce(doc_type, 'law') doc_type, coalesce(law_name, '') law_name, coalesce(authority, '') authority, coalesce(article_num, '') article_num, coalesce(status, '') status, md5(substr(coalesce(text, ''), 1, 300)) as text from search_hits join cur using (chunk_id)""",
    "prompt_with_facts": f"""{_G}, k as (select query_id qid, row_number() over (partition by query_id order by hit_rank, hit_id) r, {_NAME} law, text t,
        case doc_type when 'case' then '案例' when 'other' then '其它资料' else '法规' end || ' ' || coalesce(source, '未知文件') || case when coalesce(article_num, '') <> '' then '  ' || article_num else '' end s
        from search_hits join cur using (chunk_id) qualify r <= 5),
      f as (select src law, '- 法规关系: ' || src || ' --' || relation_type || '--> ' || dst fact from rel qualify row_number() over (partition by law order by fact) <= 8),
      g as (select qid, fact from (select distinct qid, fact from k join f using (law)) qualify row_number() over (partition by qid order by fact) <= 8),
      b as (select qid, string_agg(fact, chr(10) order by fact) facts from g group by 1)
      select qid, md5(string_agg(r || '. 【' || s || '】' || chr(10) || coalesce(t, ''), chr(10) || chr(10) order by r) || coalesce(chr(10) || chr(10) || '【图谱补充关系】' || chr(10) || any_value(facts), '')) prompt, any_value(facts) is not null has_facts from k left join b using (qid) group by qid""",
    "name_shapes": """with w as (select kind, list(distinct substr(full_name, 1, 2)) heads, list(distinct substr(full_name, length(full_name) - 1, 2)) tails from canonical_names group by 1)
      select kind, coalesce(len(list_filter(heads, lambda x: starts_with(name, x))) > 0, false) starts, coalesce(len(list_filter(tails, lambda x: ends_with(name, x))) > 0, false) ends, count(*) n from dictionary_candidates join w using (kind) group by all""",
    "line_parse": r"""with l as (select doc_id, regexp_replace(regexp_replace(x, '^\s*\d{1,4}\s*[.、）)]\s*', ''), '^\s+|\s+$', '', 'g') x from (select doc_id, unnest(string_split(text, chr(10))) x from documents))
      select doc_id, count(*) n, sum(length(x))::bigint chars from l where length(x) >= 8 group by 1""",
    "hash_sample": "select row_id from chunks where ('0x' || substr(md5(row_id::varchar), 1, 8))::bigint < 1431655765",
    "exact_dup_groups": "select min(doc_id) first_id, count(*) n from documents where text is not null group by text having count(*) > 1",
    "events_hourly": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) n, round(sum(value), 4) total from events group by all",
    "events_session": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end s from events window w as (partition by user_id order by ts)),
      n as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from g), c as (select user_id, k, count(*) n from n group by all)
      select user_id, count(*) sessions, max(n) longest from c group by 1""",
    "events_json": "select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint k, count(json_extract_string(props, '$.k')) n from events group by 1",
    "docs_cube": "select lang, doc_type, count(*) n, sum(n_chars)::bigint chars, grouping(lang, doc_type) as level from documents group by cube(lang, doc_type)",
}
_NAMED = {"chunk_articles": q_chunk_articles, "tfidf_topk": q_tfidf, "exact_dup_groups": q_exact_dups, "regex_mining_counts": q_regex_mining}
QUERIES = {k: v for k, v in ((n.removeprefix("q_"), f) for n, f in list(globals().items()) if n.startswith("q_")) if v not in _NAMED.values()} | _NAMED

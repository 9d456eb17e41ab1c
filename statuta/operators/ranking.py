"""Retrieval for a table of queries at once: BM25, exact and approximate nearest neighbours, term index, fusion."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.text import tokens
from statuta.session import scratch, small_enough

K1, B, RRF_K = 1.5, 0.75, 60
#: Tokens of queries that are sent to all tasks; with more, postings and queries meet in a shuffle.
TERMS_AT_MOST = 500_000


def equalities(**wanted: str | None) -> Column:
    """All given equalities; an empty or null value asks for nothing."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items() if v], F.lit(True))


def top(scored: DataFrame, k: int, query: str = "qid", item: str = "id", score: str = "score") -> DataFrame:
    """The ``k`` best of each query with their ``rank``; equal scores go by the id."""
    w = W.partitionBy(query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def each_token(rows: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep`` and ``token`` for each of the ``tokens``.

    The outer explode keeps the planner from filtering on the tokens' number first, which would
    take every text apart twice.
    """
    return rows.select(*keep, F.explode_outer("tokens").alias("token")).where("token is not null")


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 10, keep: Column | None = None) -> DataFrame:
    """(``qid``, ``id``, ``score``, ``rank``): one search of a corpus that has no index yet (see ``index``).

    ``corpus``: ``id``, ``tokens`` and the fields that ``keep`` reads; ``queries``: ``qid``, ``tokens``.
    """
    from statuta.operators.index import build, search

    folder = f"{scratch(corpus.sparkSession)}/statuta-{uuid.uuid4().hex}"
    return search(build(corpus, folder, *[c for c in corpus.columns if c not in ("id", "tokens")]), queries, k, keep)


def _best_of_block(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, tags: list[tuple[np.ndarray, np.ndarray, bool]]) -> pd.DataFrame:
    """The ``k`` best of a block of vectors for each of a block of queries; ``tags``: what vectors have, what queries want, and whether that may be nothing."""
    by_id = np.argsort(ids, kind="stable")
    ids, units, asked = ids[by_id], _unit(vectors[by_id]), _unit(queries).T
    kept: list[pd.DataFrame] = []
    for a in range(0, len(ids), 1024):
        dots = np.round(units[a : a + 1024] @ asked, 6)
        for has, want, free in tags:
            fits = has[by_id][a : a + 1024, None] == want[None, :]
            dots = np.where(fits | np.array([w is None or w == "" for w in want])[None, :] if free else fits, dots, -np.inf)
        n = min(k, len(dots))
        # ties at the edge go by id: the vectors are in order, the sorting is stable
        order = np.argsort(-dots, axis=0, kind="stable")[:n]
        s = np.take_along_axis(dots, order, 0)
        out = pd.DataFrame({"qid": np.repeat(qids[None, :], n, 0).ravel(), "id": ids[a + order].ravel(), "score": s.ravel()})
        kept.append(out[out["score"] > -np.inf])
    out = pd.concat(kept)
    if len(kept) > 1:
        out = out.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid").head(k)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, same: str | None = None, most: int = 20_000, fits: list[tuple[str, str]] | None = None, block: int = 20_000) -> DataFrame:
    """(``qid``, ``id``, ``score``, ``rank``): the ``k`` vectors with the highest cosine for each query, exactly.

    ``vectors``: ``id``, ``vector``; ``queries``: ``qid``, ``vector``. With ``same`` only pairs that
    agree in that column count; with ``fits``, (column of vectors, column of queries), those that
    have what the query wants, where null and empty want nothing. Zero vectors have cosine 0 with
    all; null vectors are left out.

    Up to ``most`` queries are sent to all tasks. More meet the vectors on the executors, both sides
    in blocks of about ``block``: each pair of blocks is one group, a matrix product that keeps the
    ``k`` best. In both ways only ``k`` rows a query and block leave a task.
    """
    pairs = [(same, same, False)] if same else []
    pairs += [(v, q, True) for v, q in fits or []]
    # own names, as both sides may come of one table
    q = queries.where(F.col("vector").isNotNull()).select("qid", F.col("vector").alias("asked"), *[F.col(c).alias(f"want_{c}") for c in dict.fromkeys(c for _, c, _ in pairs)])
    v = vectors.where(F.col("vector").isNotNull()).select("id", "vector", *dict.fromkeys(c for c, _, _ in pairs))
    out = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"

    def of_block(pv: pd.DataFrame, pq: pd.DataFrame) -> pd.DataFrame:
        tags = [(pv[a].to_numpy(object), pq[f"want_{b}"].to_numpy(object), free) for a, b, free in pairs]
        return _best_of_block(pv["id"].to_numpy(), np.array(pv["vector"].tolist(), np.float64), pq["qid"].to_numpy(), np.array(pq["asked"].tolist(), np.float64), k, tags)

    if small_enough(q, most):
        sent = vectors.sparkSession.sparkContext.broadcast(q.toPandas())

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pv in batches:
                if len(pv) and len(sent.value):
                    yield of_block(pv, sent.value)

        return top(v.mapInPandas(best, out), k).select("qid", "id", "score", "rank")
    many = [max(1, -(-df.count() // block)) for df in (v, q)]
    placed = lambda df, key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = v.withColumn("__v", placed(v, "id", many[0])).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))))
    right = q.withColumn("__q", placed(q, "qid", many[1])).withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(many[0] - 1))))
    # a group has about ``block`` rows of either side
    met = left.groupBy("__v", "__q").cogroup(right.groupBy("__v", "__q"))
    empty = pd.DataFrame({"qid": [], "id": [], "score": []})
    return top(met.applyInPandas(lambda pv, pq: of_block(pv, pq) if len(pv) and len(pq) else empty, out), k).select("qid", "id", "score", "rank")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def hashed_embedding(postings: DataFrame, size: int = 64) -> DataFrame:
    """Stand-in for a trained embedding: (``id``, ``dim``, ``weight``), the unit vector of a document's tokens, hashed to ``size`` places.

    ``postings``: ``id``, ``token``, ``tf``. Only places that aren't 0 have a row; documents without tokens have none.
    """
    dim = F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("long") % size
    counts = postings.groupBy("id", dim.alias("dim")).agg(F.sum("tf").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("id")))
    return counts.select("id", "dim", F.round(F.col("n") / norm, 6).alias("weight"))


def hashed_vectors(postings: DataFrame, size: int = 64) -> DataFrame:
    """(``id``, ``vector``) of ``hashed_embedding``, with all places."""
    places = hashed_embedding(postings, size).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))  # ``size`` entries at most
    return places.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def cell_index(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(``id``, ``vector``, ``cell``) of every vector, and the cells' centres.

    The centres are fitted on at most ``sample`` vectors, chosen by the hash of their ids; all
    vectors are indexed. There are as many cells as the root of the number of vectors, of which the
    sample must have sixteen each.
    """
    own = vectors.where(F.col("vector").isNotNull())
    if cells is None:
        cells = max(1, min(round(own.count() ** 0.5), sample // 16))
    fit = np.array([r.vector for r in own.orderBy(F.xxhash64("id"), "id").select("vector").limit(sample).collect()], np.float64)
    fit = _unit(fit)
    rng = np.random.default_rng(seed)
    centres = fit[rng.permutation(len(fit))[:cells]]
    for _ in range(10):
        near = (fit @ centres.T).argmax(1)
        centres = _unit(np.array([fit[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))]))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series((_unit(np.array(v.tolist(), np.float64)) @ centres.T).argmax(1) if len(v) else np.zeros(0, int))

    return own.select("id", "vector", cell("vector").alias("cell")), centres


def nearest_by_cells(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, share: float = 0.65, block: int = 20_000) -> DataFrame:
    """As ``nearest``, looking only into the ``share`` of cells whose centres are closest to the query; recall depends on ``share``.

    Cells of more than ``block`` vectors are met in parts; each part is one group with the queries that look into its cell.
    """
    probe = max(1, round(share * len(centres)))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series([row.tolist() for row in np.argsort(-(_unit(np.array(v.tolist(), np.float64)) @ centres.T), axis=1)[:, :probe]] if len(v) else [], dtype=object)

    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    split = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")  # a row a cell
    asked = queries.where(F.col("vector").isNotNull()).select("qid", F.col("vector").alias("asked"), F.explode(cells("vector")).alias("cell")).join(F.broadcast(parts), "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, score double"
    empty = pd.DataFrame({"qid": [], "id": [], "score": []})

    def of_cell(pv: pd.DataFrame, pq: pd.DataFrame) -> pd.DataFrame:
        if not len(pv) or not len(pq):
            return empty
        return _best_of_block(pv["id"].to_numpy(), np.array(pv["vector"].tolist(), np.float64), pq["qid"].to_numpy(), np.array(pq["asked"].tolist(), np.float64), k, [])

    return top(split.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(of_cell, kinds), k).select("qid", "id", "score", "rank")


def term_rank(postings: DataFrame, n_docs: DataFrame, queries: DataFrame, k: int = 10, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(``qid``, ``id``, ``match_count``, ``score``, ``rank``): documents by the number of the query's terms, then by their rarity.

    ``postings``: ``term``, ``id``; ``queries``: ``qid``, ``term``; ``n_docs``: one row ``n``. ``keep``
    takes the scored rows and gives back those that may come out; the statistics are those of all documents.
    """
    df = postings.groupBy("term").agg(F.count_distinct("id").alias("df"))
    terms = queries.distinct().join(df, "term").join(F.broadcast(n_docs))  # one row
    both = postings.distinct().join(terms, "term").groupBy("qid", "id").agg(F.count("*").alias("match_count"), F.sum(F.ln(1 + F.col("n") / F.col("df"))).alias("idf"))
    if keep is not None:
        both = keep(both)
    return top(both.select("qid", "id", "match_count", F.round(F.col("match_count") + 0.001 * F.col("idf"), 6).alias("score")), k)


def fused(lists: DataFrame, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (``qid``, ``id``, ``rrf_score``, ``first_list``, ``rank``).

    ``lists``: ``qid``, ``list`` (number of the list), ``id``, ``rank`` in it. Equal scores go by the
    first list and the rank there, then by the id; null ids count for nothing.
    """
    each = lists.where(F.col("id").isNotNull()).groupBy("qid", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("rrf_score"), F.min(F.struct("list", "rank")).alias("first"))
    w = W.partitionBy("qid").orderBy(F.desc("rrf_score"), "first", "id")
    ranked = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("qid", "id", "rrf_score", F.col("first.list").alias("first_list"), "rank")


def appended(hits: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """``hits`` (``qid``, ``id``, ``score``, ``rank``), and behind them what ``links`` (``id``, ``other``) relates to them.

    At most ``most`` a query, of the best hit first, then by id, with a score of 0; nothing that is a hit already.
    """
    others = hits.select("qid", "id", "rank").join(links, "id").groupBy("qid", F.col("other").alias("id")).agg(F.min("rank").alias("of"))
    others = others.join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    others = others.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("of", "id"))).where(F.col("n") <= most)
    last = hits.groupBy("qid").agg(F.max("rank").alias("last"))
    more = others.join(last, "qid").select("qid", "id", F.lit(0.0).alias("score"), (F.col("last") + F.col("n")).cast("int").alias("rank"), F.lit(True).alias("from_graph"))
    return hits.withColumn("from_graph", F.lit(False)).unionByName(more)


def overlap_rerank(hits: DataFrame, k: int = 5) -> DataFrame:
    """Stand-in for a trained reranker: the share of the query's distinct tokens that the document has, best ``k`` a query.

    ``hits``: ``qid``, ``id``, ``query``, ``text``.
    """
    asked = F.array_distinct(tokens(F.col("query")))
    share = F.size(F.array_intersect(asked, tokens(F.col("text")))) / F.greatest(F.lit(1), F.size(asked))
    return top(hits.select("qid", "id", F.round(share, 6).alias("score")), k)


def confidence(hits: DataFrame) -> DataFrame:
    """(``qid``, ``retrieval``, ``coverage``, ``total``) of an answered query from its hits (``qid``, ``score``, ``text``, ``answer``).

    ``coverage``: the share of hits of which one of the first ten words, within 100 characters,
    stands in the answer; ``total`` is 0.6 retrieval + 0.4 coverage.
    """
    first = F.slice(F.filter(F.split(F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 100)), r"\s+"), lambda w: w != ""), 1, 10)
    match = F.exists(first, lambda w: F.contains(F.lower("answer"), w))
    each = hits.select("qid", F.coalesce("score", F.lit(0.0)).alias("s"), F.coalesce(match, F.lit(False)).cast("int").alias("m"))
    both = each.groupBy("qid").agg(F.max("s").alias("r"), F.avg("m").alias("c"))
    return both.select("qid", F.round("r", 3).alias("retrieval"), F.round("c", 3).alias("coverage"), F.round(0.6 * F.col("r") + 0.4 * F.col("c"), 6).alias("total"))

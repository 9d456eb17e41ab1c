"""A stored full-text index: postings, terms and documents, written once and searched by tables of queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.operators.ranking import B, K1, TERMS_AT_MOST, each_token
from statuta.session import finished, small_enough


@dataclass(frozen=True)
class TextIndex:
    """``postings``: ``token``, ``id``, ``dl``, ``tf``; ``terms``: ``token``, ``df``, ``cf``; ``documents``: ``id``, ``dl`` and fields to filter by."""

    postings: DataFrame
    terms: DataFrame
    documents: DataFrame

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length in tokens."""
        r = self.documents.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("a")).first()
        return r.n, r.a


def load(spark: SparkSession, folder: str) -> TextIndex | None:
    """The index written to ``folder``, or none if it isn't there or wasn't finished."""
    if not finished(spark, f"{folder}/terms"):
        return None
    return TextIndex(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "terms", "documents")))


def build(corpus: DataFrame, folder: str, *fields: str) -> TextIndex:
    """Write the index of ``corpus`` (``id``, ``tokens``, ``fields``) to ``folder`` and read it back.

    Texts are taken apart once. Postings are counted by document and token, combined before the
    shuffle, so that a token of every document loads no single task.
    """
    spark = corpus.sparkSession
    corpus.select("id", *fields, "tokens").write.mode("overwrite").parquet(f"{folder}/corpus")
    rows = spark.read.parquet(f"{folder}/corpus")
    rows.select("id", F.size("tokens").alias("dl"), *fields).write.mode("overwrite").parquet(f"{folder}/documents")
    counted = each_token(rows, "id", F.size("tokens").alias("dl")).groupBy("token", "id", "dl").agg(F.count("*").alias("tf"))
    counted.write.mode("overwrite").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{folder}/terms")
    return load(spark, folder)


def wanted(**fields: str) -> Column:
    """Whether a document's fields equal those that the query asks for (``want_<field>``); a null or empty one asks for nothing."""
    return reduce(lambda a, b: a & b, [(F.coalesce(F.col(f"want_{k}"), F.lit("")) == "") | (F.col(f"want_{k}") == F.col(c)) for k, c in fields.items()], F.lit(True))


def scores(index: TextIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(``qid``, ``id``, ``score``): BM25 of each query (``qid``, ``tokens``; repeated tokens count) and document that share a token."""
    asked = each_token(queries, "qid").groupBy("qid", "token").agg(F.count("*").alias("times"))
    n, mean = index.stats()
    terms = asked.join(index.terms.select("token", "df"), "token")
    if small_enough(asked, TERMS_AT_MOST):
        terms = F.broadcast(F.broadcast(asked).join(index.terms.select("token", "df"), "token"))  # no more rows than ``asked``
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(mean))))
    return index.postings.join(terms, "token").groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")


def best(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` best of each ``by`` with their ``rank``; equal scores go by the id."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: TextIndex, queries: DataFrame, k: int = 10, keep: Column | None = None) -> DataFrame:
    """(``qid``, ``id``, ``score``, ``rank``): the ``k`` best documents of each query.

    ``keep`` reads the fields of documents and further columns of ``queries``; it filters what may
    come out, the statistics are those of all documents.
    """
    found = scores(index, queries)
    if keep is not None:
        fields = [c for c in index.documents.columns if c not in ("id", "dl")]
        asks = [c for c in queries.columns if c not in ("qid", "tokens")]
        found = found.join(index.documents.select("id", *fields), "id")
        if asks:
            found = found.join(queries.select("qid", *asks).distinct(), "qid")
        found = found.where(keep)
    return best(found.select("qid", "id", "score"), k, "qid").select("qid", "id", "score", "rank")


def search_branches(index: TextIndex, queries: DataFrame, branches: dict[str, Column], k: int = 10) -> DataFrame:
    """As ``search`` for each of several filters (``branch``), all from one reading of the postings."""
    fits = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in branches.items()]), lambda x: x.isNotNull())
    flagged = index.documents.select("id", F.explode(fits).alias("branch"))
    found = scores(index, queries).join(flagged, "id")
    return best(found, k, "qid", "branch").select("qid", "branch", "id", "score", "rank")

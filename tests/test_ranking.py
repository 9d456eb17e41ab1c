import math

import numpy as np
import pytest

from statuta.operators.curation import positions, split_in_order
from statuta.operators.dictionary import contained
from statuta.operators.ranking import bm25, cell_index, confidence, fused, nearest, nearest_by_cells
from statuta.operators.dictionary import by_first_rule
from statuta.operators.index import build, load, search, search_branches, wanted
from statuta.operators.ranking import appended
from statuta.session import table

FOLDER = "/root/testdata/sf0.001"


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, []), (4, None)], "id long, tokens array<string>")
    asked = spark.createDataFrame([(9, ["a", "x"])], "qid long, tokens array<string>")
    got = {r.id: r.score for r in bm25(corpus, asked).collect()}
    idf = math.log((4 - 2 + 0.5) / 2.5 + 1)
    from pyspark.sql import functions as F

    avg = corpus.agg(F.avg(F.size("tokens"))).first()[0]
    want = {1: round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)), 6), 2: round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), 6)}
    assert got == pytest.approx(want)


def test_bm25_empty(spark):
    corpus = spark.createDataFrame([], "id long, tokens array<string>")
    asked = spark.createDataFrame([(9, ["a"])], "qid long, tokens array<string>")
    assert bm25(corpus, asked).collect() == []


def test_fused_by_hand(spark):
    rows = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "b", 1), (1, 2, None, 2)]
    got = [tuple(r) for r in fused(spark.createDataFrame(rows, "qid long, list int, id string, rank int")).orderBy("rank").collect()]
    assert got == [(1, "b", round(1 / 62 + 1 / 61, 6), 1, 1), (1, "a", round(1 / 61, 6), 1, 2)]


def test_nearest_ties_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, vector array<double>")
    assert [(r.id, r.score) for r in nearest(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert nearest(v, q.limit(0), 3).collect() == []


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.withColumnRenamed("id", "qid")
    one, many = (sorted(tuple(r) for r in nearest(v, q, 3, most=m).collect()) for m in (1000, 7))
    assert one == many


def test_recall_of_cells(spark):
    v = table(spark, FOLDER, "embeddings").selectExpr("vec_id as id", "embedding as vector")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    index, centres = cell_index(v)
    assert index.count() == v.count()
    exact = {(r.qid, r.id) for r in nearest(v, q).collect()}
    found = {(r.qid, r.id) for r in nearest_by_cells(index, centres, q).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_contained_overlaps(spark):
    texts = spark.createDataFrame([(1, "资本充足率ABC"), (2, None), (3, "")], "id long, text string")
    names = spark.createDataFrame([("term", "资本", "资本"), ("term", "资本充足率", "充足率"), ("authority", "a", "短"), ("term", "abc", "缩")], "kind string, alias string, canonical string")
    assert sorted(tuple(r) for r in contained(texts, names).collect()) == [(1, "term", "充足率", 5), (1, "term", "缩", 3), (1, "term", "资本", 2)]


def test_confidence_without_scores(spark):
    hits = spark.createDataFrame([(1, None, None, "x"), (1, 0.5, "Hello you", "say hello")], "qid long, score double, text string, answer string")
    assert [tuple(r) for r in confidence(hits).collect()] == [(1, 0.5, 0.5, 0.5)]


def test_positions_and_split(spark):
    df = spark.createDataFrame([(i * i,) for i in range(1, 41)], "k long")
    assert [r.pos for r in positions(df.repartition(7), "k").orderBy("k").collect()] == list(range(1, 41))
    assert split_in_order(df, "k").where("part = 'train'").count() == 36
    assert positions(df.limit(0), "k").collect() == []


def test_text_positions(spark):
    words = ["b", "", "资本", "资产", "a", "abcd", "abc", "证", "😀"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in positions(df, "w").orderBy("pos").collect()] == sorted(words, key=lambda w: w.encode())


def test_places_of_one_outlier(spark):
    df = spark.createDataFrame([(i,) for i in range(500)] + [(10**15,)], "k long")
    assert [r.pos for r in positions(df, "k").orderBy("k").collect()] == list(range(1, 502))


def test_nearest_by_pairs_of_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "ab"[i % 2], None if i % 3 else "a") for i in range(90)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, tag string, wish string")
    q = v.withColumnRenamed("id", "qid")
    for extra in ({}, {"same": "tag"}, {"fits": [("tag", "wish")]}):
        one, many = (sorted(tuple(r) for r in nearest(v, q, 4, **extra, **o).collect()) for o in ({}, {"most": 5, "block": 16}))
        assert one == many and one


def test_index_is_stored(spark, tmp_path):
    rows = [(1, ["a", "b"], "x"), (2, ["a", "a", "c"], "y"), (3, [], "x"), (4, None, None)]
    corpus = spark.createDataFrame(rows, "id long, tokens array<string>, kind string")
    folder = str(tmp_path / "index")
    assert load(spark, folder) is None
    built = build(corpus, folder, "kind")
    asked = spark.createDataFrame([(9, ["a", "c"], None), (8, ["a"], "x"), (7, ["a"], ""), (6, ["none"], "x")], "qid long, tokens array<string>, want_kind string")
    found = lambda index: sorted((r.qid, r.id, r.rank) for r in search(index, asked, keep=wanted(kind="kind")).collect())
    assert found(built) == found(load(spark, folder)) == [(7, 1, 2), (7, 2, 1), (8, 1, 1), (9, 1, 2), (9, 2, 1)]
    from pyspark.sql import functions as F

    both = search_branches(built, asked.drop("want_kind"), {"x": F.col("kind") == "x", "all": F.lit(True)})
    assert sorted((r.branch, r.id) for r in both.where("qid = 9").collect()) == [("all", 1), ("all", 2), ("x", 1)]
    empty = build(corpus.limit(0), str(tmp_path / "none"), "kind")
    assert search(empty, asked.drop("want_kind")).collect() == []


def test_what_the_graph_appends(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2), (2, "a", 0.1, 1)], "qid long, id string, score double, rank int")
    links = spark.createDataFrame([("a", "b"), ("a", "z"), ("b", "c"), ("b", "z")], "id string, other string")
    got = sorted(tuple(r) for r in appended(hits, links).where("from_graph").collect())
    assert got == [(1, "c", 0.0, 4, True), (1, "z", 0.0, 3, True), (2, "b", 0.0, 2, True), (2, "z", 0.0, 3, True)]


def test_many_rules(spark):
    rules = spark.createDataFrame([(f"k{i}", f"c{i}", i) for i in range(10_050)] + [("Ab", "first", -1)], "keyword string, category string, priority long")
    names = spark.createDataFrame([("k77 of it",), ("Ab k5",), ("ab",), (None,)], "name string")
    got = {r.name: r.category for r in by_first_rule(names, "name", rules).collect()}
    assert got == {"k77 of it": "c7", "Ab k5": "first", "ab": "其他", None: "其他"}

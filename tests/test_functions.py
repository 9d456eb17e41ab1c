import pytest
from pyspark.sql import functions as F

from statuta.functions.notation import article_key, clean_date, clean_name, clean_status, cn_number
from statuta.functions.text import char_windows, clean_text, mapped_score, tokens
from statuta.operators.splitting import chunks_of


def values(spark, f, xs, kind="string"):
    df = spark.createDataFrame([(x,) for x in xs], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x")).alias("y")).collect()]


def test_numbers(spark):
    known = {"一": 1, "十": 10, "十二": 12, "二十": 20, "一百零三": 103, "一百一十": 110, "一千二百六十": 1260, "一千零三": 1003, "十万": 100000, "一百二十万三千": 1203000, "１２": 12, "附则": None, "": None, None: None}
    assert values(spark, cn_number, list(known)) == list(known.values())


def test_articles(spark):
    known = {"第十三条": "13", " 第 13 条": "13", "１３": "13", "十三条第二款": "13", "第十三条之一": "13之1", "附则": "附则", "": None, " ": None, None: None}
    assert values(spark, article_key, list(known)) == list(known.values())


def test_dates(spark):
    known = {"2018-11-10": "2018-11-10", "20240524": "2024-05-24", " 2009-06-06": "2009-06-06", "2019-07-15 00:00:00": "2019-07-15", "2018/3/10": "2018-03-10", "2024年2月17日": "2024-02-17", "2024-13-01": None, "待定": None, "": None, None: None}
    assert values(spark, clean_date, list(known)) == list(known.values())


def test_names_and_statuses(spark):
    assert values(spark, clean_name, ["《甲法》 ", "　甲法", "甲《乙》法", " ", None]) == ["甲法", "甲法", "甲《乙》法", None, None]
    assert values(spark, clean_status, ["有效　", " 已修订", "x", None]) == ["有效", "已修订", None, None]


def test_tokens(spark):
    assert values(spark, tokens, ["资本a1 B", "", None]) == [["a1", "b", "资本"], [], []]


def test_windows_cover_and_end(spark):
    (w,) = values(spark, char_windows, ["x" * 512 + "y" * 100])
    assert [len(p) for p in w] == [512, 200]
    assert values(spark, char_windows, ["", None, "a"]) == [[], [], ["a"]]
    with pytest.raises(ValueError):
        char_windows(F.col("x"), 10, 10)


def test_clean_text(spark):
    assert values(spark, clean_text, [" a \r\n\n\n\nb\x00c ", None]) == ["a\n\nb c", None]


def test_mapped_score(spark):
    assert values(spark, mapped_score, [1.0000001, 0.5, -0.1, -1.0], "double") == [1.0, 0.5, 0.45, 0.0]


@pytest.mark.parametrize("text", ["", "短", "第一条 甲。\n第二条 乙。", "前言\n" + "第一条 " + "长句。" * 400 + "\n第二条 乙", "x" * 2000, "（一）甲\n（二）乙\n（三）丙"])
def test_chunks_bound_and_cover(text):
    for sectioned in (True, False):
        chunks = chunks_of(text, sectioned)
        assert all(len(c) <= 612 for c in chunks)
        rest = "".join(text.split())
        assert not rest or all(piece in "".join("".join(c.split()) for c in chunks) for piece in (rest[:5], rest[-5:]))

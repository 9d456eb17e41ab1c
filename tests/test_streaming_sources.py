import json

import pytest

from statuta.session import table
from statuta.sources.files import append_json, corpus_file, read_dictionary, read_question_array, read_question_lines, read_questions, read_texts, write_table
from statuta.streaming.incremental import current, hourly, last_versions, newest, upserts

FOLDER = "/root/testdata/sf0.001"


def drain(query):
    query.awaitTermination(180)
    assert not query.isActive and query.exception() is None


def test_upserts_keep_the_newest(spark, tmp_path):
    schema = "k string, v long, at long"
    for i, rows in enumerate([[("a", 1, 1), ("b", 1, 5)], [("a", 2, 3), ("b", 2, 4), (None, 9, 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert current(spark, f"{tmp_path}/out") is None
    drain(upserts(src, f"{tmp_path}/out", f"{tmp_path}/cp", "k", ["at", "v"]))
    assert sorted(tuple(r) for r in current(spark, f"{tmp_path}/out").collect()) == [("a", 2, 3), ("b", 1, 5)]


def test_stream_counts_equal_batch(spark, tmp_path):
    events = table(spark, FOLDER, "events").orderBy("ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = hourly(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    drain(q)
    from statuta.plans.corpus import q_events_hourly

    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, q_events_hourly(spark, FOLDER).collect()))


def test_last_versions_ignore_older(spark, tmp_path):
    schema = "law_name string, effective_date string"
    spark.createDataFrame([("a", "2020"), ("a", "2019"), ("b", None), (None, "2020")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = last_versions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("last").outputMode("update").trigger(availableNow=True).start()
    drain(q)
    assert [tuple(r) for r in spark.table("last").collect()] == [("a", "2020", 1)]


def test_newest_of_empty(spark):
    assert newest(spark.createDataFrame([], "k string, v long"), "k", ["v"]).collect() == []


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "甲法_20200101.txt").write_bytes("第一条 资本".encode())
    (tmp_path / "sub" / "乙.txt").write_bytes("银行".encode("gb18030"))
    (tmp_path / "sub" / "丙.txt").write_bytes("保险".encode("utf-16"))
    (tmp_path / "skip.pdf").write_bytes(b"%PDF")
    rows = {r.title: r.text for r in read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"甲法_20200101": "第一条 资本", "乙": "银行", "丙": "保险"}
    assert [r.value.split("\n")[0] for r in corpus_file(read_texts(spark, str(tmp_path))).collect()] == ["# 文件 1: 丙", "# 文件 2: 乙", "# 文件 3: 甲法_20200101"]


def test_json_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a", "query": "b"}\nnot json\n{"question": ""}\n')
    assert [tuple(r) for r in read_questions(spark, str(tmp_path / "q.jsonl")).collect()] == [("a", "b")]
    (tmp_path / "d.json").write_text(json.dumps({"terms": {"资本": {"aliases": ["本钱"], "category": "x"}}, "law_names": {}, "authorities": {"局": {"short": "J"}}}, ensure_ascii=False))
    assert sorted((r.kind, r["name"]) for r in read_dictionary(spark, str(tmp_path / "d.json")).collect()) == [("authority", "局"), ("term", "资本")]


@pytest.mark.parametrize("by", [None, "k"])
def test_tables(spark, tmp_path, by):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    write_table(df, str(tmp_path / "t"), by=by)
    append_json(df, str(tmp_path / "j"))
    append_json(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.json(str(tmp_path / "j")).count() == 4


def test_lists_of_questions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "一？", "x": 1}, {"question": " "}, "二？", {"other": "z"}], ensure_ascii=False), encoding="utf-8")
    assert sorted(r.question for r in read_question_array(spark, str(tmp_path / "a.json")).collect()) == ["一？", "二？"]
    (tmp_path / "b.txt").write_text("1. 一？\n\n 2、二？ \n三？\n", encoding="utf-8")
    assert sorted(r.question for r in read_question_lines(spark, str(tmp_path / "b.txt")).collect()) == ["一？", "三？", "二？"]

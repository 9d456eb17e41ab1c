import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from statuta.llm.name_mapping import forms, map_cases, numbered
from statuta.llm.term_frequency import term_frequency


def counted(texts):
    occ, rec, n = Counter(), Counter(), 0
    for x in texts:
        if x is None:
            continue
        n += 1
        s = unicodedata.normalize("NFKC", x).lower()
        terms = [s[i : i + 2] for i in range(len(s) - 1) if all("一" <= c <= "鿿" for c in s[i : i + 2])] + re.findall("[a-z0-9]+", s)
        occ.update(terms)
        rec.update(set(terms))
    return {t: (occ[t], r, "rare" if r <= 2 else "common" if r * 5 > n else None) for t, r in rec.items()}


def frequency(spark, texts):
    df = spark.createDataFrame([(t, "clash", 1) for t in texts], "text string, term string, id int")
    return {r.term: (r.occurrences, r.records, r.mark) for r in term_frequency(df, F.col("text")).collect()}


def test_against_counter(spark):
    texts = ["资本资本充足", "ＡＢc 12㎏", "资本", "资本", None, "", "İstanbul ﬁn 甲", "资x本", "😀资本😀", "a" * 5000, "资本" * 3000] + ["乙丙"] * 5 + ["q"] * 3
    assert frequency(spark, texts) == counted(texts)


def test_empty_and_all_null(spark):
    assert frequency(spark, []) == {}
    assert frequency(spark, [None, None]) == {}
    assert frequency(spark, [""]) == {}


ENTRIES = [("authority", 1, "霁坞续贷稽核事务院"), ("authority", 1, "霁坞续稽事"), ("authority", 2, "霖堤担保公证局"), ("authority", 2, "霖堤担公局"), ("term", 3, "资本充足率"), ("term", 4, "资本充足率")]


def mapped(spark, values, entries=ENTRIES, kind="authority"):
    cases = spark.createDataFrame([(kind, v, i, "clash") for i, v in enumerate(values)], "kind string, value string, row long, tokens string")
    names = spark.createDataFrame(entries, "kind string, entry long, name string")
    return {r.value: r.entry for r in map_cases(cases, names).collect()}


def test_noise_is_seen_through(spark):
    values = ["霁 坞 续 贷 稽 核 事 务 院", "霁坞续貸稽核事務院", "原霁坞续稽事", "霖堤担保公证局（筹）", "霖堤担保公证车局", "《霖堤担公局》", "霁陌续贷行业协会", "N/A", "???"]
    assert mapped(spark, values) == dict(zip(values, [1, 1, 1, 2, 2, 2, -1, -1, -1], strict=True))


def test_no_cases(spark):
    assert mapped(spark, [None, "", " ", "　", "霖堤担公局"]) == {}
    assert mapped(spark, []) == {}
    assert mapped(spark, ["甲"], []) == {"甲": -1}


def test_only_own_kind_and_ties_by_id(spark):
    assert mapped(spark, ["资本充足率 "]) == {"资本充足率 ": -1}
    assert mapped(spark, ["资本充足率 "], kind="term") == {"资本充足率 ": 3}


def test_repeated_rows_come_once(spark):
    cases = spark.createDataFrame([("term", "资本充足", 1)] * 3, "kind string, value string, row long")
    names = spark.createDataFrame(ENTRIES, "kind string, entry long, name string")
    assert map_cases(cases, names).count() == 1


def test_very_long_value(spark):
    assert mapped(spark, ["长" * 20000]) == {"长" * 20000: -1}


def test_forms_and_numbers():
    assert numbered("aba") == ["a", "b", "a2"]
    assert forms("关于ＡＢ法全文", None, ["关于"], ["全文"]) == ["关于ab法全文", "ab法"]
    assert forms("關于ＡＢ", {"關": "关"}, ["关于"]) == ["关于ab", "ab"]
    assert forms("·") == [""]


def test_noise_is_learned_from_values(spark):
    """Foldings and affixes that are in no list, and held-out values that need them."""
    bases = ["霁坞续贷稽核事务院", "霖堤担保公证局", "朔陵拨备督导中心", "岚野风险稽核厅", "澜坞拆借公证处", "珀渚处置核验署"]
    entries = [("authority", i, n) for i, n in enumerate(bases)]
    told = ["续>續", "贷>貸", "担>擔", "风>風", "险>險", "务>務", "处>處"]
    strange = lambda v: "".join(next((p[2] for p in told if p[0] == c), c) for c in v)
    # each folding in two names
    more = [("authority", 10 + i, n) for i, n in enumerate(["漪汀续贷担保局", "汐原风险处置事务署"])]
    values = [strange(n) for _, _, n in entries + more] + [f"旧{n}" for n in bases[:4]] + [n + "临设" for n in bases[:4]] + ["霖堤坦保公证局", "岚野风险久核厅"]
    held_out = {"旧" + strange(bases[0]) + "临设": 0, strange("漪汀续贷担保局") + "临设": 10, "旧" + strange("汐原风险处置事务署"): 11}
    got = mapped(spark, values + list(held_out), entries + more)
    assert {v: got[v] for v in held_out} == held_out
    assert all(got[strange(n)] == i for _, i, n in entries + more if strange(n) != n)

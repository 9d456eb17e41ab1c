"""Mapping of freely typed values to a reference list by a prefix-filtered set-similarity join."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import cut

#: Names of the reference list with which a foreign character, or an affix, must be met before it counts as one.
FOLDED_IN, AFFIXED_TO = 2, 3
#: Share of a foreign character's places at which it must stand for one and the same character.
ALWAYS = 0.8
#: Characters of an affix.
LONGEST_AFFIX = 4


def plain(value: str) -> str:
    """Letters and digits of ``value`` in form NFKC, lower-cased."""
    return "".join(c for c in unicodedata.normalize("NFKC", value).lower() if unicodedata.category(c)[0] in "LN")


def numbered(text: str) -> list[str]:
    """The characters of ``text``, the second and later ones of a kind with their number: a set that keeps repetitions."""
    seen: Counter[str] = Counter()
    out = []
    for c in text:
        seen[c] += 1
        out.append(c if seen[c] == 1 else f"{c}{seen[c]}")
    return out


def forms(value: str, foldings: dict[str, str] | None = None, before: Iterable[str] = (), behind: Iterable[str] = ()) -> list[str]:
    """The plain form with foldings, and the one without a word before or behind the name if that differs; two characters stay at least."""
    p = plain(value).translate(str.maketrans(foldings or {}))
    bare = p
    for word in sorted(before, key=len, reverse=True):
        if bare.startswith(word) and len(bare) >= len(word) + 2:
            bare = bare[len(word) :]
            break
    for word in sorted(behind, key=len, reverse=True):
        if bare.endswith(word) and len(bare) >= len(word) + 2:
            bare = bare[: -len(word)]
            break
    return [p] if bare == p else [p, bare]


def _sets(df: DataFrame, *keep: str, foldings: dict[str, str] | None = None, before: dict[str, list[str]] | None = None, behind: dict[str, list[str]] | None = None) -> DataFrame:
    """``kind``, ``keep``, and ``set`` and ``tokens`` of each form of ``text``; the words before and behind go by the kind."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("set", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])))
    def parts(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[{"set": f, "tokens": numbered(f)} for f in forms(v, foldings, (before or {}).get(k, ()), (behind or {}).get(k, ())) if f] for k, v in zip(kind, text, strict=True)], dtype=object)

    return df.select("kind", *keep, F.explode(parts("kind", "text")).alias("f")).select("kind", *keep, "f.set", "f.tokens")


def _ranked(sets: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """Tokens in the prefix of each set: those that two sets as alike as ``least`` can't both be without."""
    n = F.size("tokens")
    tokens = sets.select("kind", "set", n.alias("n"), F.explode("tokens").alias("token")).join(order, ["kind", "token"])
    place = F.row_number().over(W.partitionBy("kind", "set").orderBy("often", "token")) - 1
    return tokens.withColumn("place", place).where(F.col("place") < F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(``kind``, ``a``, ``b``) of sets (``kind``, ``set``, ``tokens``) that may have a Jaccard similarity of ``least``: no pair that has it is missing.

    The join is prefix-filtered: tokens are ordered from rare to common over both sides, sets meet
    only through the rare tokens of their prefixes, and length and position filters drop pairs that
    can't reach ``least``.
    """
    often = lambda df: df.select("kind", F.explode("tokens").alias("token"))
    order = often(left).unionByName(often(right)).groupBy("kind", "token").agg(F.count("*").alias("often"))
    lp, rp = _ranked(left, order, least), _ranked(right, order, least)
    x, y = F.col("x.n"), F.col("y.n")
    need = F.ceil((x + y) * (least / (1 + least)) - 1e-9)
    met = lp.alias("x").join(rp.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.token") == F.col("y.token")))
    met = met.where((x >= y * least - 1e-9) & (y >= x * least - 1e-9) & (1 + F.least(x - F.col("x.place") - 1, y - F.col("y.place") - 1) >= need))
    return met.select(F.col("x.kind").alias("kind"), F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()


def learned_noise(left: DataFrame, right: DataFrame, least: float = 0.5) -> tuple[dict[str, str], dict[str, list[str]], dict[str, list[str]]]:
    """Foldings of characters, and words before and behind names by kind, learned from values that equal a name but for them.

    A foreign character, one that no name of the kind has, is folded into another if values with it
    equal a name at all other places but those of foreign characters, in ``FOLDED_IN`` different names,
    and it stands for that character in ``ALWAYS`` of those places: so forms of characters that the list
    doesn't use are told from slips. A word of up to ``LONGEST_AFFIX`` characters is an affix if it stands
    before, or behind, ``AFFIXED_TO`` different whole names. The results are small: pairs of single
    characters, and words that many names have in common.
    """
    letters = right.select("kind", F.explode("tokens").alias("t")).select("kind", F.substring("t", 1, 1).alias("c")).groupBy("kind").agg(F.collect_set("c").alias("letters"))
    own = left.join(F.broadcast(letters), "kind")  # a row a kind, of no more characters than there are
    own = own.select("kind", "set", F.filter("tokens", lambda t: F.array_contains("letters", F.substring(t, 1, 1))).alias("tokens"))
    met = cut(alike_pairs(own.where(F.size("tokens") > 0), right, least))
    each = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    differ = met.where(F.length("a") == F.length("b")).withColumn("d", F.filter(each, lambda e: e["x"] != e["y"])).join(F.broadcast(letters), "kind")
    differ = differ.where(~F.exists("d", lambda e: F.array_contains("letters", e["x"]))).select("b", F.explode("d").alias("d"))
    votes = differ.groupBy("d.x", "d.y").agg(F.count("*").alias("n"), F.count_distinct("b").alias("names"))
    votes = votes.withColumn("all", F.sum("n").over(W.partitionBy("x"))).where((F.col("names") >= FOLDED_IN) & (F.col("n") >= ALWAYS * F.col("all")))
    foldings = {r.x: r.y for r in votes.select("x", "y").collect()}
    a = F.translate("a", "".join(foldings), "".join(foldings.values())) if foldings else F.col("a")
    more = met.select("kind", a.alias("a"), "b").where(F.length("a").between(F.length("b") + 1, F.length("b") + LONGEST_AFFIX) & (F.length("b") > 1))
    words = more.select("kind", "b", F.when(F.expr("startswith(a, b)"), F.struct(F.lit("behind").alias("side"), F.expr("substring(a, length(b) + 1)").alias("word"))).when(F.expr("endswith(a, b)"), F.struct(F.lit("before").alias("side"), F.expr("left(a, length(a) - length(b))").alias("word"))).alias("w"))
    words = words.where("w is not null").groupBy("kind", "w").agg(F.count_distinct("b").alias("names")).where(F.col("names") >= AFFIXED_TO)
    before: dict[str, list[str]] = {}
    behind: dict[str, list[str]] = {}
    for r in words.select("kind", "w.side", "w.word").collect():
        (before if r.side == "before" else behind).setdefault(r.kind, []).append(r.word)
    return foldings, before, behind


def map_names(values: DataFrame, entries: DataFrame, *, least: float = 0.52, edits: int = 3, alike: float = 0.7) -> DataFrame:
    """(``kind``, ``value``, ``entry``) of each distinct value that means an entry of the reference list.

    ``values``: ``kind``, ``value``; ``entries``: ``kind``, ``entry`` (id), ``name``, several names an
    entry allowed. Both are compared in plain form (NFKC, lower case, letters and digits only),
    values with the foldings of characters and also without the words around a name that all values
    teach (``learned_noise``). Of the entries of the same kind with a Jaccard similarity of at least
    ``least`` between the sets of characters (repetitions count), the most alike is kept; at equal
    similarity the one fewer edits away, then the one with the smaller id. A pair below ``alike`` must
    also be at most ``edits`` single-character edits apart. Values that mean no entry are not in the
    result; null, empty and markless values mean none. Repeated rows change nothing, empty tables give
    an empty result, other columns are ignored.

    Candidates come from a prefix-filtered join (``alike_pairs``); the similarity is checked exactly.
    """
    told = values.select("kind", F.col("value").alias("text")).dropna().distinct().withColumn("value", F.col("text"))
    named = cut(_sets(entries.select("kind", "entry", F.col("name").alias("text")).dropna().distinct(), "entry"))
    right = named.select("kind", "set", "tokens").distinct()
    foldings, before, behind = learned_noise(cut(_sets(told).distinct()), right)
    typed = cut(_sets(told, "value", foldings=foldings, before=before, behind=behind))
    left = typed.select("kind", "set", "tokens").distinct()
    pairs = alike_pairs(left, right, least)
    full = pairs.join(left.withColumnsRenamed({"set": "a", "tokens": "ta"}), ["kind", "a"]).join(right.withColumnsRenamed({"set": "b", "tokens": "tb"}), ["kind", "b"])
    same = F.size(F.array_intersect("ta", "tb"))
    full = full.withColumn("alike", same / (F.size("ta") + F.size("tb") - same)).withColumn("edits", F.levenshtein("a", "b"))
    good = full.where((F.col("alike") >= least) & ((F.col("alike") >= alike) | (F.col("edits") <= edits))).select("kind", "a", "b", "alike", "edits")
    ids = named.select("kind", F.col("set").alias("b"), "entry").distinct()
    best = good.join(ids, ["kind", "b"]).join(typed.select("kind", F.col("set").alias("a"), "value"), ["kind", "a"])
    return best.groupBy("kind", "value").agg(F.max_by("entry", F.struct("alike", -F.col("edits"), -F.col("entry"))).alias("entry"))


def map_cases(cases: DataFrame, entries: DataFrame, **options: float) -> DataFrame:
    """``cases`` (``kind``, ``value``, further columns) with ``entry``, -1 for a value that means no entry.

    Left out are null and blank values and those that equal a name of their kind character for
    character; what is left is one row for each distinct row of ``cases``.
    """
    blank = F.regexp_replace("value", r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+", "") == ""
    exact = entries.select("kind", F.col("name").alias("value")).distinct()
    open_ = cases.where(F.col("value").isNotNull() & ~blank).join(exact, ["kind", "value"], "left_anti").distinct()
    meant = map_names(open_.select("kind", "value"), entries, **options)
    return open_.join(meant, ["kind", "value"], "left").withColumn("entry", F.coalesce("entry", F.lit(-1).cast("long")))

"""Dictionary of names and aliases as a relation, and its use on texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.notation import strip
from statuta.session import small_enough

#: Aliases that one matching machine takes; a larger dictionary is matched in several passes over the texts.
ALIASES_AT_ONCE = 200_000
#: Aliases shorter than this are not looked for in texts, by kind.
SHORTEST = {"term": 1, "law": 3, "authority": 2}


def alias_relation(canonical: DataFrame, candidates: DataFrame) -> DataFrame:
    """(``kind``, ``alias``, ``canonical``): each alias, lower-cased and stripped, with the one name it stands for.

    Names and short names of the reference list come before typed ones; of several names for one
    alias the longer wins for terms, for the others the first by priority; ties go by the name.
    """
    own = canonical.select("kind", F.col("full_name").alias("canonical"), F.explode(F.array(F.struct(F.lit(0).alias("priority"), F.col("full_name").alias("a")), F.struct(F.lit(1).alias("priority"), F.col("short").alias("a")))).alias("x"))
    typed = F.concat(F.array(F.col("short")), F.coalesce("aliases", F.array().cast("array<string>")))
    other = candidates.select("kind", F.col("name").alias("canonical"), F.explode(F.transform(typed, lambda a: F.struct(F.lit(2).alias("priority"), a.alias("a")))).alias("x"))
    rows = own.unionByName(other).select("kind", "canonical", "x.priority", F.lower(strip(F.col("x.a"))).alias("alias")).where("alias <> '' and canonical is not null")
    longer = F.when(F.col("kind") == "term", -F.length("canonical")).otherwise(0)
    w = W.partitionBy("kind", "alias").orderBy("priority", longer, "canonical")
    return rows.distinct().withColumn("__n", F.row_number().over(w)).where("__n = 1").select("kind", "alias", "canonical")


def resolved(values: DataFrame, aliases: DataFrame, value: str, kind: str) -> DataFrame:
    """``values`` with ``canonical``: the name that the stripped, lower-cased ``value`` stands for, or null."""
    own = aliases.where(F.col("kind") == kind).select(F.col("alias").alias("__alias"), "canonical")
    return values.join(own, F.lower(strip(F.col(value))) == F.col("__alias"), "left").drop("__alias")


#: The machine that this worker built last, and its names, by the name of its part of the dictionary.
_BUILT: dict[str, tuple] = {}


def _machine(token: str, aliases: list[tuple[str, str, str]]) -> tuple:
    """The matching machine of ``aliases`` (``kind``, ``alias``, ``canonical``) and the names; a worker keeps its last one for the tasks that follow."""
    if token not in _BUILT:
        import ahocorasick

        names: dict[tuple[str, str], int] = {}
        by_alias: dict[str, list[int]] = {}
        for k, a, c in aliases:
            by_alias.setdefault(a, []).append(names.setdefault((k, c), len(names)))
        machine = ahocorasick.Automaton()
        for a, own in by_alias.items():
            machine.add_word(a, (len(a), own))
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[token] = machine, list(names)
    return _BUILT[token]


def contained(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(``id``, ``kind``, ``canonical``, ``length``) of the names of which an alias stands in the lower-cased ``text``.

    ``length`` is that of the longest alias found; overlapping shorter aliases count too. All
    aliases are looked for in one pass over each text (Aho-Corasick), for dictionaries above
    ``ALIASES_AT_ONCE`` in a few passes, each with a part of the aliases of that size.
    """
    shortest = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in SHORTEST.items()], F.lit(1))
    looked = aliases.where(F.length("alias") >= shortest).select("kind", "alias", "canonical")
    passes = 1 if small_enough(looked, ALIASES_AT_ONCE) else -(-looked.count() // ALIASES_AT_ONCE)
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    for p in range(passes):
        part = (looked if passes == 1 else looked.where(F.pmod(F.xxhash64("kind", "alias"), F.lit(passes)) == p)).collect()
        sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.kind, r.alias, r.canonical) for r in part]))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            machine, known = _machine(*sent.value)
            for batch in batches:
                at, which, size = [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    best: dict[int, int] = {}
                    for _, (n, own) in machine.iter(t) if t and known else ():
                        for i in own:
                            best[i] = max(best.get(i, 0), n)
                    at += [row] * len(best)
                    which += best
                    size += best.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([known[i][0] for i in which], pa.string()), pa.array([known[i][1] for i in which], pa.string()), pa.array(size, pa.int32())], ["id", "kind", "canonical", "length"])

        found = texts.select("id", F.lower("text")).mapInArrow(find, f"id {kind}, kind string, canonical string, length int")
        out = found if out is None else out.unionByName(found)
    return out if passes == 1 else out.groupBy("id", "kind", "canonical").agg(F.max("length").alias("length"))


def expanded(found: DataFrame, aliases: DataFrame, texts: DataFrame, most: int = 2) -> DataFrame:
    """(``id``, ``expanded``): each text with up to ``most`` aliases of every term found in it that it doesn't have yet.

    Aliases go by length, then by name; terms by the longest alias found, then by name.
    """
    terms = found.where("kind = 'term'").join(aliases, ["kind", "canonical"]).join(texts.select("id", "text"), "id").where(~F.contains(F.lower("text"), F.col("alias")))
    w = W.partitionBy("id", "canonical").orderBy(F.length("alias"), "alias")
    kept = terms.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    more = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("l"), "canonical", "__n", "alias"))).alias("x"))
    joined = F.array_join(F.concat(F.array("text"), F.coalesce(F.array_distinct(F.transform("x", lambda x: x["alias"])), F.array().cast("array<string>"))), " ")
    return texts.join(more, "id", "left").select("id", joined.alias("expanded"))


def by_first_rule(names: DataFrame, name: str, rules: DataFrame, default: str = "其他") -> DataFrame:
    """``names`` with ``category`` of the first rule (``priority``, ``keyword``, ``category``) whose keyword stands in the name."""
    each = names.select(F.col(name).alias("__name")).dropna().distinct()
    if small_enough(rules, 10_000):
        met = each.join(F.broadcast(rules), F.contains(F.col("__name"), F.col("keyword")))
    else:
        words = rules.select(F.lit("rule").alias("kind"), F.lower("keyword").alias("alias"), F.col("keyword").alias("canonical")).distinct()
        found = contained(each.select(F.col("__name").alias("id"), F.col("__name").alias("text")), words)
        met = found.select(F.col("id").alias("__name"), F.col("canonical").alias("keyword")).where(F.contains(F.col("__name"), F.col("keyword"))).join(rules, "keyword")
    first = met.groupBy("__name").agg(F.min_by("category", F.struct("priority", "keyword", "category")).alias("category"))
    return names.join(first, F.col(name) == F.col("__name"), "left").drop("__name").withColumn("category", F.coalesce("category", F.lit(default)))


def typed_values(c: Column) -> Column:
    """The values of a comma-separated filter, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,，、]"), strip), lambda x: x != "")

"""Full history of changing attributes from periodic snapshots, by Merkle comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.operators.buckets import current, merge_buckets
from statuta.session import cut, finished

OPEN_END = "9999-12-31"
#: Bits of a key's bucket number on each level of the tree: root, branches, leaves.
LEVELS = (0, 6, 12)
#: Buckets of the open versions; a leaf lies in one of them.
BUCKETS = 64


def latest_state(rows: DataFrame, key: str, at: str, values: list[str], newest: list[str]) -> DataFrame:
    """One row for each key and snapshot: the values of the row that is greatest by ``newest``.

    ``max_by`` combines on the map side, so a key that holds a third of all rows leaves a map task
    as one row for each snapshot.
    """
    pick = F.max_by(F.struct(*values), F.struct(*newest)).alias("__v")
    return rows.groupBy(F.col(key).alias("__key"), F.col(at).alias("__at")).agg(pick).select("__key", "__at", *[F.col(f"__v.{v}").alias(v) for v in values])


def _placed(state: DataFrame, values: list[str]) -> DataFrame:
    """``state`` with the leaf of each key and two digests of each row."""
    leaf = F.pmod(F.xxhash64("__key"), F.lit(1 << LEVELS[-1])).cast("int")
    return state.withColumn("__leaf", leaf).withColumn("__a", F.xxhash64("__key", *values)).withColumn("__b", F.xxhash64(F.lit("second"), "__key", *values))


def _xor(c: str):  # noqa: ANN202
    return F.expr(f"bit_xor({c})").alias(c)


def changed_leaves(state: DataFrame, values: list[str]) -> DataFrame:
    """The rows of ``state`` (``__key``, ``__at``, values) in leaf buckets that differ from their snapshot before.

    Keys hash into buckets of a tree. Each bucket has a digest for each snapshot in which it has
    keys, made up of its children's digests. From the root down, a bucket is looked into only where
    its digest differs from that of its last snapshot; all rows of an equal bucket repeat the
    snapshot before, so leaving them out changes no comparison of neighbouring versions.
    """
    deep = LEVELS[-1]
    rows = _placed(state, values)
    nodes = {deep: rows.groupBy("__leaf", "__at").agg(_xor("__a"), _xor("__b"))}
    for upper, lower in zip(LEVELS[-2::-1], LEVELS[:0:-1], strict=True):
        child = nodes[lower].select(F.shiftright("__leaf", lower - upper).alias("__leaf"), "__at", F.xxhash64(F.col("__leaf"), "__a").alias("__a"), F.xxhash64(F.lit("second"), "__leaf", "__b").alias("__b"))
        nodes[upper] = child.groupBy("__leaf", "__at").agg(_xor("__a"), _xor("__b"))
    open_: DataFrame | None = None
    for bits in LEVELS:
        level = nodes[bits]
        w = W.partitionBy("__leaf").orderBy("__at")
        before = F.lag(F.struct("__a", "__b")).over(w)
        # The digest before is taken over all snapshots of the bucket; only then the pruned ones go.
        level = level.withColumn("__differs", ~F.struct("__a", "__b").eqNullSafe(before))
        if open_ is not None:
            up = bits - LEVELS[LEVELS.index(bits) - 1]
            level = level.join(open_.select(F.col("__leaf").alias("__up"), F.col("__at").alias("__upat")), (F.shiftright("__leaf", up) == F.col("__up")) & (F.col("__at") == F.col("__upat")), "left_semi")
        open_ = level.where("__differs").select("__leaf", "__at")
    return rows.join(open_, ["__leaf", "__at"], "left_semi").select("__key", "__at", *values)


def versions(state: DataFrame, values: list[str]) -> DataFrame:
    """Fold neighbouring snapshots of a key with the same values into versions with ``valid_from`` and ``valid_to``."""
    w = W.partitionBy("__key").orderBy("__at")
    starts = state.withColumn("__same", F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values))).where("not __same")
    return starts.select("__key", *values, F.col("__at").alias("valid_from"), F.coalesce(F.lead("__at").over(w), F.lit(OPEN_END)).alias("valid_to"))


def attribute_history(rows: DataFrame, key: str, at: str, values: list[str], newest: list[str]) -> DataFrame:
    """History of ``values`` of each ``key`` over the snapshots named by ``at``.

    ``rows``: several rows a key and snapshot are settled by the greatest ``newest``. Rows in which
    the key, the snapshot or a value is null tell nothing and are left out. Result: key, values,
    ``valid_from`` (first snapshot of the version), ``valid_to`` (start of the key's next version,
    ``9999-12-31`` for the last). A missing snapshot ends nothing; a version that returns is a new
    row. Repeated rows change nothing, an empty table gives an empty result, other columns of
    ``rows`` are ignored whatever their names, ties in ``newest`` must be broken by its last column.
    """
    told = rows.select(F.col(key).alias("__k"), F.col(at).alias("__s"), *[F.col(v) for v in values], *[F.col(n).alias(f"__n{i}") for i, n in enumerate(newest)])
    told = told.dropna(subset=["__k", "__s", *values])
    # written once: every level of the tree reads it
    state = cut(latest_state(told, "__k", "__s", values, [f"__n{i}" for i in range(len(newest))]))
    return versions(changed_leaves(state, values), values).withColumnRenamed("__key", key)


def append_snapshot(folder: str, rows: DataFrame, key: str, at: str, values: list[str], newest: list[str]) -> int:
    """Append the snapshot ``at`` to the stored history in ``folder``; returns how many leaves of the tree it changed.

    ``rows`` as in ``attribute_history``, all of one snapshot, later than those before. Stored are
    the digests of the tree's leaves, the open version of each key in buckets, and the versions that
    each snapshot began. A leaf whose digest is that of its last snapshot is left alone; of the
    others the keys are held against their open versions, and only buckets with a new version are
    written. The digests are written last, so a snapshot that failed half-way is appended anew.
    """
    spark = rows.sparkSession
    number = _snapshots(spark, folder)
    told = rows.select(F.col(key).alias("__k"), F.lit(at).alias("__s"), *values, *[F.col(n).alias(f"__n{i}") for i, n in enumerate(newest)]).dropna(subset=["__k", *values])
    state = cut(_placed(latest_state(told, "__k", "__s", values, [f"__n{i}" for i in range(len(newest))]), values))
    digests = state.groupBy("__leaf").agg(_xor("__a"), _xor("__b")).withColumn("__at", F.lit(at))
    old = spark.read.parquet(f"{folder}/tree/version={number - 1}") if number else digests.limit(0)
    if number and old.agg(F.max("__at")).first()[0] >= at:
        raise ValueError("snapshots must be appended in order")
    before = old.select("__leaf", F.struct("__a", "__b").alias("__old"))
    # no more leaves than the tree has
    changed = [r["__leaf"] for r in digests.join(before, "__leaf", "left").where(~F.struct("__a", "__b").eqNullSafe(F.col("__old"))).select("__leaf").collect()]
    open_ = current(spark, f"{folder}/open", below=number, only=sorted({leaf % BUCKETS for leaf in changed}))
    looked = state.where(F.col("__leaf").isin(changed)).select("__key", *values)
    if open_ is not None:
        known = open_.select("__key", F.struct(*values).alias("__known"))
        looked = looked.join(known, "__key", "left").where(~F.struct(*values).eqNullSafe(F.col("__known"))).drop("__known")
    begun = looked.withColumn("valid_from", F.lit(at))
    begun.write.mode("overwrite").parquet(f"{folder}/versions/version={number}")
    merge_buckets(spark.read.schema(begun.schema).parquet(f"{folder}/versions/version={number}"), f"{folder}/open", number, "__key", ["valid_from"], BUCKETS)
    rest = old.join(digests.select("__leaf"), "__leaf", "left_anti")
    rest.unionByName(digests).coalesce(1).write.mode("overwrite").parquet(f"{folder}/tree/version={number}")
    return len(changed)


def stored_history(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The history of all snapshots appended to ``folder``, as ``attribute_history`` gives it."""
    rows = spark.read.parquet(*[f"{folder}/versions/version={n}" for n in range(_snapshots(spark, folder))])
    w = W.partitionBy("__key").orderBy("valid_from")
    return rows.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w), F.lit(OPEN_END))).withColumnRenamed("__key", key)


def _snapshots(spark: SparkSession, folder: str) -> int:
    """How many snapshots were appended to the end."""
    n = 0
    while finished(spark, f"{folder}/tree/version={n}"):
        n += 1
    return n

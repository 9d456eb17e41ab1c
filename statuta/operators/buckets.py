"""Tables of the newest row of each key, in buckets by the keys' hash, of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order``."""
    cols = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__x")).select(key, "__x.*").select(*rows.columns)


def merge_buckets(rows: DataFrame, folder: str, number: int, key: str, order: list[str], buckets: int = 64) -> None:
    """Merge ``rows`` into the table as version ``number``: buckets that their keys fall into are read as of before and written, no others."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    placed = newest(rows, key, order).withColumn("bucket", bucket)
    # no more values than there are buckets
    touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
    old = current(rows.sparkSession, folder, below=number, only=touched)
    both = placed if old is None else placed.unionByName(old.withColumn("bucket", bucket))
    newest(both, key, order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={number}")


def current(spark, folder: str, below: int | None = None, only: list[int] | None = None) -> DataFrame | None:  # noqa: ANN001
    """The last finished versions (below a number) of all buckets, or of those in ``only``, of a table written by ``upserts``; none if there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = lambda p: [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(p))]
    versions = sorted(int(n.partition("=")[2]) for n in names(folder) if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    last: dict[int, str] = {}
    for v in versions:
        if below is None or v < below:
            last |= {int(n.partition("=")[2]): f"{folder}/version={v}/{n}" for n in names(f"{folder}/version={v}") if n.startswith("bucket=")}
    paths = [p for b, p in sorted(last.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None

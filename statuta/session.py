"""Session factory and the few session-wide helpers that operators share."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries assume (UTC, adaptive execution)."""
    b = (
        SparkSession.builder.master(master)
        .appName("statuta")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this application import the package, unless their path has it; does nothing the second time.

    The package goes as a zip file through the shared scratch folder.
    """
    sc = spark.sparkContext
    here = Path(__file__).resolve().parent
    on_path = str(here.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or getattr(sc, "_statuta_shipped", None) == sc.applicationId:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/statuta-{uuid.uuid4().hex}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._statuta_shipped = sc.applicationId


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir`` of the session; a temporary one only where that is unset (tests, local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="statuta-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a table in the shared scratch folder and read it back.

    The table outlives the executors that wrote it, is compressed, and gives the planner true sizes.
    """
    path = f"{scratch(df.sparkSession)}/statuta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to ``folder`` to the end."""
    path, fs = _path(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def stored(spark: SparkSession, folder: str, name: str, tables: tuple[str, ...]) -> str:
    """Where in the scratch folder this application keeps the derived table ``name`` of ``tables`` in ``folder``.

    The place goes by the size and time of the tables' files, so that changed tables get another one.
    """
    states = [spark.sparkContext.applicationId]
    for t in tables:
        path, fs = _path(spark, f"{folder}/{t}.parquet")
        status, summary = fs.getFileStatus(path), fs.getContentSummary(path)
        states.append((t, status.getModificationTime(), summary.getLength(), summary.getFileCount()))
    digest = hashlib.sha256(repr((folder, name, states)).encode()).hexdigest()[:20]
    return f"{scratch(spark)}/statuta-{name}-{digest}"


def kept(spark: SparkSession, folder: str, name: str, tables: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """The derived table ``name``, made and written the first time it is asked for."""
    path = stored(spark, folder, name, tables)
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """True if ``df`` has at most ``most_rows`` rows; reads no more than that many."""
    return df.limit(most_rows + 1).count() <= most_rows


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` on as many partitions as there are cores, by ``key``, if a small table comes on fewer; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

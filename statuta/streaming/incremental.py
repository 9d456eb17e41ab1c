"""Incremental work on arriving rows: upserts of chunks, windowed counts with late data, last version of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statuta.operators.buckets import current, merge_buckets, newest

__all__ = ["current", "hourly", "last_versions", "newest", "upserts"]


def upserts(stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], buckets: int = 64) -> StreamingQuery:
    """Keep the newest row of each key of a stream as a table in ``buckets`` by the keys' hash.

    Batch ``n`` reads the buckets that its keys fall into, as of the batches before, and writes those
    alone as version ``n``; the others stay as they are. A batch that is run again after a failure
    gives the same table. ``current`` reads the last finished version of each bucket.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_buckets(batch, folder, number, key, order, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and event type; rows later than ``late`` behind the newest are left out."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def last_versions(stream: DataFrame) -> DataFrame:
    """(``law_name``, ``effective_date``, ``changes``) whenever a law's newest date grows; ``stream`` has the first two.

    An older date that arrives later changes nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, changes = state.get if state.exists else (None, 0)
        dates = [d for p in parts for d in p["effective_date"].dropna()]
        if dates and (last is None or max(dates) > last):
            last, changes = max(dates), changes + 1
            state.update((last, changes))
            yield pd.DataFrame({"law_name": [key[0]], "effective_date": [last], "changes": [changes]})

    return stream.where("law_name is not null").groupBy("law_name").applyInPandasWithState(step, "law_name string, effective_date string, changes long", "last string, changes long", "update", GroupStateTimeout.NoTimeout)

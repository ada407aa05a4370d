"""Page views as a stream: dedupe within a window that the last recorded view opens, and counts per window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.registry import query
from loomline.runtime import table

GAP_MS = 30 * 60 * 1000


def view_key():
    """day, path and visitor: what repeated views are judged by."""
    return [F.to_date("ts").alias("day"), F.col("event_type").alias("path"), F.col("user_id").alias("visitor")]


def dedupe_views(events: DataFrame) -> DataFrame:
    """(day, path, visitor, ts) of recorded views: a view is dropped within 30 minutes of the last *recorded* one.

    A key holds one visitor's views of one path on one day, so that its array is small; the fold over it
    stays in the JVM. Rows without a time, path or visitor aren't recorded.
    """
    keyed = events.filter("ts is not null and event_type is not null and user_id is not null").select(*view_key(), "ts")
    sorted_ts = keyed.groupBy("day", "path", "visitor").agg(F.array_sort(F.collect_list("ts")).alias("all"))
    late = lambda kept, t: (F.size(kept) == 0) | (t - F.element_at(kept, -1) > F.expr("interval 30 minutes"))
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, t: F.when((F.size(kept) == 0), F.array(t)).when(late(kept, t), F.array_append(kept, t)).otherwise(kept))
    return sorted_ts.select("day", "path", "visitor", F.explode(fold).alias("ts"))


@query()
def recorded_views(spark: SparkSession, d: str) -> DataFrame:
    """Depends on each row recorded before; tested against a sequential loop."""
    return dedupe_views(table(spark, d, "events"))


def _record(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get[0] if state.exists else None
    out = []
    for ts in sorted(t for b in batches for t in b["ts"]):
        ms = int(ts.timestamp() * 1000)
        if last is None or ms - last > GAP_MS:
            last = ms
            out.append(ts)
    state.update((last,))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 24 * 60 * 60 * 1000)
    yield pd.DataFrame({"day": [key[0]] * len(out), "path": [key[1]] * len(out), "visitor": [key[2]] * len(out), "ts": out})


def dedupe_view_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream: the state of a key is the time of its last recorded view, dropped a day after it in event time.

    Views later than `late` are dropped by the watermark.
    """
    keyed = events.select(*view_key(), F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null and path is not null and visitor is not null")
    keyed = keyed.withWatermark("ts", late)
    schema = "day date, path string, visitor long, ts timestamp"
    return keyed.groupBy("day", "path", "visitor").applyInPandasWithState(_record, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def view_counts_stream(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Views and visitors (approximate, as exact distinct counts have no bounded state) per window; later data than `late` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("pv"), F.approx_count_distinct("user_id").alias("uv"))


@query("""SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS hour, event_type AS path, count(*) AS pv, count(DISTINCT user_id) AS uv FROM events GROUP BY 1, 2""")
def hourly_views(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("pv"), F.count_distinct("user_id").alias("uv"))

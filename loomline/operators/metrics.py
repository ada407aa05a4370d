"""Operational metrics: day spines, histograms, source monitoring, page views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.feed import cluster_stats, entries, items_once, visible
from loomline.registry import ENTRIES, ITEMS, VISIBLE, query
from loomline.runtime import table


def day_spine(df: DataFrame, day: str, last: str, days: int) -> DataFrame:
    """`days` days up to `last`, each once, as `day`."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias(day))


@query(f"""WITH {ITEMS}, n AS (SELECT CAST(createdAt AS DATE) AS day, count(*) AS c FROM it GROUP BY 1)
    SELECT CAST(d AS DATE) AS day, coalesce(c, 0) AS articles FROM generate_series(DATE '2026-06-17', DATE '2026-06-30', INTERVAL 1 DAY) t(d) LEFT JOIN n ON n.day = CAST(d AS DATE)""")
def daily_articles(spark: SparkSession, d: str) -> DataFrame:
    n = items_once(spark, d).groupBy(F.to_date("createdAt").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return day_spine(n, "day", "2026-06-30", 14).join(n, "day", "left").select("day", F.coalesce("c", F.lit(0)).alias("articles"))


@query("""WITH n AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(props->>'$.k' AS BIGINT)) AS units, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT CAST(d AS DATE) AS day, coalesce(units, 0) AS units, coalesce(errors, 0) AS errors FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d) LEFT JOIN n ON n.day = CAST(d AS DATE)""")
def daily_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage counters from JSON payloads per day, zero-filled; a malformed payload counts nothing."""
    k = F.coalesce(F.from_json("props", "k long").getField("k"), F.lit(0))
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(k).alias("units"), F.count_if(F.col("event_type") == "error").alias("errors"))
    out = day_spine(n, "day", "2024-01-31", 31).join(n, "day", "left")
    return out.select("day", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query(f"""WITH {ENTRIES}, h AS (SELECT least(score // 10, 9) AS bucket, count(*) AS n FROM entries GROUP BY 1)
    SELECT CAST(b AS INT) AS bucket, coalesce(n, 0) AS entries FROM range(10) t(b) LEFT JOIN h ON h.bucket = b""")
def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = entries(visible(spark, d)).groupBy(F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(h, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("entries"))


NOW = "2026-07-01"
AGES = ((365, "year"), (180, "half_year"), (90, "quarter"), (30, "month"), (7, "week"), (1, "day"))


@query(f"""WITH {ITEMS} SELECT s.id, s.healthStatus, count(it.id) AS items, max(it.createdAt) AS last, coalesce(date_diff('day', max(it.createdAt), TIMESTAMP '{NOW}'), -1) AS days,
    CASE {' '.join(f"WHEN date_diff('day', max(it.createdAt), TIMESTAMP '{NOW}') >= {n} THEN '{k}'" for n, k in AGES)} END AS bucket
    FROM sources s LEFT JOIN it ON it.sid = s.id WHERE s.enabled GROUP BY s.id, s.healthStatus""")
def source_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Items and inactivity of every enabled source; those never updated come first when sorted by last."""
    n = items_once(spark, d).groupBy(F.col("sid").alias("id")).agg(F.count(F.lit(1)).alias("items"), F.max("createdAt").alias("last"))
    days = F.datediff(F.lit(NOW).cast("date"), F.to_date("last"))
    bucket = F.coalesce(*[F.when(days >= n, k) for n, k in AGES])
    out = table(spark, d, "sources").filter("enabled").select("id", "healthStatus").join(n, "id", "left")
    return out.select("id", "healthStatus", F.coalesce("items", F.lit(0)).alias("items"), "last", F.coalesce(days, F.lit(-1)).alias("days"), bucket.alias("bucket"))


@query("SELECT event_type AS path, count(*) AS pv, count(DISTINCT user_id) AS uv FROM events GROUP BY 1")
def page_views(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("pv"), F.count_distinct("user_id").alias("uv"))


@query(f"WITH {ITEMS} SELECT CAST(date_trunc('week', createdAt) AS DATE) AS week, count(*) AS items FROM it GROUP BY 1")
def archive_weeks(spark: SparkSession, d: str) -> DataFrame:
    return items_once(spark, d).groupBy(F.to_date(F.date_trunc("week", F.to_date("createdAt"))).alias("week")).agg(F.count(F.lit(1)).alias("items"))


@query(f"""WITH {ITEMS} SELECT 'failed_items' AS metric, count(*) AS n FROM it WHERE status = 'failed' UNION ALL SELECT 'waiting_items', count(*) FROM it WHERE status IN ('new', 'fetched')
    UNION ALL SELECT 'failed_sources', count(*) FROM sources WHERE enabled AND healthStatus = 'failed' UNION ALL SELECT 'uncertain_pairs', count(*) FROM cluster_decisions WHERE relation = 'uncertain'
    UNION ALL SELECT 'open_pairs', count(*) FROM cluster_decisions WHERE relation = 'same_event' AND appliedAt IS NULL UNION ALL SELECT 'unresolved_aliases', count(*) FROM aliases WHERE entityId IS NULL""")
def actionable_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Counts that ask for action: every table is scanned once, with conditional counts."""
    of = lambda df, **m: df.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in m.items()]).unpivot([], list(m), "metric", "n")
    out = of(items_once(spark, d), failed_items="status = 'failed'", waiting_items="status in ('new', 'fetched')")
    out = out.unionByName(of(table(spark, d, "sources"), failed_sources="enabled and healthStatus = 'failed'"))
    out = out.unionByName(of(table(spark, d, "cluster_decisions"), uncertain_pairs="relation = 'uncertain'", open_pairs="relation = 'same_event' and appliedAt is null"))
    return out.unionByName(of(table(spark, d, "aliases"), unresolved_aliases="entityId is null"))


@query(f"WITH {ITEMS} SELECT status, moderationStatus, isAggregation, count(*) AS n FROM it GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return items_once(spark, d).groupBy("status", "moderationStatus", "isAggregation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VISIBLE}, k AS (SELECT clusterId, eventType, eventSubject, eventObject FROM vis WHERE eventSubject IS NOT NULL AND eventObject IS NOT NULL AND clusterId IS NOT NULL)
    SELECT eventType, eventSubject, eventObject, count(DISTINCT clusterId) AS clusters, count(*) AS items FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT clusterId) > 1""")
def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    """Event signatures spread over several clusters."""
    v = visible(spark, d).filter("eventSubject is not null and eventObject is not null and clusterId is not null")
    return v.groupBy("eventType", "eventSubject", "eventObject").agg(F.count_distinct("clusterId").alias("clusters"), F.count(F.lit(1)).alias("items")).filter("clusters > 1")


@query(f"""WITH {VISIBLE}, t AS (SELECT CAST(createdAt AS DATE) AS day, eventSubject AS s FROM vis WHERE eventSubject IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT a.day, count(b.s) AS both FROM t a LEFT JOIN t b ON b.day = a.day - 1 AND b.s = a.s GROUP BY 1), n AS (SELECT day, count(*) AS n FROM t GROUP BY 1)
    SELECT n.day, round(p.both / (n.n + m.n - p.both), 6) AS overlap FROM n JOIN p USING (day) JOIN n m ON m.day = n.day - 1""")
def adjacent_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard overlap of each day's subjects with those of the day before: sets are compared by a join, not held in one row."""
    t = visible(spark, d).filter("eventSubject is not null").select(F.to_date("createdAt").alias("day"), F.col("eventSubject").alias("s")).distinct()
    n = t.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    both = t.join(t.select(F.date_add("day", 1).alias("day"), "s"), ["day", "s"]).groupBy("day").agg(F.count(F.lit(1)).alias("both"))
    out = n.join(n.select(F.date_add("day", 1).alias("day"), F.col("n").alias("m")), "day").join(both, "day", "left").fillna(0, ["both"])
    return out.select("day", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("overlap"))


@query(f"""WITH {ENTRIES} SELECT entryGroup, round(avg(score), 6) AS meanScore, round(avg(sourceCount), 6) AS meanSources, count(*) AS n, max(itemCount) AS largest FROM entries GROUP BY 1""")
def source_diversity(spark: SparkSession, d: str) -> DataFrame:
    e = entries(visible(spark, d)).groupBy("entryGroup")
    return e.agg(F.round(F.avg("score"), 6).alias("meanScore"), F.round(F.avg("sourceCount"), 6).alias("meanSources"), F.count(F.lit(1)).alias("n"), F.max("itemCount").alias("largest"))


@query(f"""WITH {VISIBLE}, r AS (SELECT CAST(createdAt AS DATE) AS day, id, row_number() OVER (PARTITION BY CAST(createdAt AS DATE) ORDER BY qualityScore DESC NULLS LAST, id) AS k, clusterId FROM vis)
    SELECT day, count(*) AS top, count(*) FILTER (WHERE clusterId IS NULL) AS missed, round(count(*) FILTER (WHERE clusterId IS NULL) / count(*), 6) AS rate FROM r WHERE k <= 20 GROUP BY 1""")
def miss_rate(spark: SparkSession, d: str) -> DataFrame:
    """Of each day's twenty best items, how many no cluster took up."""
    v = visible(spark, d).withColumn("day", F.to_date("createdAt"))
    top = v.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.desc_nulls_last("qualityScore"), "id"))).filter("k <= 20")
    out = top.groupBy("day").agg(F.count(F.lit(1)).alias("top"), F.count_if(F.col("clusterId").isNull()).alias("missed"))
    return out.withColumn("rate", F.round(F.col("missed") / F.col("top"), 6))


@query(f"""WITH {ITEMS}, runs AS (SELECT g AS run, TIMESTAMP '2026-06-21' + INTERVAL (g * 6) HOUR AS a, TIMESTAMP '2026-06-21' + INTERVAL (g * 6 + 3) HOUR AS b FROM range(40) t(g))
    SELECT run, count(it.id) AS items FROM runs LEFT JOIN it ON it.createdAt >= a AND it.createdAt < b GROUP BY run""")
def run_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items created within each run's window: a range join on hour buckets, so that it is an equi-join."""
    start = F.lit("2026-06-21").cast("timestamp_ntz")
    runs = spark.range(40).select(F.col("id").alias("run"), (start + F.make_dt_interval(hours=(F.col("id") * 6).cast("int"))).alias("a"))
    runs = runs.withColumn("b", F.col("a") + F.make_dt_interval(hours=F.lit(3)))
    hours = runs.withColumn("h", F.explode(F.sequence(F.date_trunc("hour", "a").cast("timestamp_ntz"), F.col("b"), F.expr("interval 1 hour"))))
    it = items_once(spark, d).select("createdAt", F.date_trunc("hour", "createdAt").cast("timestamp_ntz").alias("h"))
    n = it.join(hours, "h").filter("createdAt >= a and createdAt < b").groupBy("run").agg(F.count(F.lit(1)).alias("items"))
    return runs.select("run").join(n, "run", "left").fillna(0, ["items"])


@query(f"WITH {VISIBLE}, s AS (SELECT clusterId, count(*) AS n FROM vis WHERE clusterId IS NOT NULL GROUP BY 1) SELECT n AS size, count(*) AS clusters FROM s GROUP BY 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return cluster_stats(visible(spark, d)).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("clusters"))

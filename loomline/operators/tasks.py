"""Work in progress: cutoffs, retries, queues, stale runs, health over time, receipts, answers of models."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.feed import items_once
from loomline.registry import ITEMS, query
from loomline.runtime import table

MOST_TRIES = 5


@query(f"WITH {ITEMS} SELECT id, publishedAtKnown AS known FROM it WHERE NOT publishedAtKnown OR publishedAt >= TIMESTAMP '2026-06-23' ORDER BY publishedAtKnown DESC, publishedAt DESC, id LIMIT 500")
def processing_window(spark: SparkSession, d: str) -> DataFrame:
    """Entries within the processing window: old ones of known date are dropped, those of unknown date come last."""
    it = items_once(spark, d, "not publishedAtKnown or publishedAt >= timestamp_ntz'2026-06-23'")
    return it.orderBy(F.desc("publishedAtKnown"), F.desc("publishedAt"), "id").limit(500).select("id", F.col("publishedAtKnown").alias("known"))


def next_try(attempts: Column, now: Column) -> tuple[Column, Column, Column]:
    """(attempts, next try, exhausted) after one more failure: 15 minutes, doubled each time, six hours at most; none after the last."""
    n = F.coalesce(attempts, F.lit(0)) + 1
    minutes = F.least(F.lit(360.0), 15 * F.power(F.lit(2.0), n - 1)).cast("int")
    return n, F.when(n < MOST_TRIES, now + F.make_dt_interval(mins=minutes)), n >= MOST_TRIES


@query(f"""WITH o AS (SELECT id, max(attemptCount) AS a, max(createdAt) AS ended FROM cluster_decisions WHERE relation = 'failed' GROUP BY 1) SELECT id, a + 1 AS attempts, CASE WHEN a + 1 < {MOST_TRIES} THEN ended + CAST(least(360, 15 * power(2, a)) AS INT) * INTERVAL 1 MINUTE END AS nextTry, a + 1 >= {MOST_TRIES} AS exhausted FROM o""")
def retry_states(spark: SparkSession, d: str) -> DataFrame:
    """Failed judgements after one more failure."""
    o = table(spark, d, "cluster_decisions").filter("relation = 'failed'").groupBy("id").agg(F.max("attemptCount").alias("a"), F.max("createdAt").alias("at"))
    n, at, out = next_try(F.col("a"), F.col("at"))
    return o.select("id", n.alias("attempts"), at.alias("nextTry"), out.alias("exhausted"))


@query(f"""WITH {ITEMS}, n AS (SELECT parentItemId AS p, count(*) AS kids FROM it WHERE status = 'processed' AND moderationStatus IN ('allowed', 'restored') AND parentItemId IS NOT NULL GROUP BY 1) SELECT id, coalesce(kids, 0) = 0 AS degraded FROM it LEFT JOIN n ON p = id WHERE isAggregation AND status = 'failed'""")
def degraded_roundups(spark: SparkSession, d: str) -> DataFrame:
    """Roundups that failed for good: one without shown children becomes an ordinary item."""
    kids = items_once(spark, d, "status = 'processed' and moderationStatus in ('allowed', 'restored') and parentItemId is not null").select(F.col("parentItemId").alias("id")).distinct().withColumn("k", F.lit(True))
    return items_once(spark, d, "isAggregation and status = 'failed'").join(kids, "id", "left").select("id", F.col("k").isNull().alias("degraded"))


# Health of the test tables' sources over time: users are sources, errors and purchases turn a source's state.
CHANGES = """ch AS (SELECT user_id AS source, ts, event_id, event_type AS status FROM events WHERE event_type IN ('error', 'purchase', 'signup')), lg AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY source ORDER BY ts, event_id), 'unknown') AS before FROM ch)"""


def health_by_day(current: DataFrame, changes: DataFrame, last: str, days: int) -> DataFrame:
    """(day, source, status) at the end of each day: the state before the first change after the day, else the current one.

    current holds (source, status), changes (source, ts, seq, before). Each source's days are looked up among its own
    changes by a window, so nothing walks back day by day.
    """
    spine = current.select("source", "status", F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    firsts = changes.groupBy("source", F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "seq", "before")).alias("m")).select("source", "day", F.col("m.before").alias("before"))
    marks = spine.join(firsts, ["source", "day"], "left")
    later = F.first("before", ignorenulls=True).over(Window.partitionBy("source").orderBy("day").rowsBetween(1, Window.unboundedFollowing))
    return marks.select("day", "source", F.coalesce(later, "status").alias("status"))


@query(f"""WITH {CHANGES}, cur AS (SELECT source, arg_max(status, (ts, event_id)) AS status FROM ch GROUP BY 1), sp AS (SELECT CAST(d AS DATE) AS day, cur.* FROM generate_series(DATE '2024-01-16', DATE '2024-01-31', INTERVAL 1 DAY) t(d), cur),
    st AS (SELECT day, source, coalesce((SELECT arg_min(before, (ts, event_id)) FROM lg WHERE lg.source = sp.source AND CAST(ts AS DATE) > day), status) AS status FROM sp) SELECT day, count(*) FILTER (WHERE status = 'purchase') AS healthy, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status NOT IN ('purchase', 'error')) AS unknown FROM st GROUP BY 1""")
def source_health_days(spark: SparkSession, d: str) -> DataFrame:
    """How many sources were well, failed or unknown at the end of each day, rebuilt from today's state and the log of changes."""
    ch = table(spark, d, "events").filter("event_type in ('error', 'purchase', 'signup')").select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    lg = ch.withColumn("before", F.coalesce(F.lag("status").over(Window.partitionBy("source").orderBy("ts", "seq")), F.lit("unknown")))
    cur = ch.groupBy("source").agg(F.max(F.struct("ts", "seq", "status")).alias("m")).select("source", F.col("m.status").alias("status"))
    st = health_by_day(cur, lg, "2024-01-31", 16)
    return st.groupBy("day").agg(F.count_if(F.col("status") == "purchase").alias("healthy"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(~F.col("status").isin("purchase", "error")).alias("unknown"))


# The log of judgements stands for the task table: kind is a task's kind, a failed one runs, one not applied is queued.
@query("""WITH t AS (SELECT id, any_value(kind) AS kind, min(createdAt) AS began, bool_or(relation = 'failed') AS running, bool_and(appliedAt IS NULL) AS queued FROM cluster_decisions GROUP BY id), busy AS (SELECT DISTINCT kind FROM t WHERE running AND began >= TIMESTAMP '2026-06-30')
    SELECT kind, arg_min(id, (began, id)) AS id FROM t WHERE queued AND NOT running AND kind NOT IN (SELECT kind FROM busy) GROUP BY kind""")
def next_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The oldest waiting task of each kind of which none runs."""
    t = table(spark, d, "cluster_decisions").groupBy("id").agg(F.any_value("kind").alias("kind"), F.min("createdAt").alias("at"), F.bool_or(F.col("relation") == "failed").alias("running"), F.bool_and(F.col("appliedAt").isNull()).alias("queued"))
    busy = t.filter("running and at >= timestamp_ntz'2026-06-30'").select("kind").distinct()
    return t.filter("queued and not running").join(busy, "kind", "left_anti").groupBy("kind").agg(F.min(F.struct("at", "id")).alias("m")).select("kind", F.col("m.id").alias("id"))


@query("SELECT DISTINCT id, createdAt + INTERVAL 15 MINUTE AS since FROM cluster_decisions WHERE relation = 'failed' AND appliedAt IS NULL AND createdAt < TIMESTAMP '2026-06-29' - INTERVAL 15 MINUTE")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs begun over a quarter of an hour ago and never ended."""
    t = table(spark, d, "cluster_decisions").filter("relation = 'failed' and appliedAt is null and createdAt < timestamp_ntz'2026-06-29' - interval 15 minutes")
    return t.select("id", (F.col("createdAt") + F.expr("interval 15 minutes")).alias("since")).distinct()


@query("SELECT id, kind, relation, createdAt, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT id, any_value(kind) AS kind, any_value(relation) AS relation, min(createdAt) AS createdAt FROM cluster_decisions WHERE kind = 'cluster_pair' AND relation <> 'failed' AND createdAt >= TIMESTAMP '2026-06-20' GROUP BY id)) ORDER BY createdAt DESC, id LIMIT 20 OFFSET 20")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    """A page of judgements of one kind within a time, beside their number."""
    t = table(spark, d, "cluster_decisions").filter("kind = 'cluster_pair' and relation <> 'failed' and createdAt >= timestamp_ntz'2026-06-20'")
    t = t.groupBy("id").agg(F.any_value("kind").alias("kind"), F.any_value("relation").alias("relation"), F.min("createdAt").alias("createdAt"))
    return t.orderBy(F.desc("createdAt"), "id").offset(20).limit(20).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("SELECT kind, relation, count(DISTINCT id) AS n, max(createdAt) AS latest, bool_or(relation = 'failed') AS attention FROM cluster_decisions GROUP BY 1, 2 ORDER BY attention DESC, latest DESC LIMIT 50")
def task_monitor(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cluster_decisions").groupBy("kind", "relation").agg(F.count_distinct("id").alias("n"), F.max("createdAt").alias("latest"), F.bool_or(F.col("relation") == "failed").alias("attention"))
    return t.orderBy(F.desc("attention"), F.desc("latest")).limit(50)


@query("SELECT id, k, (k - 1) // 3 AS batch FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM (SELECT DISTINCT id, score FROM pair_cache WHERE score >= 55) ORDER BY score DESC, id LIMIT 60)")
def judgement_batches(spark: SparkSession, d: str) -> DataFrame:
    """The sixty best pairs in batches of three, as a model judges them."""
    p = table(spark, d, "pair_cache").filter("score >= 55").select("id", "score").distinct().orderBy(F.desc("score"), "id").limit(60)
    return p.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "k", F.floor((F.col("k") - 1) / 3).alias("batch"))


@query("SELECT id, relation, row_number() OVER (PARTITION BY pairKey ORDER BY createdAt, id) AS attempt FROM (SELECT DISTINCT id, relation, lower(regexp_replace(pairKey, '\\s+', '', 'g')) AS pairKey, createdAt FROM cluster_decisions)")
def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """Judgements with their number among those of the same pair, as an append counts it from history."""
    t = table(spark, d, "cluster_decisions").select("id", "relation", F.lower(F.regexp_replace("pairKey", r"\s+", "")).alias("pairKey"), "createdAt").distinct()
    return t.withColumn("attempt", F.row_number().over(Window.partitionBy("pairKey").orderBy("createdAt", "id"))).select("id", "relation", "attempt")


ANSWER = "struct<decisions:array<struct<pair_id:string,relation:string,confidence:int>>>"
RELATIONS = ("same_event", "follow_up", "synthesis", "unrelated", "uncertain")


def salvaged(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(pair_id, relation, confidence, dropped) of model answers (text): valid rows have a null `dropped`, the others say why they
    fall: not readable, unknown pair, unknown relation, or a repeat of a pair, of which the first row counts."""
    rows = answers.select("text", F.posexplode_outer(F.from_json("text", ANSWER).getField("decisions")).alias("k", "x"))
    rows = rows.join(expected.select(F.col("pair_id").alias("known")).distinct(), F.col("x.pair_id") == F.col("known"), "left")
    n = F.row_number().over(Window.partitionBy("known").orderBy(F.when(F.col("x.relation").isin(*RELATIONS), 0).otherwise(1), "text", "k"))
    rows = rows.withColumn("n", F.when(F.col("known").isNotNull(), n))
    why = F.when(F.col("x").isNull(), "unreadable").when(F.col("known").isNull(), "unknown pair").when(~F.coalesce(F.col("x.relation").isin(*RELATIONS), F.lit(False)), "unknown relation").when(F.col("n") > 1, "repeated pair")
    return rows.select(F.col("x.pair_id").alias("pair_id"), F.col("x.relation").alias("relation"), F.when(F.col("x.confidence").isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), F.col("x.confidence")))).alias("confidence"), why.alias("dropped"))


@query(f"WITH {ITEMS} SELECT max(updatedAt) AS newest, count(*) AS items, sha256(CAST(count(*) AS VARCHAR) || '|' || CAST(sum(length(id)) AS VARCHAR)) AS version FROM it")
def feed_version(spark: SparkSession, d: str) -> DataFrame:
    """What a cached page is keyed by: it changes when an item comes, goes or is updated."""
    it = items_once(spark, d).agg(F.max("updatedAt").alias("newest"), F.count(F.lit(1)).alias("items"), F.sum(F.length("id")).alias("n"))
    return it.select("newest", "items", F.sha2(F.concat_ws("|", F.col("items").cast("string"), F.col("n").cast("string")), 256).alias("version"))


def next_run(hour: int, minute: int, now: datetime, zone: int = 480) -> datetime:
    """The next time of day in a zone so many minutes east, in UTC."""
    local = now + timedelta(minutes=zone)
    at = local.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return (at if at > local else at + timedelta(days=1)) - timedelta(minutes=zone)

"""Lists and judgements that editors and later stages work from: reviews, candidates, pair admission, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.feed import contains, half_up, items_once, visible
from loomline.registry import ITEMS, VISIBLE, query
from loomline.runtime import table


@query(f"WITH {ITEMS} SELECT id, status, createdAt FROM it WHERE status IN ('failed', 'fetched') ORDER BY status = 'failed' DESC, createdAt, id LIMIT 90")
def recovery_candidates(spark: SparkSession, d: str) -> DataFrame:
    it = items_once(spark, d, "status in ('failed', 'fetched')")
    return it.orderBy(F.desc(F.col("status") == "failed"), "createdAt", "id").limit(90).select("id", "status", "createdAt")


@query(f"WITH {ITEMS} SELECT it.id FROM it JOIN sources s ON s.id = sid WHERE s.aggregationEnabled AND it.status IN ('failed', 'fetched', 'filtered') ORDER BY it.createdAt DESC, it.id DESC LIMIT 200")
def reparse_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter("aggregationEnabled").select(F.col("id").alias("sid"))
    it = items_once(spark, d, "status in ('failed', 'fetched', 'filtered')").join(s, "sid", "left_semi")
    return it.orderBy(F.desc("createdAt"), F.desc("id")).limit(200).select("id")


FILTERED_COLUMNS = ("originalTitle", "translatedTitle", "summaryText", "rssExcerpt")


@query(f"WITH {ITEMS} SELECT id, sid FROM it WHERE moderationStatus = 'filtered' AND ({' OR '.join(f"contains(lower(coalesce({c}, '')), 'chip')" for c in FILTERED_COLUMNS)}) AND createdAt >= TIMESTAMP '2026-06-22'")
def filtered_review_all(spark: SparkSession, d: str) -> DataFrame:
    """Filtered items found in any of the reference's columns that the table has; moderationDetail it has not."""
    return items_once(spark, d, "moderationStatus = 'filtered' and createdAt >= timestamp_ntz'2026-06-22'").filter(contains("chip", FILTERED_COLUMNS)).select("id", "sid")


@query(f"""WITH {ITEMS}, n AS (SELECT parentItemId AS p, count(*) AS children, count(*) FILTER (WHERE status = 'processed') AS done FROM it WHERE parentItemId IS NOT NULL GROUP BY 1)
    SELECT id, coalesce(children, 0) AS children, coalesce(done, 0) AS done FROM it LEFT JOIN n ON p = id WHERE isAggregation""")
def split_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every roundup with its children."""
    it = items_once(spark, d)
    n = it.filter("parentItemId is not null").groupBy(F.col("parentItemId").alias("id")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("status") == "processed").alias("done"))
    return it.filter("isAggregation").select("id").join(n, "id", "left").fillna(0, ["children", "done"])


@query(f"""WITH {VISIBLE} SELECT id FROM vis WHERE parentItemId IS NULL OR NOT EXISTS (SELECT 1 FROM vis p WHERE p.id = vis.parentItemId)""")
def without_shown_parents(spark: SparkSession, d: str) -> DataFrame:
    v = visible(spark, d)
    shown = v.select(F.col("id").alias("parentItemId"))
    return v.join(shown, "parentItemId", "left_anti").select("id")


@query(f"WITH {ITEMS}, n AS (SELECT sid, count(*) AS items FROM it GROUP BY 1) SELECT s.id, s.name, s.enabled, coalesce(items, 0) AS items FROM sources s LEFT JOIN n ON sid = s.id WHERE contains(lower(s.name), 'journal') ORDER BY s.name, s.id LIMIT 50")
def source_list(spark: SparkSession, d: str) -> DataFrame:
    n = items_once(spark, d).groupBy(F.col("sid").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    s = table(spark, d, "sources").filter(F.lower("name").contains("journal")).select("id", "name", "enabled").join(n, "id", "left")
    return s.fillna(0, ["items"]).orderBy("name", "id").limit(50)


@query("SELECT id, lower(concat_ws(' ', title, summary, array_to_string(CAST(json(feedEntitiesJson) AS VARCHAR[]), ' '))) AS searchText FROM content_clusters")
def cluster_search_text(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.from_json("feedEntitiesJson", "array<string>"), " ")
    return table(spark, d, "content_clusters").select("id", F.lower(F.concat_ws(" ", "title", "summary", names)).alias("searchText"))


SUFFIX = "(?i)[ ,]+(?:inc|corp|ltd|llc|plc|gmbh|ag|co|s\\.?a)\\.?$"


@query(f"WITH {ITEMS} SELECT id, regexp_replace(trim(regexp_replace(eventSubject, '\\s+', ' ', 'g')), '{SUFFIX}', '') AS subject FROM it WHERE eventSubject IS NOT NULL")
def plain_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects without the company form at their end."""
    s = F.regexp_replace(F.trim(F.regexp_replace("eventSubject", r"\s+", " ")), SUFFIX, "")
    return items_once(spark, d, "eventSubject is not null").select("id", s.alias("subject"))


@query(f"""WITH {ITEMS} SELECT it.id, it.eventDate IS NULL OR c.eventDate IS NULL OR starts_with(it.eventDate, c.eventDate) OR starts_with(c.eventDate, it.eventDate)
      OR (length(it.eventDate) = 10 AND length(c.eventDate) = 10 AND abs(date_diff('day', TRY_CAST(it.eventDate AS DATE), TRY_CAST(c.eventDate AS DATE))) <= 2) AS compatible,
    CASE WHEN it.eventObject = c.eventObject THEN 'exact' WHEN contains(it.eventObject, c.eventObject) OR contains(c.eventObject, it.eventObject) THEN 'includes' ELSE 'other' END AS objects FROM it JOIN content_clusters c ON c.id = it.clusterId WHERE it.eventObject IS NOT NULL""")
def member_fit(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item's event date and object fit its cluster's: dates of different precision fit if one holds the other."""
    c = table(spark, d, "content_clusters").select(F.col("id").alias("clusterId"), F.col("eventDate").alias("cd"), F.col("eventObject").alias("co"))
    x = items_once(spark, d, "eventObject is not null").join(c, "clusterId")
    day = lambda v: F.expr(f"try_to_date({v}, 'yyyy-MM-dd')")
    near = (F.length("eventDate") == 10) & (F.length("cd") == 10) & (F.abs(F.datediff(day("eventDate"), day("cd"))) <= 2)
    fit = F.col("eventDate").isNull() | F.col("cd").isNull() | F.col("eventDate").startswith(F.col("cd")) | F.col("cd").startswith(F.col("eventDate")) | near
    objects = F.when(F.col("eventObject") == F.col("co"), "exact").when(F.col("eventObject").contains(F.col("co")) | F.col("co").contains(F.col("eventObject")), "includes").otherwise("other")
    return x.select("id", fit.alias("compatible"), objects.alias("objects"))


EDGE_SQL = """e AS (SELECT least(leftClusterId, rightClusterId) AS a, greatest(leftClusterId, rightClusterId) AS b, max(score) AS score, max(bm25Score) AS bm25, max(vectorSimilarity) AS sim,
    array_to_string(list_sort(list_distinct(list(recallSource))), '+') AS via FROM pair_cache WHERE leftClusterId <> rightClusterId GROUP BY 1, 2)"""


@query(f"""WITH {EDGE_SQL} SELECT a, b, score, bm25, via, CASE WHEN bm25 > 300000 THEN 'rule' WHEN sim >= 0.72 THEN 'vector' ELSE 'none' END AS admitted,
    CASE WHEN bm25 > 300000 THEN score WHEN sim >= 0.72 THEN CAST(floor(sim * 100 + 0.5) AS INT) ELSE 0 END AS priority FROM e""")
def pair_admission(spark: SparkSession, d: str) -> DataFrame:
    """Cached pairs merged over their order and channels, and by which rule they are admitted."""
    e = table(spark, d, "pair_cache").filter("leftClusterId <> rightClusterId").groupBy(F.least("leftClusterId", "rightClusterId").alias("a"), F.greatest("leftClusterId", "rightClusterId").alias("b"))
    e = e.agg(F.max("score").alias("score"), F.max("bm25Score").alias("bm25"), F.max("vectorSimilarity").alias("sim"), F.array_join(F.array_sort(F.collect_set("recallSource")), "+").alias("via"))
    rule, near = F.col("bm25") > 300000, F.coalesce(F.col("sim") >= 0.72, F.lit(False))
    priority = F.when(rule, F.col("score")).when(near, half_up(F.col("sim") * 100)).otherwise(0).cast("int")
    return e.select("a", "b", "score", "bm25", "via", F.when(rule, "rule").when(near, "vector").otherwise("none").alias("admitted"), priority.alias("priority"))


@query(f"""WITH {EDGE_SQL}, s AS (SELECT a AS c, b AS o, score FROM e UNION ALL SELECT b, a, score FROM e) SELECT c, o, score, k FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, o) AS k FROM s) WHERE k <= 3""")
def related_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's three best partners."""
    e = pair_admission(spark, d)
    s = e.select(F.col("a").alias("c"), F.col("b").alias("o"), "score").unionByName(e.select(F.col("b").alias("c"), F.col("a").alias("o"), "score"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "o"))).filter("k <= 3")


@query(f"""WITH {EDGE_SQL}, g AS (SELECT a, b FROM e WHERE score >= 80), n AS (SELECT a AS c, b AS o FROM g UNION SELECT b, a FROM g), t AS (SELECT c, count(*) AS deg FROM n GROUP BY 1), best AS (SELECT n.c AS source, n.o AS target, row_number() OVER (PARTITION BY n.c ORDER BY y.deg DESC, n.o) AS k
      FROM n JOIN t x ON x.c = n.c JOIN t y ON y.c = n.o WHERE y.deg > x.deg OR (y.deg = x.deg AND n.o < n.c)) SELECT source, target FROM best WHERE k = 1""")
def merge_targets(spark: SparkSession, d: str) -> DataFrame:
    """Stars, not closures: a cluster merges into the one direct neighbour that has the most neighbours, if that has more than itself."""
    e = pair_admission(spark, d).filter("score >= 80")
    n = e.select(F.col("a").alias("c"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("c"), F.col("a").alias("o")))
    t = n.groupBy("c").agg(F.count(F.lit(1)).alias("deg"))
    x = n.join(t, "c").join(t.select(F.col("c").alias("o"), F.col("deg").alias("odeg")), "o").filter("odeg > deg or (odeg = deg and o < c)")
    best = x.groupBy("c").agg(F.min(F.struct((-F.col("odeg")).alias("n"), "o")).alias("m"))
    return best.select(F.col("c").alias("source"), F.col("m.o").alias("target"))


@query("""WITH p AS (SELECT DISTINCT id, relation, createdAt, string_split(regexp_replace(lower(pairKey), '\\s+', '', 'g'), '|') AS p FROM cluster_decisions WHERE kind = 'cluster_pair'),
    h AS (SELECT least(p[1], p[2]) AS a, greatest(p[1], p[2]) AS b, count(*) FILTER (WHERE relation = 'unrelated') AS declines, arg_max(relation, (createdAt, id)) AS latest, max(createdAt) AS judged FROM p GROUP BY 1, 2)
    SELECT a, b, CASE WHEN declines >= 3 THEN 'declined' WHEN latest = 'uncertain' THEN 'pending' ELSE 'cooling' END AS why FROM h
    WHERE declines >= 3 OR latest = 'uncertain' OR judged + (INTERVAL 1 HOUR) * CASE latest WHEN 'failed' THEN 6 WHEN 'unrelated' THEN 48 ELSE 24 END > TIMESTAMP '2026-06-30'""")
def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs not to be judged again yet: often declined, uncertain, or within the cooldown of their latest judgement."""
    p = F.split(F.regexp_replace(F.lower("pairKey"), r"\s+", ""), r"\|")
    h = table(spark, d, "cluster_decisions").filter("kind = 'cluster_pair'").select("id", "relation", "createdAt", p.alias("p")).distinct()
    h = h.groupBy(F.array_min("p").alias("a"), F.array_max("p").alias("b")).agg(F.count_if(F.col("relation") == "unrelated").alias("declines"), F.max(F.struct("createdAt", "id", "relation")).alias("m"))
    latest = F.col("m.relation")
    hours = F.when(latest == "failed", 6).when(latest == "unrelated", 48).otherwise(24)
    cooling = F.col("m.createdAt") + F.make_dt_interval(hours=hours) > F.lit("2026-06-30").cast("timestamp_ntz")
    h = h.filter((F.col("declines") >= 3) | (latest == "uncertain") | cooling)
    return h.select("a", "b", F.when(F.col("declines") >= 3, "declined").when(latest == "uncertain", "pending").otherwise("cooling").alias("why"))


@query(f"""WITH {EDGE_SQL}, s AS (SELECT *, least(floor(sim * 20), 19) AS stratum FROM e WHERE sim IS NOT NULL) SELECT a, b, stratum, k FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY a, b) AS k FROM s) WHERE k <= 5""")
def stratified_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A sample of five pairs from every stratum of similarity."""
    e = table(spark, d, "pair_cache").filter("leftClusterId <> rightClusterId").groupBy(F.least("leftClusterId", "rightClusterId").alias("a"), F.greatest("leftClusterId", "rightClusterId").alias("b")).agg(F.max("vectorSimilarity").alias("sim"))
    e = e.filter("sim is not null").withColumn("stratum", F.least(F.floor(F.col("sim") * 20), F.lit(19)))
    return e.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("a", "b"))).filter("k <= 5").select("a", "b", "stratum", "k")


@query("""WITH d AS (SELECT DISTINCT leftClusterId AS l, rightClusterId AS r FROM cluster_decisions WHERE relation = 'unrelated' AND leftClusterId IS NOT NULL AND rightClusterId IS NOT NULL)
    SELECT DISTINCT c.leftClusterId AS a, c.rightClusterId AS b, vectorSimilarity AS sim FROM pair_cache c JOIN d ON (l = c.leftClusterId AND r = c.rightClusterId) OR (r = c.leftClusterId AND l = c.rightClusterId) WHERE vectorSimilarity >= 0.8""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Pairs judged unrelated that vectors hold alike: the pair's order is settled before the join, not tried in it."""
    key = lambda a, b: F.array_sort(F.array(a, b))
    no = table(spark, d, "cluster_decisions").filter("relation = 'unrelated' and leftClusterId is not null and rightClusterId is not null").select(key("leftClusterId", "rightClusterId").alias("k"))
    c = table(spark, d, "pair_cache").filter("vectorSimilarity >= 0.8").withColumn("k", key("leftClusterId", "rightClusterId")).join(no, "k", "left_semi")
    return c.select(F.col("leftClusterId").alias("a"), F.col("rightClusterId").alias("b"), F.col("vectorSimilarity").alias("sim")).distinct()


@query(f"""WITH {ITEMS}, r AS (SELECT id, CAST(createdAt AS DATE) AS day, row_number() OVER (PARTITION BY CAST(createdAt AS DATE) ORDER BY createdAt, id) AS k FROM it) SELECT day, count(*) AS asked, count(*) FILTER (WHERE k <= 250) AS admitted FROM r GROUP BY 1""")
def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    """Requests a day that a budget of 250 admits: a count is enough to say how many, no day's rows need to be ordered."""
    n = items_once(spark, d).groupBy(F.to_date("createdAt").alias("day")).agg(F.count(F.lit(1)).alias("asked"))
    return n.withColumn("admitted", F.least("asked", F.lit(250)))


@query("SELECT DISTINCT id, CASE WHEN expiresAt < TIMESTAMP '2026-06-29' THEN NULL ELSE leftInputHash END AS leftInputHash, expiresAt < TIMESTAMP '2026-06-29' AS expired FROM pair_cache")
def expired_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows stay when they expire, their payload goes."""
    gone = F.col("expiresAt") < F.lit("2026-06-29").cast("timestamp_ntz")
    return table(spark, d, "pair_cache").select("id", F.when(~gone, F.col("leftInputHash")).alias("leftInputHash"), gone.alias("expired")).distinct()


@query(f"""WITH {VISIBLE}, e AS (SELECT clusterId, id, CASE WHEN publishedAtKnown THEN publishedAt ELSE createdAt END AS eff FROM vis WHERE clusterId IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY clusterId ORDER BY eff DESC, id) AS k FROM e WHERE eff >= TIMESTAMP '2026-06-28 16:00:00' AND eff < TIMESTAMP '2026-06-29 16:00:00')
    SELECT clusterId, string_agg(id, ',' ORDER BY k) AS evidence FROM r WHERE k <= 3 GROUP BY 1""")
def day_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The three latest items of the day behind each cluster."""
    e = visible(spark, d).filter("clusterId is not null").withColumn("eff", F.when(F.col("publishedAtKnown"), F.col("publishedAt")).otherwise(F.col("createdAt")))
    e = e.filter("eff >= timestamp_ntz'2026-06-28 16:00:00' and eff < timestamp_ntz'2026-06-29 16:00:00'")
    r = e.withColumn("k", F.row_number().over(Window.partitionBy("clusterId").orderBy(F.desc("eff"), "id"))).filter("k <= 3")
    return r.groupBy("clusterId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), ",").alias("evidence"))


@query(f"""WITH {VISIBLE}, b AS (SELECT groupId, coalesce(clusterId, id) AS entry, max(coalesce(qualityScore, 0)) AS q FROM vis WHERE groupId IS NOT NULL GROUP BY 1, 2) SELECT entry, arg_max(groupId, (q, groupId)) AS channel, max(q) AS score FROM b GROUP BY 1""")
def best_channel(spark: SparkSession, d: str) -> DataFrame:
    """The channel in which an entry scores best."""
    b = visible(spark, d).filter("groupId is not null").groupBy("groupId", F.coalesce("clusterId", "id").alias("entry")).agg(F.max(F.coalesce("qualityScore", F.lit(0))).alias("q"))
    return b.groupBy("entry").agg(F.max(F.struct("q", "groupId")).alias("m")).select("entry", F.col("m.groupId").alias("channel"), F.col("m.q").alias("score"))

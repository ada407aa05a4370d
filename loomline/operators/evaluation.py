"""Evaluation of scores against labels, and the quality of daily reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.briefing import START, day_start
from loomline.operators.feed import visible
from loomline.registry import VISIBLE, query
from loomline.runtime import table

LABELLED = """l AS (SELECT id, score AS label, bm25Score AS s FROM (SELECT DISTINCT id, bm25Score, CASE WHEN score >= 80 THEN 1 ELSE 0 END AS score FROM pair_cache))"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pair_cache").select("id", F.when(F.col("score") >= 80, 1).otherwise(0).alias("label"), F.col("bm25Score").alias("s")).distinct()


def auc(df: DataFrame, label: str = "label", score: str = "s") -> DataFrame:
    """(goods, bads, auc): how often a good row outscores a bad one, ties counting half. Counts per score are few however many rows
    there are, and the running sum is over them; null without a row of each kind."""
    per = df.groupBy(score).agg(F.sum(F.col(label)).alias("g"), F.sum(1 - F.col(label)).alias("b"))
    per = per.withColumn("below", F.coalesce(F.sum("b").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = per.agg(F.sum("g").alias("goods"), F.sum("b").alias("bads"), F.sum(F.col("g") * (F.col("below") + F.col("b") / 2)).alias("won"))
    return one.select("goods", "bads", F.round(F.try_divide("won", F.col("goods") * F.col("bads")), 6).alias("auc"))


@query(f"""WITH {LABELLED} SELECT (SELECT sum(label) FROM l) AS goods, (SELECT sum(1 - label) FROM l) AS bads,
    round((SELECT sum(CASE WHEN g.s > b.s THEN 1.0 WHEN g.s = b.s THEN 0.5 ELSE 0 END) FROM l g, l b WHERE g.label = 1 AND b.label = 0) / ((SELECT sum(label) FROM l) * (SELECT sum(1 - label) FROM l)), 6) AS auc""")
def score_auc(spark: SparkSession, d: str) -> DataFrame:
    return auc(labelled(spark, d))


@query(f"""WITH {LABELLED} SELECT cut, count(*) FILTER (WHERE label = 1 AND s >= cut) AS tp, count(*) FILTER (WHERE label = 0 AND s >= cut) AS fp, count(*) FILTER (WHERE label = 1 AND s < cut) AS fn, count(*) FILTER (WHERE label = 0 AND s < cut) AS tn,
    round(count(*) FILTER (WHERE label = 1 AND s >= cut) / nullif(count(*) FILTER (WHERE s >= cut), 0)::DOUBLE, 6) AS "precision", round(count(*) FILTER (WHERE label = 1 AND s >= cut) / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE, 6) AS recall,
    CAST(median(s) AS DOUBLE) AS median FROM l, (VALUES (100000), (300000), (500000)) c(cut) GROUP BY cut""")
def score_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion, precision and recall at several cuts, all in one pass."""
    df = labelled(spark, d).withColumn("cut", F.explode(F.array(*map(F.lit, (100000, 300000, 500000)))))
    hit, good = F.col("s") >= F.col("cut"), F.col("label") == 1
    g = df.groupBy("cut").agg(F.count_if(hit & good).alias("tp"), F.count_if(hit & ~good).alias("fp"), F.count_if(~hit & good).alias("fn"), F.count_if(~hit & ~good).alias("tn"), F.median("s").alias("median"))
    return g.select("cut", "tp", "fp", "fn", "tn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"), "median")


@query("""WITH p AS (SELECT leftClusterId AS a, rightClusterId AS b, max(bm25Score) AS bm, max(score) >= 80 AS good FROM pair_cache WHERE leftClusterId <> rightClusterId GROUP BY 1, 2), u AS (SELECT a, b, bm, good FROM p UNION ALL SELECT b, a, bm, good FROM p),
    r AS (SELECT a, good, row_number() OVER (PARTITION BY a ORDER BY bm DESC, b) AS k FROM u) SELECT n, count(*) FILTER (WHERE good AND k <= n) AS found, count(*) FILTER (WHERE good) AS goods, round(count(*) FILTER (WHERE good AND k <= n) / count(*) FILTER (WHERE good)::DOUBLE, 6) AS recall
    FROM r, (VALUES (1), (3), (10)) v(n) GROUP BY n""")
def recall_at(spark: SparkSession, d: str) -> DataFrame:
    """Share of good partners among each cluster's n best by BM25."""
    p = table(spark, d, "pair_cache").filter("leftClusterId <> rightClusterId").groupBy(F.col("leftClusterId").alias("a"), F.col("rightClusterId").alias("b")).agg(F.max("bm25Score").alias("bm"), (F.max("score") >= 80).alias("good"))
    u = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "bm", "good"))
    r = u.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("bm"), "b"))).withColumn("n", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))))
    g = r.groupBy("n").agg(F.count_if(F.col("good") & (F.col("k") <= F.col("n"))).alias("found"), F.count_if("good").alias("goods"))
    return g.withColumn("recall", F.round(F.col("found") / F.col("goods"), 6))


@query(f"""WITH {LABELLED}, b AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS k, count(*) OVER () AS n FROM l WHERE label = 0), c AS (SELECT rate, min(s) AS cut FROM b, (VALUES (0.05), (0.1), (0.2)) r(rate) WHERE k <= greatest(1, floor(n * rate)) GROUP BY rate)
    SELECT CAST(rate AS DOUBLE) AS rate, cut, round((SELECT count(*) FROM l WHERE label = 1 AND s > cut) / (SELECT count(*) FROM l WHERE label = 1)::DOUBLE, 6) AS recall FROM c""")
def recall_at_false_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of good rows above the score that lets no more than a share of the bad ones pass: counts per score, summed from the top."""
    per = labelled(spark, d).groupBy("s").agg(F.sum("label").alias("g"), F.sum(1 - F.col("label")).alias("b"))
    w, whole = Window.orderBy(F.desc("s")), Window.partitionBy()
    per = per.withColumn("upto", F.sum("b").over(w)).withColumn("above", F.coalesce(F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("bads", F.sum("b").over(whole)).withColumn("goods", F.sum("g").over(whole))
    per = per.filter("b > 0").withColumn("rate", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2)))))
    first = per.filter(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("bads") * F.col("rate")))).groupBy("rate").agg(F.max(F.struct("s", "above", "goods")).alias("m"))
    return first.select("rate", F.col("m.s").alias("cut"), F.round(F.col("m.above") / F.col("m.goods"), 6).alias("recall"))


# A report of the test tables is a day's twelve best visible items; its sections are the items' groups, its candidates all of the day's items.
REPORTS = f"""{VISIBLE}, c AS (SELECT CAST(createdAt AS DATE) AS day, id, sid, coalesce(groupId, 'none') AS section, coalesce('cluster:' || clusterId, 'url:' || lower(trim(canonicalUrl))) AS k, clusterId,
    row_number() OVER (PARTITION BY CAST(createdAt AS DATE) ORDER BY coalesce(qualityScore, 0) DESC, id) AS best, row_number() OVER (PARTITION BY CAST(createdAt AS DATE) ORDER BY publishedAt DESC, id) AS newest FROM vis), used AS (SELECT * FROM c WHERE newest <= 12)"""


def reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, used): per day its candidates with their rank by quality, and those that its report used."""
    day = F.to_date("createdAt").alias("day")
    c = visible(spark, d).select(day, "id", "sid", "clusterId", "publishedAt", F.coalesce("groupId", F.lit("none")).alias("section"), F.coalesce("qualityScore", F.lit(0)).alias("q"),
                                 F.coalesce(F.concat(F.lit("cluster:"), "clusterId"), F.concat(F.lit("url:"), F.lower(F.trim("canonicalUrl")))).alias("k"))
    rank = lambda *o: F.row_number().over(Window.partitionBy("day").orderBy(*o))
    used = c.withColumn("newest", rank(F.desc("publishedAt"), "id")).filter("newest <= 12")
    return c.withColumn("best", rank(F.desc("q"), "id")).filter("best <= 20"), used


@query(f"""WITH {REPORTS}, n AS (SELECT section, day, count(*) AS n FROM used GROUP BY 1, 2), m AS (SELECT section, max(n) AS most, count(*) AS reports, round(avg(n), 2) AS mean FROM n GROUP BY 1)
    SELECT section, mean, reports, round((SELECT count(*) FROM n WHERE n.section = m.section AND n.n = most) / reports::DOUBLE, 3) AS fullRate FROM m""")
def section_fill(spark: SparkSession, d: str) -> DataFrame:
    """Items per section of a report: mean, number of reports, and share of reports that reach the section's most."""
    n = reports(spark, d)[1].groupBy("section", "day").agg(F.count(F.lit(1)).alias("n"))
    spread = n.groupBy("section", "n").agg(F.count(F.lit(1)).alias("days"))
    m = spread.groupBy("section").agg(F.round(F.sum(F.col("n") * F.col("days")) / F.sum("days"), 2).alias("mean"), F.sum("days").alias("reports"), F.max(F.struct("n", "days")).alias("m"))
    return m.select("section", "mean", "reports", F.round(F.col("m.days") / F.col("reports"), 3).alias("fullRate"))


@query(f"""WITH {REPORTS}, s AS (SELECT DISTINCT day, sid FROM used), r AS (SELECT count(DISTINCT day) AS reports, round(count(*) / count(DISTINCT day)::DOUBLE, 2) AS mean FROM s)
    SELECT sid, count(*) AS days, round(count(*) * 100.0 / any_value(reports), 1) AS share, any_value(mean) AS mean FROM s, r GROUP BY sid ORDER BY days DESC, sid LIMIT 10""")
def source_diversity(spark: SparkSession, d: str) -> DataFrame:
    """The ten sources in most reports, beside the mean number of sources of a report."""
    s = reports(spark, d)[1].select("day", "sid").distinct()
    r = s.agg(F.count_distinct("day").alias("reports"), F.count(F.lit(1)).alias("n")).select("reports", F.round(F.col("n") / F.col("reports"), 2).alias("mean"))  # one row
    g = s.groupBy("sid").agg(F.count(F.lit(1)).alias("days")).orderBy(F.desc("days"), "sid").limit(10).crossJoin(F.broadcast(r))
    return g.select("sid", "days", F.round(F.col("days") * 100.0 / F.col("reports"), 1).alias("share"), "mean")


@query(f"""WITH {REPORTS}, m AS (SELECT c.day, count(*) AS top, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.day = c.day AND u.k = c.k)) AS missed FROM c WHERE best <= 20 GROUP BY 1)
    SELECT count(*) AS reports, round(avg(missed / top::DOUBLE), 3) AS missRate FROM m""")
def candidate_miss_rate(spark: SparkSession, d: str) -> DataFrame:
    """How much of each day's twenty best candidates the report didn't use, on average."""
    best, used = reports(spark, d)
    m = best.join(used.select("day", "k").distinct().withColumn("u", F.lit(1)), ["day", "k"], "left").groupBy("day").agg(F.count(F.lit(1)).alias("top"), F.count_if(F.col("u").isNull()).alias("missed"))
    return m.agg(F.count(F.lit(1)).alias("reports"), F.round(F.avg(F.col("missed") / F.col("top")), 3).alias("missRate"))


@query(f"""WITH {REPORTS}, s AS (SELECT day, list(DISTINCT k) AS ks, list(DISTINCT clusterId) FILTER (WHERE clusterId IS NOT NULL) AS cs FROM used GROUP BY 1), o AS (SELECT day, ks, coalesce(cs, []) AS cs, lag(ks) OVER (ORDER BY day) AS pk, coalesce(lag(cs) OVER (ORDER BY day), []) AS pc FROM s)
    SELECT count(*) AS pairs, round(avg(len(list_intersect(ks, pk)) / greatest(1, len(ks) + len(pk) - len(list_intersect(ks, pk)))::DOUBLE), 3) AS sourceOverlap,
    round(avg(len(list_intersect(cs, pc)) / greatest(1, len(cs) + len(pc) - len(list_intersect(cs, pc)))::DOUBLE), 3) AS clusterOverlap FROM o WHERE pk IS NOT NULL""")
def report_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Mean Jaccard overlap of successive reports, by sources and by clusters. A report's sets are small; days are few."""
    s = reports(spark, d)[1].groupBy("day").agg(F.collect_set("k").alias("ks"), F.collect_set("clusterId").alias("cs"))
    w = Window.orderBy("day")
    o = s.withColumn("pk", F.lag("ks").over(w)).withColumn("pc", F.lag("cs").over(w)).filter("pk is not null")
    jaccard = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    return o.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(jaccard("ks", "pk")), 3).alias("sourceOverlap"), F.round(F.avg(jaccard("cs", "pc")), 3).alias("clusterOverlap"))


@query(f"""WITH {REPORTS}, t AS (SELECT *, count(*) OVER (PARTITION BY day) AS n FROM c), x AS (SELECT t.*, best <= greatest(1, ceil(n / 2.0)) AS top, newest <= 12 AS sel FROM t)
    SELECT day, count(*) AS candidates, count(*) FILTER (WHERE sel) AS selected, count(*) FILTER (WHERE top) AS pool, count(*) FILTER (WHERE sel AND top) AS selectedTop, count(*) FILTER (WHERE sel AND NOT top) AS selectedLow,
    count(*) FILTER (WHERE sel) > 0 AND count(*) FILTER (WHERE sel AND top) = 0 AS onlyLow FROM x GROUP BY 1""")
def candidate_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each day's candidates, how many of the better half a report used, and whether it used none of them."""
    c = visible(spark, d).select(F.to_date("createdAt").alias("day"), "id", "publishedAt", F.coalesce("qualityScore", F.lit(0)).alias("q"))
    w = Window.partitionBy("day")
    x = c.withColumn("best", F.row_number().over(w.orderBy(F.desc("q"), "id"))).withColumn("newest", F.row_number().over(w.orderBy(F.desc("publishedAt"), "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    x = x.withColumn("top", F.col("best") <= F.greatest(F.lit(1), F.ceil(F.col("n") / 2))).withColumn("sel", F.col("newest") <= 12)
    g = x.groupBy("day").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("sel").alias("selected"), F.count_if("top").alias("pool"), F.count_if(F.col("sel") & F.col("top")).alias("selectedTop"), F.count_if(F.col("sel") & ~F.col("top")).alias("selectedLow"))
    return g.withColumn("onlyLow", (F.col("selected") > 0) & (F.col("selectedTop") == 0))


WEEKS = "2026-06-30"


@query(f"""WITH {VISIBLE}, n AS (SELECT CAST(date_trunc('week', createdAt) AS DATE) AS week, count(DISTINCT CAST(createdAt AS DATE)) AS reports FROM vis GROUP BY 1)
    SELECT CAST(w AS DATE) AS week, reports FROM generate_series(CAST(date_trunc('week', DATE '{WEEKS}') AS DATE) - INTERVAL 364 DAY, CAST(date_trunc('week', DATE '{WEEKS}') AS DATE), INTERVAL 7 DAY) t(w) JOIN n ON n.week = CAST(w AS DATE)""")
def archive_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Reports in each of the last 53 weeks, which begin on Monday; empty weeks are left out."""
    week = lambda c: F.to_date(F.date_trunc("week", c))
    last = week(F.lit(WEEKS).cast("date"))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 364), last, F.expr("interval 7 days"))).alias("week"))
    n = visible(spark, d).groupBy(week(F.col("createdAt")).alias("week")).agg(F.count_distinct(F.to_date("createdAt")).alias("reports"))
    return spine.join(n, "week")


PRIORITY = "round(max(candidate) * 0.45 + max(relevance) * 0.35 + max(quality) * 0.10 + least(6, greatest(0, sum(sources) - 1) * 1.5) + least(4, max(fresh)) + CASE WHEN {} THEN 2 ELSE 0 END, 4)"
TOPIC_SQL = """SELECT coalesce('cluster:' || clusterId, 'single:' || id) AS topic, sid, least(100, greatest(0, coalesce(qualityScore, 0))) AS q, eff >= {0} AS isNew FROM e WHERE eff < {0} + INTERVAL 24 HOUR"""


@query(f"""WITH {VISIBLE}, e AS (SELECT *, CASE WHEN publishedAtKnown THEN publishedAt ELSE createdAt END AS eff FROM vis), m AS ({TOPIC_SQL.format(START)}), t AS (SELECT topic, max(q) AS candidate, avg(q) AS relevance, min(q) AS quality, count(DISTINCT sid) AS sources,
    count(*) FILTER (WHERE isNew) AS fresh, bool_or(NOT isNew) AS followUp FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE isNew) > 0) SELECT topic, CAST({PRIORITY.format('bool_or(followUp)')} AS DOUBLE) AS priority FROM t GROUP BY topic""")
def topic_priority(spark: SparkSession, d: str) -> DataFrame:
    """A topic's editorial priority: its strongest signals, weighted, and bounded bonuses for evidence, freshness and follow-ups."""
    v = visible(spark, d).withColumn("eff", F.when(F.col("publishedAtKnown"), F.col("publishedAt")).otherwise(F.col("createdAt")))
    start = day_start("2026-06-29")
    v = v.filter(F.col("eff") < start + F.expr("interval 24 hours")).withColumn("isNew", F.col("eff") >= start).withColumn("q", F.expr("least(100, greatest(0, coalesce(qualityScore, 0)))"))
    t = v.groupBy(F.coalesce(F.concat(F.lit("cluster:"), "clusterId"), F.concat(F.lit("single:"), "id")).alias("topic")).agg(
        F.max("q").alias("candidate"), F.avg("q").alias("relevance"), F.min("q").alias("quality"), F.count_distinct("sid").alias("sources"), F.count_if("isNew").alias("fresh"), F.bool_or(~F.col("isNew")).alias("followUp"))
    return t.filter("fresh > 0").groupBy("topic").agg(F.expr(PRIORITY.format("bool_or(followUp)")).cast("double").alias("priority"))

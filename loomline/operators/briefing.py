"""Daily briefing and report: candidates of a day, percentile context, rank scores, recent duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.feed import clamp, half_up, visible
from loomline.registry import VISIBLE, query

DAY = "2026-06-29"  # the day that the registered queries brief
START = f"TIMESTAMP '{DAY}' - INTERVAL 8 HOUR"  # its start in the briefing's clock, UTC+8
CANDIDATES = (
    VISIBLE
    + f""", e AS (SELECT *, CASE WHEN publishedAtKnown THEN publishedAt ELSE createdAt END AS eff FROM vis), m AS (SELECT *, eff >= {START} AS isNew FROM e WHERE eff < {START} + INTERVAL 24 HOUR),
    cand AS (SELECT coalesce('cluster:' || clusterId, 'single:' || id) AS entry, count(*) AS items, count(DISTINCT sid) AS sources, count(*) FILTER (WHERE isNew) AS newItems, count(DISTINCT sid) FILTER (WHERE isNew) AS newSources,
      max(least(100, greatest(0, coalesce(qualityScore, 0)))) AS quality, max(eff) FILTER (WHERE isNew) AS latest, bool_or(NOT isNew) AS followUp,
      arg_max(id, (least(100, greatest(0, coalesce(qualityScore, 0))), eff, id)) AS representative FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE isNew) > 0)"""
)


def day_start(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz") - F.expr("interval 8 hours")


def day_candidates(vis: DataFrame, day: str = DAY) -> DataFrame:
    """One row per cluster or single item with something new on the day; totals are over all members up to its end."""
    start = day_start(day)
    m = vis.withColumn("eff", F.when(F.col("publishedAtKnown"), F.col("publishedAt")).otherwise(F.col("createdAt"))).filter(F.col("eff") < start + F.expr("interval 24 hours"))
    m = m.withColumn("isNew", F.col("eff") >= start).withColumn("q", clamp(F.col("qualityScore")))
    entry = F.coalesce(F.concat(F.lit("cluster:"), "clusterId"), F.concat(F.lit("single:"), "id"))
    c = m.groupBy(entry.alias("entry")).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("sid").alias("sources"), F.count_if("isNew").alias("newItems"), F.count_distinct(F.when(F.col("isNew"), F.col("sid"))).alias("newSources"),
        F.max("q").alias("quality"), F.max(F.when(F.col("isNew"), F.col("eff"))).alias("latest"), F.bool_or(~F.col("isNew")).alias("followUp"), F.max(F.struct("q", "eff", "id")).alias("r"))
    return c.filter("newItems > 0").withColumn("representative", F.col("r.id")).drop("r")


@query(f"WITH {CANDIDATES} SELECT * FROM cand")
def briefing_candidates(spark: SparkSession, d: str) -> DataFrame:
    return day_candidates(visible(spark, d))


def percentile_counts(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_p: the mid-rank percentile of the value, null for under three rows or if all are equal.

    Counts per value are few however many rows there are: the running sum is over them, and joins back.
    """
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("_same"))
    w = Window.orderBy(column)
    n = n.withColumn("_all", F.sum("_same").over(Window.partitionBy())).withColumn("_below", F.sum("_same").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = (F.coalesce("_below", F.lit(0)) + (F.col("_same") - 1) / 2) / (F.col("_all") - 1)
    n = n.select(column, F.when((F.col("_all") >= 3) & (F.col("_same") < F.col("_all")), p).alias(f"{column}_p"))
    return df.join(n, column)


# Steps and limits of the rank score.
STEPS = {"sources": ((4, 7), (3, 5), (2, 3)), "items": ((8, 5), (4, 4), (2, 2))}


def _blend(fixed: str, col: str, top: int) -> str:
    return f"CASE WHEN {col}_p IS NULL THEN {fixed} ELSE least({top}, greatest(0, floor(({fixed} + floor({col}_p * {top} + 0.5)) / 2.0 + 0.5))) END"


def _fixed(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {n} THEN {v}" for n, v in STEPS[col]) + " ELSE 0 END"


RANK = f"""least(100, greatest(0, floor(quality * 0.65 + 0.5) + least(10, {_blend(_fixed('sources'), 'sources', 7)} + {_blend(_fixed('items'), 'items', 5)})
    + least(9, {_blend('least(6, newSources * 2)', 'newSources', 6)} + {_blend('least(3, newItems)', 'newItems', 3)}) + freshness + CASE WHEN followUp THEN 6 ELSE 3 END))"""


def _p_sql(c: str) -> str:
    return f"CASE WHEN count(*) OVER () >= 3 AND min({c}) OVER () < max({c}) OVER () THEN (rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (count(*) OVER () - 1) END AS {c}_p"


@query(f"""WITH {CANDIDATES}, p AS (SELECT *, {', '.join(map(_p_sql, ('sources', 'items', 'newSources', 'newItems')))}, floor(least(1, greatest(0, date_diff('microsecond', {START}, latest) / 86400000000.0)) * 2 + 0.5) AS freshness FROM cand)
    SELECT entry, CAST({RANK} AS INT) AS rank, latest FROM p ORDER BY rank DESC, latest DESC, entry LIMIT 30""")
def briefing_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a day: quality, evidence in all and on the day relative to the day's other entries, freshness, momentum."""
    c = day_candidates(visible(spark, d))
    for column in ("sources", "items", "newSources", "newItems"):
        c = percentile_counts(c, column)
    micros = lambda x: F.unix_micros(F.to_utc_timestamp(x.cast("timestamp"), F.current_timezone()))
    progress = (micros(F.col("latest")) - micros(day_start(DAY))) / 86400000000.0
    c = c.withColumn("freshness", half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress)) * 2))
    return c.select("entry", F.expr(RANK).cast("int").alias("rank"), "latest").orderBy(F.desc("rank"), F.desc("latest"), "entry").limit(30)


# Weights and limits of a candidate's score.
SCORE = """CAST(greatest(0, least(100, floor(50 + (quality - 50) * 0.3D + least(12, greatest(0, sources - 1) * 4) + least(6, floor(log2(greatest(1, items)) + 1e-9D) * 2) + 0.5D))) AS INT)"""


@query(f"""WITH {CANDIDATES} SELECT entry, {SCORE.replace('0.3D', 'CAST(0.3 AS DOUBLE)').replace('1e-9D', '1e-9').replace('0.5D', '0.5')} AS score, representative FROM cand ORDER BY score DESC, quality DESC, latest DESC, entry LIMIT 50""")
def report_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best fifty of a day by quality, number of sources and, by powers of two, number of items."""
    c = day_candidates(visible(spark, d)).withColumn("score", F.expr(SCORE))
    return c.orderBy(F.desc("score"), F.desc("quality"), F.desc("latest"), "entry").limit(50).select("entry", "score", "representative")


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (ORDER BY quality DESC, entry) AS k, count(*) OVER () AS n FROM cand)
    SELECT entry, k, (k - 1) // 10 AS batch FROM r WHERE k <= ceil(n / 2.0)""")
def report_batches(spark: SparkSession, d: str) -> DataFrame:
    """The better half of a day's candidates, in batches of ten. One day's candidates are ordered as a whole: they are the day's events, not its items."""
    c = day_candidates(visible(spark, d)).withColumn("k", F.row_number().over(Window.orderBy(F.desc("quality"), "entry"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return c.filter(F.col("k") <= F.ceil(F.col("n") / 2)).select("entry", "k", F.floor((F.col("k") - 1) / 10).alias("batch"))


@query(f"""WITH {VISIBLE}, r AS (SELECT clusterId, id, qualityScore, row_number() OVER (PARTITION BY clusterId ORDER BY qualityScore DESC NULLS LAST, createdAt, id) AS k FROM vis WHERE clusterId IS NOT NULL)
    SELECT clusterId, id, k FROM r WHERE k IN (1, 2, 3, 4, 5, 8, 10, 15, 20)""")
def rank_sample(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("clusterId").orderBy(F.desc_nulls_last("qualityScore"), "createdAt", "id")
    r = visible(spark, d).filter("clusterId is not null").withColumn("k", F.row_number().over(w))
    return r.filter(F.col("k").isin(1, 2, 3, 4, 5, 8, 10, 15, 20)).select("clusterId", "id", "k")


def with_title_similarity(df: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """Adds how alike two titles are: 0 if one is empty, 1 if one holds the other, else the Jaccard similarity of their pairs
    of neighbouring characters; width, case, space and punctuation don't count."""
    from loomline.functions.text import nfkc  # defining it needs a session

    plain = lambda c: F.regexp_replace(F.lower(nfkc(F.col(c))), r"[^\p{L}\p{N}]+", "")
    grams = lambda c: F.array_distinct(F.when(F.length(c) < 2, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))))
    df = df.withColumn("_x", F.coalesce(plain(a), F.lit(""))).withColumn("_y", F.coalesce(plain(b), F.lit("")))
    df = df.withColumn("_gx", grams("_x")).withColumn("_gy", grams("_y")).withColumn("_n", F.size(F.array_intersect("_gx", "_gy")))
    score = F.when((F.col("_x") == "") | (F.col("_y") == ""), F.lit(0.0)).when(F.col("_x").contains(F.col("_y")) | F.col("_y").contains(F.col("_x")), F.lit(1.0))
    return df.withColumn(name, score.otherwise(F.col("_n") / (F.size("_gx") + F.size("_gy") - F.col("_n")))).drop("_x", "_y", "_gx", "_gy", "_n")


def _narrow(c: str) -> str:
    wide = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94) if chr(0x21 + i) != "'"}
    return f"lower(translate(nfc_normalize({c}), '{''.join(wide)}', '{''.join(wide.values())}'))"


_G = "list_distinct(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)) END)"


@query(f"""WITH {VISIBLE}, t AS (SELECT id, clusterId, regexp_replace({_narrow('originalTitle')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS x, regexp_replace({_narrow('ctitle')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS y FROM vis WHERE clusterId IS NOT NULL),
    g AS (SELECT id, x, y, {_G.format('x')} AS gx, {_G.format('y')} AS gy FROM t), b AS (SELECT *, len(list_intersect(gx, gy)) AS n FROM g)
    SELECT id, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN contains(x, y) OR contains(y, x) THEN 1.0 ELSE round(n / CAST(len(gx) + len(gy) - n AS DOUBLE), 6) END AS similarity FROM b""")
def title_match(spark: SparkSession, d: str) -> DataFrame:
    """How alike an item's title and its cluster's are."""
    v = visible(spark, d).filter("clusterId is not null")
    return with_title_similarity(v, "originalTitle", "ctitle").select("id", F.round("similarity", 6).alias("similarity"))

"""The briefing by channel and the report's chain: ranks, identities, recent duplicates, sections, citations, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.briefing import RANK, START, day_start
from loomline.operators.feed import half_up, visible
from loomline.registry import VISIBLE, query
from loomline.runtime import materialize

DAY = "2026-06-29"
Q = "least(100, greatest(0, coalesce(qualityScore, 0)))"
EFF = f"{VISIBLE}, e AS (SELECT *, CASE WHEN publishedAtKnown THEN publishedAt ELSE createdAt END AS eff FROM vis), m AS (SELECT *, eff >= {START} AS isNew FROM e WHERE eff < {START} + INTERVAL 24 HOUR AND groupId IS NOT NULL)"
CHANNELS = EFF + f""", cand AS (SELECT groupId AS channel, coalesce('cluster:' || clusterId, 'single:' || id) AS entry, count(*) AS items, count(DISTINCT sid) AS sources, count(*) FILTER (WHERE isNew) AS newItems, count(DISTINCT sid) FILTER (WHERE isNew) AS newSources,
    max({Q}) AS quality, max(eff) FILTER (WHERE isNew) AS latest, bool_or(NOT isNew) AS followUp FROM m GROUP BY 1, 2 HAVING count(*) FILTER (WHERE isNew) > 0)"""


def _p(c: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY channel) >= 3 AND min({c}) OVER (PARTITION BY channel) < max({c}) OVER (PARTITION BY channel) THEN (rank() OVER (PARTITION BY channel ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY channel, {c}) - 1) / 2.0) / (count(*) OVER (PARTITION BY channel) - 1) END AS {c}_p"


RANKED = CHANNELS + f""", p AS (SELECT *, {', '.join(map(_p, ('sources', 'items', 'newSources', 'newItems')))}, floor(least(1, greatest(0, date_diff('microsecond', {START}, latest) / 86400000000.0)) * 2 + 0.5) AS freshness FROM cand), r AS (SELECT channel, entry, CAST({RANK} AS INT) AS rank, latest, followUp FROM p)"""


def channel_candidates(vis: DataFrame, day: str = DAY) -> DataFrame:
    """One row per channel and entry with something new on the day, the channel being the group of the items' sources."""
    start = day_start(day)
    m = vis.filter("groupId is not null").withColumn("eff", F.when(F.col("publishedAtKnown"), F.col("publishedAt")).otherwise(F.col("createdAt"))).filter(F.col("eff") < start + F.expr("interval 24 hours"))
    m = m.withColumn("isNew", F.col("eff") >= start).withColumn("q", F.expr(Q))
    entry = F.coalesce(F.concat(F.lit("cluster:"), "clusterId"), F.concat(F.lit("single:"), "id"))
    c = m.groupBy(F.col("groupId").alias("channel"), entry.alias("entry")).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("sid").alias("sources"), F.count_if("isNew").alias("newItems"), F.count_distinct(F.when(F.col("isNew"), F.col("sid"))).alias("newSources"),
        F.max("q").alias("quality"), F.max(F.when(F.col("isNew"), F.col("eff"))).alias("latest"), F.bool_or(~F.col("isNew")).alias("followUp"))
    return c.filter("newItems > 0")


def channel_ranks(vis: DataFrame, day: str = DAY) -> DataFrame:
    """Rank scores relative to the other entries of the channel. Values are counted per channel first: windows run over
    different values, not over entries."""
    c = materialize(channel_candidates(vis, day), "channels")
    for column in ("sources", "items", "newSources", "newItems"):
        n = c.groupBy("channel", column).agg(F.count(F.lit(1)).alias("_same"))
        w = Window.partitionBy("channel")
        n = n.withColumn("_all", F.sum("_same").over(w)).withColumn("_below", F.coalesce(F.sum("_same").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        p = (F.col("_below") + (F.col("_same") - 1) / 2) / (F.col("_all") - 1)
        c = c.join(n.select("channel", column, F.when((F.col("_all") >= 3) & (F.col("_same") < F.col("_all")), p).alias(f"{column}_p")), ["channel", column])
    micros = lambda x: F.unix_micros(F.to_utc_timestamp(x.cast("timestamp"), F.current_timezone()))
    progress = (micros(F.col("latest")) - micros(day_start(day))) / 86400000000.0
    c = c.withColumn("freshness", half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress)) * 2))
    return c.select("channel", "entry", F.expr(RANK).cast("int").alias("rank"), "latest", "followUp")


@query(f"WITH {RANKED} SELECT channel, entry, rank, followUp FROM r WHERE rank >= 40")
def channel_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each channel that reach a least rank score."""
    return channel_ranks(visible(spark, d)).filter("rank >= 40").select("channel", "entry", "rank", "followUp")


@query(f"WITH {RANKED} SELECT channel, count(*) AS entries, count(*) FILTER (WHERE followUp) AS followUps, count(*) FILTER (WHERE NOT followUp) AS fresh, count(*) FILTER (WHERE starts_with(entry, 'single:')) AS singles FROM r GROUP BY 1")
def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each channel in all, and those behind each tag."""
    return channel_candidates(visible(spark, d)).groupBy("channel").agg(F.count(F.lit(1)).alias("entries"), F.count_if("followUp").alias("followUps"), F.count_if(~F.col("followUp")).alias("fresh"), F.count_if(F.col("entry").startswith("single:")).alias("singles"))


@query(f"WITH {RANKED} SELECT entry, arg_max(channel, (rank, -ord)) AS channel, max(rank) AS rank FROM (SELECT r.*, dense_rank() OVER (ORDER BY channel) AS ord FROM r) GROUP BY 1")
def best_ranked_channel(spark: SparkSession, d: str) -> DataFrame:
    """Of the channels that an entry stands in, the one where it ranks best, the first of equals."""
    r = channel_ranks(visible(spark, d))
    return r.groupBy("entry").agg(F.min(F.struct((-F.col("rank")).alias("n"), "channel")).alias("m")).select("entry", F.col("m.channel").alias("channel"), (-F.col("m.n")).alias("rank"))


DAY_ITEMS = f"{VISIBLE}, c AS (SELECT *, {Q} AS q FROM vis WHERE createdAt >= TIMESTAMP '2026-06-29'), r AS (SELECT * FROM vis WHERE createdAt >= TIMESTAMP '2026-06-26' AND createdAt < TIMESTAMP '2026-06-29')"
IDENTITY = """CASE WHEN clusterId IS NOT NULL THEN 'cluster:' || clusterId WHEN coalesce(eventSubject, '') <> '' AND coalesce(eventObject, '') <> '' THEN concat_ws(':', 'event', coalesce(eventType, ''), eventSubject, coalesce(eventAction, ''), eventObject, coalesce(eventDate, '')) ELSE 'item:' || id END"""


def day_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = visible(spark, d).withColumn("q", F.expr(Q))
    return v.filter("createdAt >= timestamp_ntz'2026-06-29'"), v.filter("createdAt >= timestamp_ntz'2026-06-26' and createdAt < timestamp_ntz'2026-06-29'")


@query(f"WITH {DAY_ITEMS} SELECT identity, id FROM (SELECT {IDENTITY} AS identity, id, row_number() OVER (PARTITION BY {IDENTITY} ORDER BY q DESC, id) AS k FROM c) WHERE k = 1")
def unique_candidates(spark: SparkSession, d: str) -> DataFrame:
    """One candidate per cluster, else per event signature, else per item: the best, which comes first in order."""
    c = day_items(spark, d)[0].withColumn("identity", F.expr(IDENTITY))
    return c.groupBy("identity").agg(F.min(F.struct((-F.col("q")).alias("n"), "id")).alias("m")).select("identity", F.col("m.id").alias("id"))


# Words of a title that tells of a further turn, and how alike titles must be.
TURNS = "后续|新进展|进展|更新|恢复|解除|回归|重新|修复|回应|澄清|正式"
_PLAIN = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_X, _Y = _PLAIN.format("c.originalTitle"), _PLAIN.format("r.originalTitle")
_GRAMS = "list_distinct(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)) END)"
CORE = """CASE WHEN cs <> '' AND cs = rs THEN CASE WHEN co <> '' AND ro <> '' THEN co = ro OR contains(co, ro) OR contains(ro, co) OR sim >= 0.52 ELSE sim >= 0.68 END
    WHEN co <> '' AND ro <> '' THEN (co = ro OR contains(co, ro) OR contains(ro, co)) AND sim >= 0.5 ELSE sim >= 0.72 END"""
SOFT = f"({CORE}) AND NOT (turn AND NOT (sameDate AND sameAction)) AND (sameAction OR sameDate OR noDate OR sim >= 0.62)"


def _sides(p: str, o: str) -> str:
    return f"lower(trim(coalesce({p}.eventSubject, ''))) AS {o}s, lower(trim(coalesce({p}.eventObject, ''))) AS {o}o"


@query(f"""WITH {DAY_ITEMS}, x AS (SELECT c.id, c.q, {_PLAIN.format('c.originalTitle')} AS x, c.originalTitle AS title, {_sides('c', 'c')}, c.clusterId, c.canonicalUrl, c.eventType, c.eventSubject, c.eventAction, c.eventObject, c.eventDate, {_GRAMS.format(_X)} AS gx FROM c),
    y AS (SELECT {_Y} AS y, {_sides('r', 'r')}, r.clusterId AS rc, r.canonicalUrl AS ru, r.eventType AS rt, r.eventSubject AS rsub, r.eventAction AS ra, r.eventObject AS robj, r.eventDate AS rd, {_GRAMS.format(_Y)} AS gy FROM r),
    p AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0 WHEN contains(x, y) OR contains(y, x) THEN 1 ELSE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy)))::DOUBLE END AS sim, regexp_matches(title, '{TURNS}') AS turn,
      coalesce(eventAction = ra, false) AS sameAction, coalesce(eventDate = rd, false) AS sameDate, eventDate IS NULL OR rd IS NULL AS noDate FROM x, y),
    dup AS (SELECT DISTINCT id FROM p WHERE ru = canonicalUrl OR rc = clusterId OR (coalesce(eventSubject, '') <> '' AND coalesce(eventObject, '') <> '' AND eventSubject = rsub AND eventObject = robj AND (noDate OR eventDate = rd)
      AND CASE WHEN eventAction IS NOT NULL AND ra IS NOT NULL THEN eventAction = ra ELSE coalesce(eventType = rt, false) END) OR ({SOFT})) SELECT id FROM c WHERE id NOT IN (SELECT id FROM dup)""")
def without_recent_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that no recent report covered: by URL, by cluster, by event, or by a title and signature alike.

    The exact matchers are anti-joins, each on its own key. Titles alike meet by subject, or by a pair of neighbouring
    characters: titles half alike share one among the rarer half of either's, and of a title within another
    every one is shared, so the rarest of each routes too; the exact conditions are then put to what met.
    """
    from loomline.functions.text import nfkc  # defining it needs a session

    c, r = (materialize(x.select("id", "originalTitle", "clusterId", "canonicalUrl", "eventType", "eventSubject", "eventAction", "eventObject", "eventDate"), "side") for x in day_items(spark, d))
    left = c.join(r.select("canonicalUrl").distinct(), "canonicalUrl", "left_anti").join(r.filter("clusterId is not null").select("clusterId").distinct(), "clusterId", "left_anti")
    left = materialize(left, "left")
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    plain = lambda df: df.withColumn("x", F.regexp_replace(F.lower(nfkc(F.col("originalTitle"))), r"[^\p{L}\p{N}]+", "")).withColumn("s", low("eventSubject")).withColumn("o", low("eventObject"))
    grams = F.array_distinct(F.when(F.length("x") < 2, F.array("x")).otherwise(F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring(F.col("x"), i, F.lit(2)))))
    # titles are prepared once each, their pairs of characters as hashes, so that a pair of titles costs one intersection
    a, b = (materialize(plain(df).withColumn("g", F.transform(grams, lambda t: F.xxhash64(t))), "titles") for df in (left, r))
    count = b.select(F.explode("g").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def ordered(df: DataFrame) -> DataFrame:
        t = df.filter("x <> ''").select("id", F.explode("g").alias("t")).join(count, "t", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("ts"))
        return t.select("id", F.posexplode("ts.t").alias("k", "t"), F.size("ts").alias("size"))

    ta, tb = ordered(a), ordered(b)
    half = lambda df: df.filter("k <= size / 2")
    ends = lambda x, y: x.select(F.col("id").alias("i"), "t").join(y.select(F.col("id").alias("j"), "t"), "t").select("i", "j")
    met = ends(half(ta), half(tb)).unionByName(ends(ta.filter("k = 0"), tb)).unionByName(ends(ta, tb.filter("k = 0")))
    met = met.unionByName(a.filter("s <> ''").select(F.col("id").alias("i"), "s").join(b.select(F.col("id").alias("j"), "s"), "s").select("i", "j"))
    event = (F.col("eventSubject") == F.col("bs")) & (F.col("eventObject") == F.col("bo"))
    right = b.select(F.col("id").alias("j"), F.col("x").alias("y"), F.col("g").alias("h"), F.col("s").alias("rs"), F.col("o").alias("ro"), F.col("eventType").alias("rt"), F.col("eventAction").alias("ra"), F.col("eventDate").alias("rd"), F.col("eventSubject").alias("bs"), F.col("eventObject").alias("bo"))
    p = met.distinct().join(a.select(F.col("id").alias("i"), "originalTitle", "x", "g", F.col("s").alias("cs"), F.col("o").alias("co"), "eventType", "eventAction", "eventDate", "eventSubject", "eventObject"), "i").join(right, "j")
    p = p.withColumn("n", F.size(F.array_intersect("g", "h")))
    alike = F.when((F.col("x") == "") | (F.col("y") == ""), 0.0).when(F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")), 1.0)
    p = p.withColumn("sim", alike.otherwise(F.col("n") / (F.size("g") + F.size("h") - F.col("n"))))
    p = p.withColumn("turn", F.col("originalTitle").rlike(TURNS)).withColumn("sameAction", F.coalesce(F.col("eventAction") == F.col("ra"), F.lit(False))).withColumn("sameDate", F.coalesce(F.col("eventDate") == F.col("rd"), F.lit(False)))
    p = p.withColumn("noDate", F.col("eventDate").isNull() | F.col("rd").isNull())
    kind = F.when(F.col("eventAction").isNotNull() & F.col("ra").isNotNull(), F.col("eventAction") == F.col("ra")).otherwise(F.coalesce(F.col("eventType") == F.col("rt"), F.lit(False)))
    same = F.coalesce(event & (F.col("cs") != "") & (F.col("co") != "") & (F.col("noDate") | F.col("sameDate")) & kind, F.lit(False))
    dup = p.filter(same | F.expr(SOFT)).select(F.col("i").alias("id"))
    return left.select("id").join(dup, "id", "left_anti")


TOPICS = f"{DAY_ITEMS}, t AS (SELECT coalesce(groupId, 'none') AS section, coalesce(clusterId, id) AS topic, max(q) AS priority, min(id) AS least FROM c GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY priority DESC, least) AS place FROM t)"


def topics(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    t = day_items(spark, d)[0].groupBy(F.coalesce("groupId", F.lit("none")).alias("section"), F.coalesce("clusterId", "id").alias("topic")).agg(F.max("q").alias("priority"), F.min("id").alias("least"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("priority"), "least")))


@query(f"WITH {TOPICS} SELECT section, topic, priority, place, place <= 5 AS retained FROM k")
def section_plan(spark: SparkSession, d: str) -> DataFrame:
    """Topics of each section by priority, then by their least candidate; those beyond the section's limit are kept for the audit."""
    return topics(spark, d).select("section", "topic", "priority", "place", (F.col("place") <= 5).alias("retained"))


@query(f"WITH {TOPICS} SELECT section, count(*) AS input, count(*) FILTER (WHERE place <= 5) AS output, count(*) FILTER (WHERE place > 5) AS truncated FROM k GROUP BY 1")
def section_audit(spark: SparkSession, d: str) -> DataFrame:
    return topics(spark, d).groupBy("section").agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("place") <= 5).alias("output"), F.count_if(F.col("place") > 5).alias("truncated"))


@query(f"WITH {TOPICS}, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY section, place) AS n FROM k) SELECT section, topic, row_number() OVER (PARTITION BY section ORDER BY place) AS place FROM o WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY section ORDER BY place) <= 5")
def sections_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """A topic stays in the first section that has it; later ones are filled up from what they have left."""
    o = topics(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("section", "place"))).filter("n = 1")
    return o.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("place"))).filter("place <= 5").select("section", "topic", "place")


@query(f"WITH {TOPICS}, s AS (SELECT DISTINCT topic FROM k WHERE place <= 5), x AS (SELECT c.id, coalesce(c.clusterId, c.id) AS topic, row_number() OVER (PARTITION BY coalesce(c.clusterId, c.id) ORDER BY q DESC, c.id) AS n FROM c WHERE coalesce(c.clusterId, c.id) IN (SELECT topic FROM s)) SELECT topic, id, n FROM x WHERE n <= 8")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """The day's items behind each selected topic, eight at most."""
    c = day_items(spark, d)[0].withColumn("topic", F.coalesce("clusterId", "id"))
    x = c.join(topics(spark, d).filter("place <= 5").select("topic").distinct(), "topic", "left_semi")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("q"), "id"))).filter("n <= 8").select("topic", "id", "n")


@query(f"WITH {TOPICS}, u AS (SELECT topic, max(priority) AS priority, min(least) AS least FROM k GROUP BY 1 HAVING min(place) > 5) SELECT topic, priority FROM u ORDER BY priority DESC, least LIMIT 20")
def unselected_topics(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer sees of the rest: the twenty best topics that no section took."""
    u = topics(spark, d).groupBy("topic").agg(F.max("priority").alias("priority"), F.min("least").alias("least"), F.min("place").alias("first")).filter("first > 5")
    return u.orderBy(F.desc("priority"), "least").limit(20).select("topic", "priority")


@query(f"WITH {DAY_ITEMS} SELECT CAST(createdAt AS DATE) AS day, clusterId, id, canonicalUrl FROM r WHERE clusterId IS NOT NULL OR canonicalUrl IS NOT NULL")
def recent_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the reports of the days before."""
    return day_items(spark, d)[1].filter("clusterId is not null or canonicalUrl is not null").select(F.to_date("createdAt").alias("day"), "clusterId", "id", "canonicalUrl")


@query(f"WITH {DAY_ITEMS}, b AS (SELECT id, q, least(length(originalTitle) + coalesce(length(summaryText), 0), 400) AS size FROM c), s AS (SELECT *, sum(size) OVER (ORDER BY q DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM b) SELECT id, size FROM s WHERE upto <= 20000")
def briefs_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates whose briefs, cut to 400 characters each, fit a budget of 20,000 together.

    At least one character a brief: no more than the 20,000 best can fit, so the running sum is over a bounded heap.
    """
    size = F.least(F.length("originalTitle") + F.coalesce(F.length("summaryText"), F.lit(0)), F.lit(400))
    b = day_items(spark, d)[0].select("id", "q", size.alias("size")).orderBy(F.desc("q"), "id").limit(20_000)
    w = Window.orderBy(F.desc("q"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("upto", F.sum("size").over(w)).filter("upto <= 20000").select("id", "size")


@query(f"WITH {VISIBLE}, n AS (SELECT CAST(createdAt AS DATE) AS day, count(*) AS items FROM vis GROUP BY 1) SELECT day, items, CAST(date_trunc('week', day) AS DATE) AS week FROM n WHERE CAST(date_trunc('week', day) AS DATE) = DATE '2026-06-22' ORDER BY day DESC LIMIT 20")
def report_list(spark: SparkSession, d: str) -> DataFrame:
    """Days of one week, which begins on Monday, newest first."""
    n = visible(spark, d).filter("createdAt >= timestamp_ntz'2026-06-22' and createdAt < timestamp_ntz'2026-06-29'").groupBy(F.to_date("createdAt").alias("day")).agg(F.count(F.lit(1)).alias("items"))
    return n.withColumn("week", F.to_date(F.date_trunc("week", "day"))).orderBy(F.desc("day")).limit(20)

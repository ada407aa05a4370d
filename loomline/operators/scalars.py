"""Queries of the scalar functions, and operators that rest on them: roundups' children, stale children, event types, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators.feed import items_once
from loomline.registry import ITEMS, query
from loomline.runtime import table


@query(r"""SELECT doc_id, length(regexp_replace(text, '<[^>]*>', '', 'g')) AS stripped, replace(replace(replace(replace(replace(left(text, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
    '<![CDATA[' || replace(left(text, 200), ']]>', ']]]]><![CDATA[>') || ']]>' AS cdata FROM documents WHERE text IS NOT NULL""")
def markup(spark: SparkSession, d: str) -> DataFrame:
    docs, head = table(spark, d, "documents").filter("text is not null"), F.substring("text", 1, 200)
    return docs.select("doc_id", F.length(S.strip_html(F.col("text"), "")).alias("stripped"), S.xml_escape(head).alias("escaped"), S.cdata(head).alias("cdata"))


@query(rf"""WITH {ITEMS}, u AS (SELECT id, originalUrl AS u, regexp_extract(originalUrl, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(originalUrl, '^[^?#]+\?([^#]*)', 1) AS q FROM it)
    SELECT id, regexp_replace(path, '/+$', '') <> '' OR q <> '' AS specific, lower(regexp_extract(u, '^([A-Za-z]+://[^/?#]+)', 1)) || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE '/' END || CASE WHEN q <> '' THEN '?' || q ELSE regexp_extract(u, '^[^?#]+(\?)', 1) END AS comparable FROM u""")
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    return items_once(spark, d).select("id", S.specific_url(F.col("originalUrl")).alias("specific"), S.comparable_url(F.col("originalUrl")).alias("comparable"))


@query(rf"""WITH {ITEMS} SELECT id, left(regexp_replace(regexp_replace(lower(originalTitle), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS slug, CAST(createdAt + INTERVAL 8 HOUR AS DATE) AS day,
    nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(originalTitle, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '[`_\[\]()#>]', '', 'g'), '\s+', ' ', 'g')), 120), '') AS child FROM it""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("originalTitle")
    return items_once(spark, d).select("id", S.slug(t).alias("slug"), S.local_day(F.col("createdAt")).alias("day"), S.child_title(t).alias("child"))


LEVELS = (0, 20, 40, 60, 75, 90, 100)


@query(f"WITH {ITEMS} SELECT id, (SELECT arg_min(x, (abs(x - qualityScore), x)) FROM (VALUES {', '.join(f'({x})' for x in LEVELS)}) l(x)) AS level FROM it WHERE qualityScore IS NOT NULL")
def rubric_levels(spark: SparkSession, d: str) -> DataFrame:
    return items_once(spark, d, "qualityScore is not null").select("id", S.snapped(F.col("qualityScore"), list(LEVELS)).alias("level"))


ALIASES = {"merger": "deal", "deal": "deal", "product-launch": "launch", "launch": "launch", "lawsuit": "court", "court": "court"}


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN trim(eventType) <> '' THEN coalesce(CASE regexp_replace(lower(eventType), '[ _-]+', '', 'g') {' '.join(f"WHEN '{k.replace('-', '')}' THEN '{v}'" for k, v in ALIASES.items())} END, 'other') END AS type, eventType AS raw FROM it""")
def event_types(spark: SparkSession, d: str) -> DataFrame:
    return items_once(spark, d).select("id", S.mapped_type(F.col("eventType"), ALIASES).alias("type"), F.col("eventType").alias("raw"))


@query("SELECT event_id, CASE WHEN regexp_matches(props->>'$.k', '^[0-9]{1,15}$') THEN CAST(props->>'$.k' AS BIGINT) ELSE 0 END AS k FROM events")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.usage(F.col("props"), "k").alias("k"))


@query(f"""WITH {ITEMS} SELECT id, coalesce(length(trim(rssExcerpt)), 0) < 200 AS needsText, CASE WHEN summaryText IS NULL OR trim(summaryText) = '' THEN 'missing' WHEN length(trim(summaryText)) < 20 THEN 'short' WHEN length(summaryText) > 800 THEN 'long'
    WHEN length(regexp_replace(summaryText, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) * 5 < length(summaryText) AND length(regexp_replace(summaryText, '[^A-Za-z]', '', 'g')) * 2 > length(summaryText) THEN 'untranslated' ELSE 'good' END AS summary FROM it""")
def text_needs(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item's full text has to be fetched, and whether its summary, which is to be Chinese, has to be written anew."""
    s = F.col("summaryText")
    han, latin = F.regexp_count(s, F.lit(r"[\u4e00-\u9fff]")), F.regexp_count(s, F.lit("[A-Za-z]"))
    verdict = F.when(s.isNull() | (F.trim(s) == ""), "missing").when(F.length(F.trim(s)) < 20, "short").when(F.length(s) > 800, "long").when((han * 5 < F.length(s)) & (latin * 2 > F.length(s)), "untranslated").otherwise("good")
    return items_once(spark, d).select("id", (F.coalesce(F.length(F.trim("rssExcerpt")), F.lit(0)) < 200).alias("needsText"), verdict.alias("summary"))


CHILD = """c AS (SELECT i.*, p.originalUrl AS parentUrl, sha256(lower(concat_ws('|', coalesce(i.eventType, ''), coalesce(i.eventSubject, ''), coalesce(i.eventAction, ''), coalesce(i.eventObject, ''), coalesce(i.eventDate, '')))) AS fp FROM it i JOIN it p ON p.id = i.parentItemId),
    k AS (SELECT *, CASE WHEN regexp_extract(originalUrl, '^https?://[^/?#]+/+([^?#]+)', 1) <> '' AND originalUrl <> parentUrl THEN 'source-url:' || originalUrl ELSE 'semantic:' || sid || '|' || fp END AS dedupeKey FROM c)"""


def child_rows(spark: SparkSession, d: str) -> DataFrame:
    """Items split off a roundup with their dedupe keys: their own URL if it names a page of its own, else source and event."""
    it = items_once(spark, d)
    parents = it.select(F.col("id").alias("parentItemId"), F.col("originalUrl").alias("parentUrl"))
    blank = [F.coalesce(c, F.lit("")) for c in ("eventType", "eventSubject", "eventAction", "eventObject", "eventDate")]
    fp = F.sha2(F.lower(F.concat_ws("|", *blank)), 256)
    own = (F.regexp_extract("originalUrl", "^https?://[^/?#]+/+([^?#]+)", 1) != "") & (F.col("originalUrl") != F.col("parentUrl"))
    c = it.filter("parentItemId is not null").join(parents, "parentItemId")
    return c.withColumn("dedupeKey", F.when(own, F.concat(F.lit("source-url:"), "originalUrl")).otherwise(F.concat(F.lit("semantic:"), "sid", F.lit("|"), fp)))


@query(f"WITH {ITEMS}, {CHILD} SELECT id, dedupeKey, sha256(originalUrl || '#event-' || left(sha256(dedupeKey), 32)) AS urlHash FROM k")
def child_keys(spark: SparkSession, d: str) -> DataFrame:
    return child_rows(spark, d).select("id", "dedupeKey", F.sha2(F.concat("originalUrl", F.lit("#event-"), F.substring(F.sha2("dedupeKey", 256), 1, 32)), 256).alias("urlHash"))


@query(f"WITH {ITEMS}, {CHILD}, r AS (SELECT parentItemId, dedupeKey, id, row_number() OVER (PARTITION BY parentItemId, dedupeKey ORDER BY createdAt, id) AS n, row_number() OVER (PARTITION BY parentItemId ORDER BY createdAt, id) - 1 AS eventIndex FROM k) SELECT parentItemId, id, eventIndex FROM r WHERE n = 1")
def roundup_children(spark: SparkSession, d: str) -> DataFrame:
    """One child per different key of a roundup, the first in event order, with its place among the events."""
    w = Window.partitionBy("parentItemId").orderBy("createdAt", "id")
    r = child_rows(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("parentItemId", "dedupeKey").orderBy("createdAt", "id"))).withColumn("eventIndex", F.row_number().over(w) - 1)
    return r.filter("n = 1").select("parentItemId", "id", "eventIndex")


@query(f"""WITH {ITEMS}, {CHILD}, gone AS (SELECT id FROM it WHERE isAggregation AND status <> 'processed'), l AS (SELECT k.id, k.dedupeKey, k.parentItemId, k.createdAt FROM k), keep AS (SELECT dedupeKey, arg_min(parentItemId, (createdAt, parentItemId)) AS parent FROM l WHERE parentItemId NOT IN (SELECT id FROM gone) GROUP BY 1)
    SELECT l.id, keep.parent, CASE WHEN keep.parent IS NULL THEN 'filtered' ELSE 'reassigned' END AS fate FROM l JOIN gone ON gone.id = l.parentItemId LEFT JOIN keep USING (dedupeKey)""")
def retired_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of roundups that no longer hold: each goes to the earliest other roundup that has its key, else it is filtered."""
    links = child_rows(spark, d).select("id", "dedupeKey", "parentItemId", "createdAt")
    gone = items_once(spark, d, "isAggregation and status <> 'processed'").select(F.col("id").alias("parentItemId"))
    keep = links.join(gone, "parentItemId", "left_anti").groupBy("dedupeKey").agg(F.min(F.struct("createdAt", "parentItemId")).alias("m")).select("dedupeKey", F.col("m.parentItemId").alias("parent"))
    out = links.join(gone, "parentItemId", "left_semi").join(keep, "dedupeKey", "left")
    return out.select("id", "parent", F.when(F.col("parent").isNull(), "filtered").otherwise("reassigned").alias("fate"))


@query(f"WITH {ITEMS}, n AS (SELECT parentItemId AS p, count(*) AS linked, count(*) FILTER (WHERE originalUrl <> pu) AS ownUrl FROM (SELECT i.*, p.originalUrl AS pu FROM it i JOIN it p ON p.id = i.parentItemId) GROUP BY 1) SELECT id, coalesce(linked, 0) AS linked, coalesce(ownUrl, 0) AS ownUrl, coalesce(linked - ownUrl, 0) AS parentUrl FROM it LEFT JOIN n ON p = id WHERE isAggregation")
def roundup_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every roundup with its linked children, and how many have a URL of their own."""
    it = items_once(spark, d)
    parents = it.filter("isAggregation").select(F.col("id").alias("parentItemId"), F.col("originalUrl").alias("pu"))
    kids = it.filter("parentItemId is not null").select("parentItemId", "originalUrl")
    n = parents.join(kids, "parentItemId", "left").groupBy(F.col("parentItemId").alias("id")).agg(F.count("originalUrl").alias("linked"), F.count_if(F.coalesce(F.col("originalUrl") != F.col("pu"), F.lit(False))).alias("ownUrl"))
    return n.withColumn("parentUrl", F.col("linked") - F.col("ownUrl"))


@query(f"WITH {ITEMS} SELECT id FROM it WHERE isAggregation AND NOT EXISTS (SELECT 1 FROM it c WHERE c.parentItemId = it.id)")
def unsplit_roundups(spark: SparkSession, d: str) -> DataFrame:
    kids = items_once(spark, d, "parentItemId is not null").select(F.col("parentItemId").alias("id"))
    return items_once(spark, d, "isAggregation").join(kids, "id", "left_anti").select("id")


STALE = """CASE WHEN TRY_CAST(CASE WHEN regexp_matches(trim(eventDate), '^\\d{4}-\\d{2}-\\d{2}$') THEN trim(eventDate) END AS DATE) IS NULL THEN 'no_event_date' WHEN age <= 14 THEN 'within_threshold'
    WHEN NOT (contains(t, left(trim(eventDate), 4) || '年') OR regexp_matches(t, left(trim(eventDate), 4) || '\\s*[-/]\\s*\\d{1,2}\\s*[-/]\\s*\\d{1,2}')) THEN 'year_unverified'
    WHEN regexp_matches(t, '\\d{1,2}\\s*月\\s*\\d{1,2}\\s*日\\s*[^\\d]{0,4}(消息|电|讯)|(北京时间|当地时间|今日|昨天)\\s*[^\\d]{0,6}\\d{1,2}\\s*月\\s*\\d{1,2}\\s*日') THEN 'dateline_only' ELSE 'stale' END"""


@query(f"""WITH {ITEMS}, a AS (SELECT id, eventDate, parentItemId, regexp_replace(concat_ws(' ', originalTitle, summaryText, rssExcerpt), '\\s+', ' ', 'g') AS t, floor(date_diff('second', TRY_CAST(eventDate AS TIMESTAMP), CASE WHEN publishedAtKnown THEN publishedAt ELSE createdAt END) / 86400.0) AS age FROM it)
    SELECT id, {STALE} AS verdict, parentItemId IS NOT NULL AND NOT contains(t, trim(coalesce(eventDate, '-'))) AS exempt FROM a""")
def stale_content(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item tells of an event long past: its date must be a day, over 14 days before publication (or arrival, if that is
    unknown), its year named in the text, and the text's date not just a dateline. A roundup's child is exempt if its own text lacks the date."""
    text = F.regexp_replace(F.concat_ws(" ", "originalTitle", "summaryText", "rssExcerpt"), r"\s+", " ")
    day = F.trim("eventDate")
    at = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))
    base = F.when(F.col("publishedAtKnown"), F.col("publishedAt")).otherwise(F.col("createdAt"))
    age = F.floor(F.timestamp_diff("SECOND", at, base) / 86400)
    year = F.substring(day, 1, 4)
    told = F.contains(text, F.concat(year, F.lit("年"))) | F.regexp_like(text, F.concat(year, F.lit(r"\s*[-/]\s*\d{1,2}\s*[-/]\s*\d{1,2}")))
    line = text.rlike(r"\d{1,2}\s*月\s*\d{1,2}\s*日\s*[^\d]{0,4}(?:消息|电|讯)|(?:北京时间|当地时间|今日|昨天)\s*[^\d]{0,6}\d{1,2}\s*月\s*\d{1,2}\s*日")
    verdict = F.when(at.isNull(), "no_event_date").when(age <= 14, "within_threshold").when(~told, "year_unverified").when(line, "dateline_only").otherwise("stale")
    return items_once(spark, d).select("id", verdict.alias("verdict"), (F.col("parentItemId").isNotNull() & ~F.contains(text, F.coalesce(day, F.lit("-")))).alias("exempt"))

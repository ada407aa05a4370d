"""Ingestion: URL identity, rule filter, staleness, fair selection, dedupe, upserts and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.feed import items_once
from loomline.registry import ITEMS, query
from loomline.runtime import table

# Tracking parameters, and the rule filter's patterns, phrases and penalties.
TRACKING = "utm_source|utm_medium|utm_campaign|utm_term|utm_content"
TITLE_RULES = ((r"(?i)\b(sponsored|advertorial|partner content|promoted)\b", "sponsored"), (r"(?i)\b(webinar|coupon|deal alert|giveaway)\b", "marketing"),
               (r"(?i)\b(weekly roundup|daily roundup|newsletter|digest)\b", "roundup"))
URL_RULES = ((r"(?i)/(sponsored|advertorial|promo|promoted)(/|$)", "sponsored_path"), (r"(?i)/(webinar|events?|newsletter|deals?)(/|$)", "low_signal_path"),
             (r"(?i)[?&](utm_campaign|coupon|promo)=", "campaign_url"))
PHRASES = ("all rights reserved", "subscribe to our newsletter", "sign up for our newsletter", "this press release", "forward-looking statements", "safe harbor statement")
BLACKLIST = ("strike", "fuga de datos")


def canonical_url(c: Column) -> Column:
    """Without fragment and tracking parameters."""
    c = F.regexp_replace(c, "#.*$", "")
    c = F.regexp_replace(c, f"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    return F.regexp_replace(c, "[?&]$", "")


@query(f"""WITH {ITEMS}, u AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(originalUrl, '#.*$', ''), '([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\\1', 'g'), '[?&]$', '') AS url FROM it)
    SELECT id, url, sha256(url) AS urlHash FROM u""")
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    url = canonical_url(F.col("originalUrl"))
    return items_once(spark, d).select("id", url.alias("url"), F.sha2(url, 256).alias("urlHash"))


@query(f"WITH {ITEMS} SELECT id, regexp_replace(regexp_extract(lower(originalUrl), '^https?://([^/?#]+)', 1), '^www\\.', '') AS host, regexp_replace(regexp_replace(originalUrl, '[?#].*$', ''), '/+$', '') AS compare FROM it")
def compare_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("originalUrl")
    host = F.regexp_replace(F.regexp_extract(F.lower(u), "^https?://([^/?#]+)", 1), r"^www\.", "")
    return items_once(spark, d).select("id", host.alias("host"), F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "").alias("compare"))


def rule_filter(df: DataFrame, title: str, content: str, url: str, blacklist: tuple[str, ...]) -> DataFrame:
    """Adds score, filtered and reason: penalties from 100 down; reason is the first rule met, in rule order."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    df = df.withColumn("_t", plain(title)).withColumn("_c", plain(content)).withColumn("_h", F.lower(F.concat_ws("\n", "_t", "_c")))
    size = F.length(F.trim(F.concat_ws(" ", "_t", "_c")))
    rules = [(F.col("_h").contains(k.lower()), 100, k) for k in blacklist]
    rules += [(F.col("_t").rlike(p), 45, label) for p, label in TITLE_RULES] + [(F.coalesce(F.col(url), F.lit("")).rlike(p), 35, label) for p, label in URL_RULES]
    rules.append(((size > 0) & (size < 120), 25, "too_short"))
    met = sum((F.when(F.col("_h").contains(p), 1).otherwise(0) for p in PHRASES), F.lit(0))
    rules.append((met >= 2, 20, "template_phrases"))
    score = F.greatest(F.lit(0), F.lit(100) - sum((F.when(c, n).otherwise(0) for c, n, _ in rules), F.lit(0)))
    black = F.lit(False)
    for c, _, _ in rules[: len(blacklist)]:
        black = black | c
    reason = F.coalesce(*[F.when(c, F.lit(label)) for c, _, label in rules])
    return df.withColumn("score", score).withColumn("filtered", black | (score < 50)).withColumn("reason", reason).drop("_t", "_c", "_h")


def _rule_sql() -> str:
    rules = [(f"contains(h, '{k}')", 100, k) for k in BLACKLIST]
    rules += [(f"regexp_matches(t, '{p}')", 45, k) for p, k in TITLE_RULES] + [(f"regexp_matches(originalUrl, '{p}')", 35, k) for p, k in URL_RULES]
    rules += [("length(trim(t || ' ' || c)) BETWEEN 1 AND 119", 25, "too_short"), ("(" + " + ".join(f"CAST(contains(h, '{p}') AS INT)" for p in PHRASES) + ") >= 2", 20, "template_phrases")]
    score = "greatest(0, 100 - (" + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in rules) + "))"
    reason = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in rules) + " END"
    plain = lambda c: f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"""WITH {ITEMS}, n AS (SELECT id, originalUrl, {plain('originalTitle')} AS t, {plain('rssExcerpt')} AS c FROM it), h AS (SELECT *, lower(t || chr(10) || c) AS h FROM n)
        SELECT id, {score} AS score, ({' OR '.join(c for c, _, _ in rules[: len(BLACKLIST)])}) OR {score} < 50 AS filtered, {reason} AS reason FROM h"""


@query(_rule_sql())
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return rule_filter(items_once(spark, d), "originalTitle", "rssExcerpt", "originalUrl", BLACKLIST).select("id", "score", "filtered", "reason")


STALE_SQL = """CASE WHEN NOT publishedAtKnown THEN 'unknown_published' WHEN eventDate IS NULL THEN 'no_event_date' WHEN NOT regexp_matches(eventDate, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'partial_date'
    WHEN age < 0 THEN 'future_event' WHEN age < 14 THEN 'within_threshold' ELSE 'stale' END"""


@query(f"""WITH {ITEMS}, a AS (SELECT *, date_diff('day', TRY_CAST(eventDate AS DATE), CAST(publishedAt AS DATE)) AS age FROM it) SELECT id, {STALE_SQL} AS verdict FROM a""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Ordered guards; an item is stale if its event lies 14 days or more before a known publication."""
    age = F.datediff(F.to_date("publishedAt"), F.expr("try_to_date(eventDate, 'yyyy-MM-dd')"))
    verdict = (
        F.when(~F.col("publishedAtKnown"), "unknown_published").when(F.col("eventDate").isNull(), "no_event_date").when(~F.col("eventDate").rlike(r"^\d{4}-\d{2}-\d{2}$"), "partial_date")
        .when(age < 0, "future_event").when(age < 14, "within_threshold").otherwise("stale")
    )
    return items_once(spark, d).select("id", verdict.alias("verdict"))


@query(f"""WITH {ITEMS}, r AS (SELECT id, sid, createdAt, urlHash, row_number() OVER (PARTITION BY sid ORDER BY createdAt, urlHash) AS k FROM (SELECT it.*, i.urlHash FROM it JOIN (SELECT id, min(urlHash) AS urlHash FROM items GROUP BY 1) i USING (id)) WHERE status IN ('new', 'fetched', 'failed'))
    SELECT id, sid, k FROM r WHERE k <= 5 ORDER BY createdAt, urlHash LIMIT 60""")
def fair_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first five waiting items of each source, then the first sixty over all, both by time of creation and URL hash."""
    w = Window.partitionBy("sid").orderBy("createdAt", "urlHash")
    wait = items_once(spark, d, "status in ('new', 'fetched', 'failed')").withColumn("k", F.row_number().over(w)).filter("k <= 5")
    return wait.orderBy("createdAt", "urlHash").limit(60).select("id", "sid", "k")


@query("SELECT urlHash, max(updatedAt) AS updatedAt, count(*) AS n, count(DISTINCT id) AS ids FROM items GROUP BY urlHash HAVING count(*) > 1")
def repeated_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").groupBy("urlHash").agg(F.max("updatedAt").alias("updatedAt"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).filter("n > 1")


@query(f"""WITH {ITEMS}, old AS (SELECT DISTINCT canonicalUrl FROM it WHERE createdAt < TIMESTAMP '2026-06-28') SELECT id FROM it WHERE createdAt >= TIMESTAMP '2026-06-28'
    AND NOT EXISTS (SELECT 1 FROM old WHERE old.canonicalUrl = it.canonicalUrl)""")
def unseen_urls(spark: SparkSession, d: str) -> DataFrame:
    it = items_once(spark, d).select("id", "canonicalUrl", "createdAt")
    old = it.filter("createdAt < timestamp_ntz'2026-06-28'").select("canonicalUrl")
    return it.filter("createdAt >= timestamp_ntz'2026-06-28'").join(old, "canonicalUrl", "left_anti").select("id")


@query(f"""WITH {ITEMS}, o AS (SELECT urlHash, min(createdAt) AS firstSeen, max(updatedAt) AS lastSeen, arg_max(id, (updatedAt, id)) AS id FROM items WHERE createdAt < TIMESTAMP '2026-06-25' GROUP BY 1)
    SELECT urlHash, firstSeen, lastSeen, id FROM o""")
def retention_history(spark: SparkSession, d: str) -> DataFrame:
    """What items beyond retention leave in the history: one row per URL with first and last sight."""
    old = table(spark, d, "items").filter("createdAt < timestamp_ntz'2026-06-25'")
    out = old.groupBy("urlHash").agg(F.min("createdAt").alias("firstSeen"), F.max("updatedAt").alias("lastSeen"), F.max(F.struct("updatedAt", "id")).alias("m"))
    return out.select("urlHash", "firstSeen", "lastSeen", F.col("m.id").alias("id"))


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Target rows replaced by, and joined with, the last change of each key. Rows with a null key are kept as they are."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    new = changes.filter(F.col(key).isNotNull()).withColumn("_r", last).filter("_r = 1").drop("_r")
    return target.join(new.select(key), key, "left_anti").select(target.columns).unionByName(new.select(target.columns))


@query("""WITH t AS (SELECT id, urlHash, updatedAt FROM items WHERE createdAt < TIMESTAMP '2026-06-26'), c AS (SELECT id, urlHash, updatedAt FROM items WHERE createdAt >= TIMESTAMP '2026-06-24'),
    n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY updatedAt DESC) = 1) SELECT * FROM t WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upserted_items(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "items").select("id", "urlHash", "updatedAt", "createdAt")
    return upsert(t.filter("createdAt < timestamp_ntz'2026-06-26'").drop("createdAt"), t.filter("createdAt >= timestamp_ntz'2026-06-24'").drop("createdAt"), "id", "updatedAt")


@query(f"""WITH {ITEMS} SELECT sid, CAST(sum(CAST('0x' || left(sha256(id || '|' || originalTitle || '|' || canonicalUrl), 12) AS BIGINT)) AS VARCHAR) AS digest, count(*) AS n FROM it GROUP BY sid""")
def feed_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all that each source offers, for change detection: the sum of its lines' hashes. Unlike a hash
    of the joined lines it needs no order and no row that holds a whole source."""
    line = F.sha2(F.concat_ws("|", "id", "originalTitle", "canonicalUrl"), 256)
    number = F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)")
    return items_once(spark, d).groupBy("sid").agg(F.sum(number).cast("string").alias("digest"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, attemptCount, CAST(least(360, 15 * power(2, greatest(attemptCount, 1) - 1)) AS INT) AS minutes FROM cluster_decisions QUALIFY row_number() OVER (PARTITION BY id ORDER BY attemptCount) = 1")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "cluster_decisions").groupBy("id").agg(F.min("attemptCount").alias("attemptCount"))
    return one.withColumn("minutes", F.least(F.lit(360), 15 * F.power(F.lit(2), F.greatest("attemptCount", F.lit(1)) - 1)).cast("int"))


@query(r"""SELECT doc_id, length(regexp_replace(x, '^ +| +$', '', 'g')) AS n, length(text) - length(replace(text, '<', '')) AS tags FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL)""")
def stripped_documents(spark: SparkSession, d: str) -> DataFrame:
    x = F.regexp_replace(F.regexp_replace("text", "<[^>]+>", " "), r"[ \t\n\r]+", " ")
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.length(F.regexp_replace(x, "^ +| +$", "")).alias("n"), (F.length("text") - F.length(F.replace("text", F.lit("<"), F.lit("")))).alias("tags"))


@query("SELECT doc_id, CASE WHEN length(text) > 32000 THEN left(text, 32000) || chr(10) || '[truncated]' ELSE text END AS text FROM documents WHERE length(trim(coalesce(text, ''))) > 0")
def truncated_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("length(trim(coalesce(text, ''))) > 0")
    return docs.select("doc_id", F.when(F.length("text") > 32000, F.concat(F.substring("text", 1, 32000), F.lit("\n[truncated]"))).otherwise(F.col("text")).alias("text"))

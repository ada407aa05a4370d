"""What is published of the feed: RSS, sitemap, listings, pages as JSON, a report as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.scalars import cdata, xml_escape
from loomline.operators.feed import TITLE_SQL, entries, page, visible
from loomline.registry import ENTRIES, VISIBLE, query

ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
TITLE = "coalesce(nullif(trim(translatedTitle), ''), originalTitle)"
NEWEST = f"{VISIBLE}, n AS (SELECT *, {TITLE_SQL} AS title FROM vis ORDER BY createdAt DESC, id DESC LIMIT 200)"


def newest(spark: SparkSession, d: str, most: int = 200) -> DataFrame:
    return visible(spark, d).withColumn("title", F.expr(TITLE)).orderBy(F.desc("createdAt"), F.desc("id")).limit(most)


@query(f"WITH {NEWEST} SELECT id, '<url><loc>' || {ESC.format('canonicalUrl')} || '</loc><news:publication_date>' || strftime(publishedAt, '%Y-%m-%dT%H:%M:%SZ') || '</news:publication_date><news:title>' || {ESC.format('title')} || '</news:title></url>' AS xml FROM n")
def news_sitemap(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return newest(spark, d).select("id", F.concat(F.lit("<url><loc>"), xml_escape(F.col("canonicalUrl")), F.lit("</loc><news:publication_date>"), at, F.lit("</news:publication_date><news:title>"), xml_escape(F.col("title")), F.lit("</news:title></url>")).alias("xml"))


@query(f"WITH {NEWEST} SELECT id, '- [' || replace(replace(title, '[', '('), ']', ')') || '](' || canonicalUrl || ')' || CASE WHEN trim(coalesce(summaryText, '')) <> '' THEN ': ' || left(trim(summaryText), 200) ELSE '' END AS line FROM n")
def text_listing(spark: SparkSession, d: str) -> DataFrame:
    """The newest items as lines of a plain listing."""
    title = F.replace(F.replace("title", F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    about = F.when(F.trim(F.coalesce("summaryText", F.lit(""))) != "", F.concat(F.lit(": "), F.substring(F.trim("summaryText"), 1, 200))).otherwise(F.lit(""))
    return newest(spark, d).select("id", F.concat(F.lit("- ["), title, F.lit("]("), "canonicalUrl", F.lit(")"), about).alias("line"))


@query(f"""WITH {ENTRIES}, p AS (SELECT * FROM entries ORDER BY created DESC, score DESC, itemCount DESC, entryId DESC LIMIT 20)
    SELECT entryId, '{{"type":"' || entryType || '","id":"' || entryId || '","score":' || score || ',"items":' || itemCount || ',"sources":' || sourceCount || '}}' AS json FROM p""")
def feed_json(spark: SparkSession, d: str) -> DataFrame:
    """A page of the feed as the API gives it."""
    p = page(entries(visible(spark, d)), "newest", 1, 20)
    return p.select("entryId", F.to_json(F.struct(F.col("entryType").alias("type"), F.col("entryId").alias("id"), "score", F.col("itemCount").alias("items"), F.col("sourceCount").alias("sources"))).alias("json"))


MEMBERS = f"""{VISIBLE}, k AS (SELECT clusterId, id, originalUrl, {TITLE_SQL} AS title, ctitle, csummary, row_number() OVER (PARTITION BY clusterId ORDER BY publishedAt DESC, createdAt DESC, id) AS n, count(*) OVER (PARTITION BY clusterId) AS items FROM vis WHERE clusterId IS NOT NULL)"""


def members(spark: SparkSession, d: str, most: int) -> DataFrame:
    """The newest visible items of each cluster of several, with their place. Clusters' windows are cut before they are shuffled."""
    v = visible(spark, d).filter("clusterId is not null").withColumn("title", F.expr(TITLE))
    n = v.groupBy("clusterId").agg(F.count(F.lit(1)).alias("items")).filter("items > 1")
    w = Window.partitionBy("clusterId").orderBy(F.desc("publishedAt"), F.desc("createdAt"), "id")
    return v.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).join(n, "clusterId").select("clusterId", "id", "originalUrl", "title", "ctitle", "csummary", "n", "items")


LI = f"'<li><a href=\"' || {ESC.format('originalUrl')} || '\">' || {ESC.format('title')} || '</a></li>'"


@query(f"""WITH {MEMBERS} SELECT clusterId, '<item><title>' || {ESC.format('any_value(ctitle)')} || '</title><description><![CDATA[' || replace(coalesce(any_value(csummary), '') || '<ul>' || string_agg({LI}, '' ORDER BY n) || '</ul>', ']]>', ']]]]><![CDATA[>') || ']]></description></item>' AS xml FROM k WHERE items > 1 AND n <= 5 GROUP BY clusterId""")
def rss_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as RSS items, with a list of their newest items."""
    li = F.concat(F.lit('<li><a href="'), xml_escape(F.col("originalUrl")), F.lit('">'), xml_escape(F.col("title")), F.lit("</a></li>"))
    g = members(spark, d, 5).withColumn("li", li).groupBy("clusterId").agg(F.min("ctitle").alias("t"), F.min("csummary").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "li"))), lambda x: x["li"]), "").alias("ul"))
    body = cdata(F.concat(F.coalesce("s", F.lit("")), F.lit("<ul>"), "ul", F.lit("</ul>")))
    return g.select("clusterId", F.concat(F.lit("<item><title>"), xml_escape(F.col("t")), F.lit("</title><description>"), body, F.lit("</description></item>")).alias("xml"))


@query(f"""WITH {MEMBERS} SELECT clusterId, '### ' || any_value(ctitle) || chr(10) || chr(10) || coalesce(any_value(csummary), '') || chr(10) || chr(10) || string_agg('[' || n || '] ' || originalUrl, chr(10) ORDER BY n) AS markdown FROM k WHERE items > 1 AND n <= 3 GROUP BY clusterId""")
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as sections of a report, with numbered sources."""
    cite = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "originalUrl")
    g = members(spark, d, 3).withColumn("c", cite).groupBy("clusterId").agg(F.min("ctitle").alias("t"), F.min("csummary").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), "\n").alias("cs"))
    return g.select("clusterId", F.concat(F.lit("### "), "t", F.lit("\n\n"), F.coalesce("s", F.lit("")), F.lit("\n\n"), "cs").alias("markdown"))

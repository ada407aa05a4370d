"""The mixed feed of items and event clusters: visibility, entries, orders, pages, facets, search, previews."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.registry import DOMINANT, ENTRIES, ITEMS, STATS, VISIBLE, query
from loomline.runtime import materialize, table


def items_once(spark: SparkSession, d: str, where: str | None = None) -> DataFrame:
    """Each item id once, the row updated last; sid is the source in lower case without outer blanks.

    `where` is a condition on the items. Rows of one id differ in updatedAt alone, so a condition on anything else is
    applied before rows are compared: it reaches the scan, and only what is left is shuffled.
    """
    items = table(spark, d, "items").withColumn("sid", F.lower(F.trim("sourceId"))).drop("sourceId")
    items = items.filter(where) if where else items
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updatedAt")))
    return items.withColumn("_r", newest).filter("_r = 1").drop("_r")


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, top: int = 100) -> Column:
    return F.least(F.lit(top), F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))).cast("int")


def visible(spark: SparkSession, d: str) -> DataFrame:
    """Processed, allowed items of enabled sources, in no cluster or an active one. Sources are a small dimension; Spark chooses the join."""
    items = items_once(spark, d, "status = 'processed' and moderationStatus in ('allowed', 'restored') and not isAggregation")
    sources = table(spark, d, "sources").filter("enabled").select(F.col("id").alias("sid"), "groupId")
    clusters = table(spark, d, "content_clusters").select(F.col("id").alias("clusterId"), F.col("status").alias("cstatus"), F.col("title").alias("ctitle"), F.col("summary").alias("csummary"))
    return items.join(sources, "sid").join(clusters, "clusterId", "left").filter("clusterId is null or cstatus = 'active'")


def cluster_stats(vis: DataFrame) -> DataFrame:
    return vis.filter("clusterId is not null").groupBy("clusterId").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("sources"), clamp(half_up(F.avg("qualityScore"))).alias("score"),
        F.max("publishedAt").alias("published"), F.max("createdAt").alias("created"))


def dominant_groups(vis: DataFrame) -> DataFrame:
    """Of each cluster the group of most items, then of the earliest item, then of the least id."""
    per = vis.filter("clusterId is not null and groupId is not null").groupBy("clusterId", "groupId").agg(F.count(F.lit(1)).alias("n"), F.min("createdAt").alias("first"))
    return per.groupBy("clusterId").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "groupId")).alias("m")).select("clusterId", "m.groupId")


def entries(vis: DataFrame) -> DataFrame:
    """Clusters of more than one visible item, and all other visible items as singles."""
    stats = cluster_stats(vis)
    many = stats.filter("n > 1").join(dominant_groups(vis), "clusterId", "left").select(
        F.lit("cluster").alias("entryType"), F.col("clusterId").alias("entryId"), "published", "created", "score", F.col("n").alias("itemCount"),
        F.col("sources").alias("sourceCount"), F.col("groupId").alias("entryGroup"))
    alone = vis.join(stats.filter("n > 1").select("clusterId"), "clusterId", "left_anti").select(
        F.lit("single").alias("entryType"), F.col("id").alias("entryId"), F.col("publishedAt").alias("published"), F.col("createdAt").alias("created"),
        clamp(F.col("qualityScore")).alias("score"), F.lit(1).cast("long").alias("itemCount"), F.lit(1).cast("long").alias("sourceCount"), F.col("groupId").alias("entryGroup"))
    return many.unionByName(alone)


ORDERS = {"newest": ("created", "score", "itemCount", "entryId"), "score_desc": ("score", "published", "itemCount", "entryId")}


def page(df: DataFrame, order: str, number: int, size: int = 50) -> DataFrame:
    """One page in a total order; a page beyond the last is the last.

    The rows up to the page's end are found in one pass with a bounded heap; how many they are says which page is
    the last, so that nothing is counted beforehand.
    """
    keys = [F.desc(c) for c in ORDERS[order]]
    top = df.orderBy(*keys).limit(max(1, number) * size)
    top = top.withColumn("_k", F.row_number().over(Window.orderBy(*keys))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    asked = F.least(F.lit(max(1, number)), F.ceil(F.col("_n") / size))
    return top.filter(F.ceil(F.col("_k") / size) == asked).drop("_k", "_n")


@query(f"WITH {ENTRIES} SELECT * FROM entries ORDER BY created DESC, score DESC, itemCount DESC, entryId DESC LIMIT 50")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    return page(entries(visible(spark, d)), "newest", 1)


@query(f"WITH {ENTRIES} SELECT * FROM entries ORDER BY score DESC, published DESC, itemCount DESC, entryId DESC LIMIT 50 OFFSET 50")
def feed_page_by_score(spark: SparkSession, d: str) -> DataFrame:
    return page(entries(visible(spark, d)), "score_desc", 2)


@query(f"WITH {ENTRIES} SELECT * FROM entries")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(visible(spark, d))


@query(f"WITH {ENTRIES} SELECT entryGroup, count(*) AS entries, (SELECT count(*) FROM entries) AS total FROM entries WHERE entryGroup IS NOT NULL GROUP BY entryGroup")
def feed_facets(spark: SparkSession, d: str) -> DataFrame:
    """Entries per group beside the grand total, which a rollup gives in the same pass."""
    both = entries(visible(spark, d)).rollup("entryGroup").agg(F.count(F.lit(1)).alias("entries"), F.grouping("entryGroup").alias("g"))
    total = both.filter("g = 1").select(F.col("entries").alias("total"))
    return both.filter("g = 0 and entryGroup is not null").drop("g").crossJoin(F.broadcast(total))


@query("""SELECT g.id AS groupId, g.name, count(s.id) AS sources FROM source_groups g LEFT JOIN sources s ON s.groupId = g.id AND s.enabled GROUP BY g.id, g.name""")
def feed_filter_options(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter("enabled").select("groupId", F.col("id").alias("sid"))
    g = table(spark, d, "source_groups").select(F.col("id").alias("groupId"), "name")
    return g.join(s, "groupId", "left").groupBy("groupId", "name").agg(F.count("sid").alias("sources"))


SEARCHED = ("originalTitle", "translatedTitle", "author", "summaryText", "rssExcerpt", "ctitle", "csummary")


def contains(term: str, columns=SEARCHED) -> Column:
    """Whether a column holds the term, in any letter case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    return found


def search_terms(text: str) -> list[str]:
    """Words in lower case; Chinese and Japanese ones character by character."""
    out: list[str] = []
    for word in re.split(r"[^\w]+|_", unicodedata.normalize("NFKC", text).lower()):
        for part in re.findall(r"[぀-ヿ㐀-鿿]|[^぀-ヿ㐀-鿿]+", word):
            if part not in out:
                out.append(part)
    return out


def sql_contains(term: str, columns=SEARCHED) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), '{term}'), false)" for c in columns) + ")"


@query(f"WITH {VISIBLE} SELECT id, clusterId FROM vis WHERE {sql_contains('chip plant')}")
def feed_search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return visible(spark, d).filter(contains("chip plant")).select("id", "clusterId")


@query(rf"WITH {VISIBLE} SELECT id FROM vis WHERE originalTitle ILIKE '%50\%%' ESCAPE '\' OR author ILIKE '%a\_%' ESCAPE '\' OR ctitle ILIKE '%recall%' ESCAPE '\'")
def feed_search_like(spark: SparkSession, d: str) -> DataFrame:
    return visible(spark, d).filter(F.expr(r"originalTitle ilike '%50\\%%' or author ilike '%a\\_%' or ctitle ilike '%recall%'")).select("id")


@query(f"WITH {VISIBLE} SELECT id FROM vis WHERE {sql_contains('bank')} AND {sql_contains('court')} AND {sql_contains('2')}")
def feed_search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """Items that match every term, each in any column: terms are conditions of one scan, not a union to be divided."""
    found = F.lit(True)
    for term in search_terms("Bank court, 2"):
        found = found & contains(term)
    return visible(spark, d).filter(found).select("id")


def fuzzy_match(query_text: str, corpus: Column) -> Column:
    """Whether a corpus in lower case and NFKC matches every term, in any order: as it stands, without separators, or, with Chinese characters, as a subsequence."""
    separators = r"[\s\p{P}\p{S}_]+"
    compact = F.regexp_replace(corpus, separators, "")
    whole = unicodedata.normalize("NFKC", query_text).strip().lower()
    is_separator = lambda c: c.isspace() or unicodedata.category(c)[0] in "PS"
    terms = "".join(" " if is_separator(c) else c for c in whole).split() or ([whole] if whole else [])
    found = F.lit(True)
    for term in terms:
        tight = "".join(c for c in term if not is_separator(c))
        if not tight:
            continue
        one = corpus.contains(term) | compact.contains(tight)
        if len(tight) >= 2 and re.search(r"[㐀-鿿豈-\ufaff]", tight):
            one = one | compact.rlike("(?s)" + ".*".join(re.escape(c) for c in tight))
        found = found & one
    return found


def search_corpus(columns=SEARCHED) -> Column:
    """All searched columns in one text, in lower case and NFKC."""
    from loomline.functions.text import nfkc  # defining it needs a session

    texts = F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in columns])
    return F.lower(F.trim(nfkc(texts)))


@query()
def feed_search_fuzzy_all(spark: SparkSession, d: str) -> DataFrame:
    """Visible items that match each term of a query anywhere in the searched columns."""
    return visible(spark, d).withColumn("corpus", search_corpus()).filter(fuzzy_match("units recalls", F.col("corpus"))).select("id")


@query(f"""WITH {VISIBLE} SELECT clusterId, id, rank FROM (SELECT clusterId, id, row_number() OVER (PARTITION BY clusterId ORDER BY publishedAt DESC, createdAt DESC, id) AS rank
    FROM vis WHERE clusterId IS NOT NULL) WHERE rank <= 3""")
def feed_previews(spark: SparkSession, d: str) -> DataFrame:
    """The three newest items of each cluster. Spark keeps a heap of three per group before it shuffles."""
    w = Window.partitionBy("clusterId").orderBy(F.desc("publishedAt"), F.desc("createdAt"), "id")
    return visible(spark, d).filter("clusterId is not null").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("clusterId", "id", "rank")


@query(f"""WITH {ENTRIES}, k AS (SELECT entryType || ':' || entryId AS key, row_number() OVER (ORDER BY entryId DESC) AS place FROM entries WHERE score >= 60 ORDER BY entryId DESC LIMIT 20)
    SELECT e.entryType, e.entryId, k.place FROM entries e JOIN k ON k.key = e.entryType || ':' || e.entryId""")
def feed_explicit_keys(spark: SparkSession, d: str) -> DataFrame:
    """Entries picked by key, in the order of the keys; here the keys are those of twenty entries."""
    e = entries(visible(spark, d))
    keys = [f"{r.entryType}:{r.entryId}" for r in e.filter("score >= 60").orderBy(F.desc("entryId")).limit(20).collect()]
    place = F.array_position(F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>"), F.concat_ws(":", "entryType", "entryId"))
    return e.withColumn("place", place).filter("place > 0").select("entryType", "entryId", "place")


@query(f"""WITH {STATS}{DOMINANT}, names AS (SELECT clusterId, lower(trim(n)) AS k, min(trim(n)) AS n FROM (SELECT clusterId, eventSubject AS n FROM vis UNION ALL SELECT clusterId, eventObject FROM vis)
      WHERE clusterId IS NOT NULL AND trim(n) <> '' GROUP BY 1, 2), ent AS (SELECT clusterId, count(*) AS entities, string_agg(n, '|' ORDER BY k) AS entityNames FROM names GROUP BY 1)
    SELECT c.id, coalesce(n, 0) AS itemCount, coalesce(sources, 0) AS sourceCount, coalesce(stats.score, 0) AS score, first, created AS last, dom.groupId, coalesce(entities, 0) AS entities, entityNames
    FROM content_clusters c LEFT JOIN stats ON stats.clusterId = c.id LEFT JOIN dom ON dom.clusterId = c.id LEFT JOIN ent ON ent.clusterId = c.id
    LEFT JOIN (SELECT clusterId, min(createdAt) AS first FROM vis GROUP BY 1) f ON f.clusterId = c.id""")
def cluster_display_stats(spark: SparkSession, d: str) -> DataFrame:
    """Display aggregates of every cluster, zero where nothing is visible."""
    vis = visible(spark, d)
    names = vis.filter("clusterId is not null").select("clusterId", F.explode(F.array("eventSubject", "eventObject")).alias("n")).withColumn("n", F.trim("n")).filter("n <> ''")
    names = names.groupBy("clusterId", F.lower("n").alias("k")).agg(F.min("n").alias("n"))
    names = names.groupBy("clusterId").agg(F.count(F.lit(1)).alias("entities"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]), "|").alias("entityNames"))
    first = vis.groupBy("clusterId").agg(F.min("createdAt").alias("first"))
    out = table(spark, d, "content_clusters").select(F.col("id").alias("clusterId"))
    for part in (cluster_stats(vis), dominant_groups(vis), names, first):
        out = out.join(part, "clusterId", "left")
    zero = lambda c, a: F.coalesce(c, F.lit(0)).alias(a)
    return out.select(F.col("clusterId").alias("id"), zero("n", "itemCount"), zero("sources", "sourceCount"), zero("score", "score"), "first", F.col("created").alias("last"), "groupId", zero("entities", "entities"), "entityNames")


@query(f"WITH {ITEMS} SELECT clusterId, max(updatedAt) AS updatedAt FROM it WHERE clusterId IS NOT NULL GROUP BY clusterId")
def cluster_latest_update(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows don't change a maximum."""
    return table(spark, d, "items").filter("clusterId is not null").groupBy("clusterId").agg(F.max("updatedAt").alias("updatedAt"))


@query(f"WITH {ITEMS} SELECT c.id, c.itemCount AS stored, count(it.id) AS actual FROM content_clusters c LEFT JOIN it ON it.clusterId = c.id GROUP BY c.id, c.itemCount HAVING count(it.id) <> c.itemCount")
def cluster_stale_counts(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose stored count is stale: one aggregation and a join in place of a correlated count."""
    n = items_once(spark, d, "clusterId is not null").groupBy(F.col("clusterId").alias("id")).agg(F.count(F.lit(1)).alias("actual"))
    c = table(spark, d, "content_clusters").select("id", F.col("itemCount").alias("stored")).join(n, "id", "left").fillna(0, ["actual"])
    return c.filter("actual <> stored")


@query(f"""WITH {VISIBLE} SELECT c.id, c.title, count(v.id) AS items, greatest(c.latestPublishedAt, coalesce(max(v.publishedAt), c.latestPublishedAt)) AS latest FROM content_clusters c LEFT JOIN vis v ON v.clusterId = c.id
    GROUP BY c.id, c.title, c.latestPublishedAt HAVING greatest(c.latestPublishedAt, coalesce(max(v.publishedAt), c.latestPublishedAt)) >= TIMESTAMP '2026-06-25'""")
def admin_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = visible(spark, d).groupBy(F.col("clusterId").alias("id")).agg(F.count(F.lit(1)).alias("items"), F.max("publishedAt").alias("p"))
    c = table(spark, d, "content_clusters").select("id", "title", "latestPublishedAt").join(v, "id", "left")
    return c.select("id", "title", F.coalesce("items", F.lit(0)).alias("items"), F.greatest("latestPublishedAt", F.coalesce("p", "latestPublishedAt")).alias("latest")).filter("latest >= timestamp_ntz'2026-06-25'")


@query(f"WITH {VISIBLE} SELECT id FROM content_clusters c WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM vis WHERE vis.clusterId = c.id)")
def hidden_clusters(spark: SparkSession, d: str) -> DataFrame:
    seen = visible(spark, d).select(F.col("clusterId").alias("id"))
    return table(spark, d, "content_clusters").filter("status = 'active'").join(seen, "id", "left_anti").select("id")


TITLE_SQL = "coalesce(nullif(trim(translatedTitle), ''), originalTitle)"


@query(rf"""WITH {ITEMS} SELECT id, {TITLE_SQL} AS title, CASE WHEN length(x) <= 800 THEN nullif(x, '') END AS summary FROM (SELECT *, trim(regexp_replace(regexp_replace(
    coalesce(nullif(trim(summaryText), ''), rssExcerpt, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM it)""")
def display_text(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(blank("summaryText"), "rssExcerpt", F.lit("")), "<[^>]+>", " "), r"\s+", " ")
    out = items_once(spark, d).withColumn("x", F.trim(plain))
    return out.select("id", F.coalesce(blank("translatedTitle"), "originalTitle").alias("title"), F.when(F.length("x") <= 800, F.nullif("x", F.lit(""))).alias("summary"))


@query(rf"WITH {ITEMS} SELECT id FROM it WHERE length(regexp_replace(originalTitle, '[^A-Za-z]', '', 'g')) >= 6 AND NOT regexp_matches(originalTitle, '[\x{{3400}}-\x{{9FFF}}]')")
def should_translate(spark: SparkSession, d: str) -> DataFrame:
    return items_once(spark, d).filter((F.regexp_count("originalTitle", F.lit("[A-Za-z]")) >= 6) & ~F.col("originalTitle").rlike(r"[㐀-鿿]")).select("id")


@query(f"""WITH RECURSIVE {ITEMS}, tree AS (SELECT id AS root, id, 0 AS depth FROM it WHERE isAggregation UNION ALL SELECT t.root, it.id, t.depth + 1 FROM tree t JOIN it ON it.parentItemId = t.id WHERE t.depth < 5)
    SELECT root, id, depth FROM tree WHERE depth > 0""")
def child_closure(spark: SparkSession, d: str) -> DataFrame:
    """Items below each roundup at any depth: one join a level, each on the links alone, until a level is empty."""
    items = items_once(spark, d)
    return closure(items.filter("isAggregation").select("id"), items.select(F.col("id").alias("child"), F.col("parentItemId").alias("id")))


def closure(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(root, id, depth) of roots (id) and links (child, id): every item below a root, at its least depth; cycles end, as what was seen is not met again."""
    links = materialize(links.filter("id is not null and child is not null").distinct(), "links")
    level = materialize(roots.filter("id is not null").distinct().select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")), "level")
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        below = level.select("root", "id").join(links, "id").select("root", F.col("child").alias("id")).distinct()
        level = materialize(below.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        seen = seen.unionByName(level)
    return seen.filter("depth > 0")


def rss(entries_page: DataFrame) -> DataFrame:
    """RSS items of a page, in XML."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return entries_page.select("id", F.concat(F.lit("<item><guid>"), "id", F.lit("</guid><title>"), esc(F.col("title")), F.lit("</title><link>"), esc(F.col("url")), F.lit("</link></item>")).alias("xml"))


@query(f"""WITH {VISIBLE}, t AS (SELECT id, {TITLE_SQL} AS title, originalUrl AS url FROM vis ORDER BY createdAt DESC, id DESC LIMIT 100)
    SELECT id, '<item><guid>' || id || '</guid><title>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><link>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</link></item>' AS xml FROM t""")
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    top = visible(spark, d).orderBy(F.desc("createdAt"), F.desc("id")).limit(100)
    return rss(top.select("id", F.coalesce(F.nullif(F.trim("translatedTitle"), F.lit("")), "originalTitle").alias("title"), F.col("originalUrl").alias("url")))

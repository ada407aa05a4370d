"""Further lists and look-ups: attention, reuse, fused partners, feedback, moderation, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.clusters import fused_ranks
from loomline.operators.feed import items_once
from loomline.operators.pairs import SCORED, scored
from loomline.registry import ITEMS, query
from loomline.runtime import pairs_within, table


@query(f"WITH {ITEMS}, n AS (SELECT sid, count(*) AS items, max(createdAt) AS latest FROM it WHERE createdAt < TIMESTAMP '2026-06-28' GROUP BY 1) SELECT s.id, coalesce(items, 0) AS items, latest FROM sources s LEFT JOIN n ON n.sid = s.id WHERE s.enabled ORDER BY latest ASC NULLS FIRST, s.id LIMIT 60")
def source_attention(spark: SparkSession, d: str) -> DataFrame:
    """Enabled sources, those that never gave anything first, then the longest silent."""
    n = items_once(spark, d, "createdAt < timestamp_ntz'2026-06-28'").groupBy(F.col("sid").alias("id")).agg(F.count(F.lit(1)).alias("items"), F.max("createdAt").alias("latest"))
    s = table(spark, d, "sources").filter("enabled").select("id").join(n, "id", "left")
    return s.select("id", F.coalesce("items", F.lit(0)).alias("items"), "latest").orderBy(F.asc_nulls_first("latest"), "id").limit(60)


@query("SELECT n.id, o.id AS reuses FROM (SELECT DISTINCT id, urlHash FROM items WHERE createdAt >= TIMESTAMP '2026-06-27') n JOIN (SELECT urlHash, min(id) AS id FROM items WHERE createdAt < TIMESTAMP '2026-06-27' AND status = 'processed' GROUP BY 1) o USING (urlHash)")
def reusable_items(spark: SparkSession, d: str) -> DataFrame:
    """New items whose URL was already worked through, and the item that is used again."""
    i = table(spark, d, "items")
    old = i.filter("createdAt < timestamp_ntz'2026-06-27' and status = 'processed'").groupBy("urlHash").agg(F.min("id").alias("reuses"))
    return i.filter("createdAt >= timestamp_ntz'2026-06-27'").select("id", "urlHash").distinct().join(old, "urlHash").select("id", "reuses")


@query(f"""WITH {SCORED}, u AS (SELECT leftClusterId AS a, rightClusterId AS b, bm25Score, vectorSimilarity FROM pair_cache UNION ALL SELECT rightClusterId, leftClusterId, bm25Score, vectorSimilarity FROM pair_cache), p AS (SELECT a, b, max(bm25Score) AS bm, max(vectorSimilarity) AS vs FROM u WHERE a <> b GROUP BY 1, 2),
    r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY bm DESC, b) AS x, CASE WHEN vs IS NOT NULL THEN row_number() OVER (PARTITION BY a ORDER BY vs DESC NULLS LAST, b) END AS y FROM p), f AS (SELECT a, b, round(1.0 / (60 + x) + coalesce(1.0 / (60 + y), 0), 8) AS rrf FROM r),
    ok AS (SELECT a, b FROM s4 WHERE safety IS NULL), k AS (SELECT f.*, row_number() OVER (PARTITION BY f.a ORDER BY rrf DESC, f.b) AS k FROM f JOIN ok ON ok.a = least(f.a, f.b) AND ok.b = greatest(f.a, f.b)) SELECT a, b, k FROM k WHERE k <= 10""")
def fused_partners(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's ten best partners by fused ranks of words and vectors, unsafe pairs left out; where vectors are missing words decide."""
    ok = scored(spark, d).filter("safety is null").select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    f = fused_ranks(spark, d).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(ok, ["lo", "hi"], "left_semi")
    return f.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("rrf"), "b"))).filter("k <= 10").select("a", "b", "k")


@query("""SELECT d.id, l.title AS leftTitle, l.summary AS leftSummary, r.title AS rightTitle, r.summary AS rightSummary FROM (SELECT DISTINCT id, leftClusterId, rightClusterId, createdAt FROM cluster_decisions WHERE relation = 'uncertain' AND appliedAt IS NULL) d
    JOIN content_clusters l ON l.id = leftClusterId JOIN content_clusters r ON r.id = rightClusterId ORDER BY d.createdAt DESC, d.id LIMIT 500""")
def open_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The newest open questions with the texts of both sides as they are now, as a label is kept with them."""
    t = table(spark, d, "cluster_decisions").filter("relation = 'uncertain' and appliedAt is null").select("id", "leftClusterId", "rightClusterId", "createdAt").distinct()
    c = table(spark, d, "content_clusters").select("id", "title", "summary")
    for s in ("left", "right"):
        t = t.join(c.select(F.col("id").alias(f"{s}ClusterId"), F.col("title").alias(f"{s}Title"), F.col("summary").alias(f"{s}Summary")), f"{s}ClusterId")
    return t.orderBy(F.desc("createdAt"), "id").limit(500).select("id", "leftTitle", "leftSummary", "rightTitle", "rightSummary")


def moderate(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items after an editor's changes (id, action): filter, restore or delete. A restored item keeps that mark, a deleted one goes, and one
    that is filtered or deleted leaves its cluster. Unknown ids and actions change nothing; of several actions on an item the last by name counts."""
    last = changes.filter("action in ('filter', 'restore', 'delete')").groupBy("id").agg(F.max("action").alias("_do"))
    out = items.join(last, "id", "left").filter("_do is null or _do <> 'delete'")
    out = out.withColumn("moderationStatus", F.when(F.col("_do") == "filter", "filtered").when(F.col("_do") == "restore", "restored").otherwise(F.col("moderationStatus")))
    return out.withColumn("clusterId", F.when(F.coalesce(F.col("_do") != "filter", F.lit(True)), F.col("clusterId"))).select(items.columns)


@query(f"""WITH {ITEMS}, m AS (SELECT id, CASE WHEN moderationStatus = 'filtered' AND qualityScore >= 60 THEN 'restore' WHEN qualityScore < 10 THEN 'filter' WHEN originalTitle = '' THEN 'delete' END AS act FROM it)
    SELECT id, CASE act WHEN 'restore' THEN 'restored' WHEN 'filter' THEN 'filtered' ELSE moderationStatus END AS moderationStatus, CASE WHEN act = 'filter' THEN NULL ELSE clusterId END AS clusterId FROM it JOIN m USING (id) WHERE act IS NULL OR act <> 'delete'""")
def moderated_items(spark: SparkSession, d: str) -> DataFrame:
    it = items_once(spark, d)
    act = F.when((F.col("moderationStatus") == "filtered") & (F.col("qualityScore") >= 60), "restore").when(F.col("qualityScore") < 10, "filter").when(F.col("originalTitle") == "", "delete")
    return moderate(it, it.select("id", act.alias("action"))).select("id", "moderationStatus", "clusterId")


@query(f"WITH {ITEMS}, g AS (SELECT DISTINCT id, substring(t, i, 3) AS gram FROM (SELECT id, lower(originalTitle) AS t, unnest(range(1, length(originalTitle) - 1)) AS i FROM it WHERE length(originalTitle) >= 3)) SELECT gram, count(*) AS items FROM g GROUP BY 1")
def title_index(spark: SparkSession, d: str) -> DataFrame:
    """A trigram index of titles: how many items hold each. Postings are different per item before they are counted, map-side."""
    it = items_once(spark, d, "length(originalTitle) >= 3").select("id", F.lower("originalTitle").alias("t"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))
    return it.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("items"))


@query("""WITH w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[a-z0-9]{2,}')) AS t FROM entities), n AS (SELECT t FROM w GROUP BY t HAVING count(*) BETWEEN 2 AND 80), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM w x JOIN w y ON x.t = y.t AND x.id < y.id WHERE x.t IN (SELECT t FROM n))
    SELECT a, b FROM p ORDER BY a, b LIMIT 20000""")
def bounded_entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs to compare within words that at most eighty entities hold, twenty thousand at most: a budget, not the whole join, which `entity_suggestions` is."""
    w = table(spark, d, "entities").select("id", F.explode(F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9]{2,})"), 1)).alias("t")).distinct()
    n = w.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n between 2 and 80").select("t")
    return pairs_within(w.join(n, "t", "left_semi"), "t", "id").select("a", "b").distinct().orderBy("a", "b").limit(20_000)


@query(f"WITH {ITEMS} SELECT id, CASE WHEN trim(coalesce(originalTitle, '')) = '' THEN 'no title' WHEN trim(coalesce(summaryText, '')) = '' THEN 'no summary' WHEN qualityScore IS NULL THEN 'no score' WHEN qualityScore NOT BETWEEN 0 AND 100 THEN 'bad score' END AS dropped FROM it")
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    """Why a parsed event is dropped; null if it is kept."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(blank("originalTitle"), "no title").when(blank("summaryText"), "no summary").when(F.col("qualityScore").isNull(), "no score").when(~F.col("qualityScore").between(0, 100), "bad score")
    return items_once(spark, d).select("id", why.alias("dropped"))


@query("""WITH k AS (SELECT id, sha256('mini' || chr(10) || '64' || chr(10) || concat_ws(' ', title, summary)) AS k FROM content_clusters) SELECT k AS hash, min(id) AS id, count(*) AS users FROM k GROUP BY 1""")
def embedding_keys(spark: SparkSession, d: str) -> DataFrame:
    """What embeddings are kept under, once per different text: equal texts of one model and size share a vector."""
    k = F.sha2(F.concat_ws("\n", F.lit("mini"), F.lit("64"), F.concat_ws(" ", "title", "summary")), 256)
    return table(spark, d, "content_clusters").groupBy(k.alias("hash")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("users"))


def embedded(texts: DataFrame, cache: DataFrame, embed, size: int = 64) -> DataFrame:
    """(id, vector) of (id, hash, text): vectors of the cache (hash, vector), and for the rest those that `embed`, a function of a list of
    texts, gives, once per different text. A batch that fails is tried text by text; a text that fails alone has a null vector."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, size) for k in range(0, batch.num_rows, size)):
                ts = part.column(1).to_pylist()
                try:
                    got = embed(ts)
                except Exception:
                    got = []
                    for t in ts:
                        try:
                            got += embed([t])
                        except Exception:
                            got.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float32()))], names=["hash", "vector"])

    missing = texts.join(cache, "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))
    known = cache.select("hash", "vector").unionByName(missing.mapInArrow(run, "hash string, vector array<float>"))
    return texts.select("id", "hash").join(known, "hash", "left").select("id", "vector")

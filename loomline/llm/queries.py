"""The pN_ queries and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import capping, components, garble, language, lookalike, names, near_dup, packing, tokenize
from loomline.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.cap_contributors(table(spark, d, "items")).filter("not kept").select(F.col("id").alias("itemId"))


def p1_reservoir(spark: SparkSession, d: str) -> DataFrame:
    """The sampling form: weights exp(score / 10), the same caps."""
    return capping.cap_contributors(table(spark, d, "items"), temperature=10.0).filter("kept").select(F.col("id").alias("itemId"), "day", "contributor")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_ids(components.decision_links(table(spark, d, "cluster_decisions"), table(spark, d, "pair_cache")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items").select(F.lit("items").alias("tableName"), "id", F.col("originalTitle").alias("text"))
    clusters = table(spark, d, "content_clusters")
    return items.unionByName(clusters.select(F.lit("content_clusters").alias("tableName"), "id", F.concat("title", F.lit(" "), "summary").alias("text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(_texts(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(_texts(spark, d))


def _names(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "items")
    of = lambda df, field, c: df.select(F.lit(field).alias("field"), F.col("id").alias("rowId"), F.col(c).alias("value"))
    named = of(table(spark, d, "entities"), "entities.name", "name")
    return named.unionByName(of(items, "items.eventSubject", "eventSubject")).unionByName(of(items, "items.eventObject", "eventObject"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_odd(_names(spark, d)).select("field", "rowId").distinct()


def p4_plain(spark: SparkSession, d: str) -> DataFrame:
    """The plain form of each odd value."""
    return lookalike.find_odd(_names(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    judged = language.judge_items(table(spark, d, "items"), table(spark, d, "lang_samples"))
    return language.wrong_languages(judged).select("itemId", "field", "lang")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every title with its language and confidence."""
    judged = language.judge_items(table(spark, d, "items"), table(spark, d, "lang_samples"))
    return judged.select("itemId", "field", F.explode("parts").alias("p")).select("itemId", "field", "p.*")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "entities"), table(spark, d, "aliases"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each row that has another spelling: membership in place of all pairs."""
    return names.variant_groups(table(spark, d, "entities"), table(spark, d, "aliases"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_column(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenize.encode_column(table(spark, d, "documents"), count_only=True))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reservoir, p2_found, p3_found, p3_groups, p4_found, p4_plain, p5_found, p5_segments, p6_found, p6_groups, p7_ids, p8_containers, p9_found, p9_restored)}

SQL = {
    "p1_found": r"""
        WITH i AS (SELECT id, min(createdAt) AS made, min(regexp_replace(lower(sourceId), '^\s+|\s+$', '', 'g')) AS who, min(qualityScore) AS q FROM items GROUP BY id),
        n AS (SELECT CAST(made AS DATE) AS day, count(*) // 25 AS cap FROM i GROUP BY 1),
        r AS (SELECT id, day, cap, row_number() OVER (PARTITION BY day, who ORDER BY CASE WHEN q BETWEEN 0 AND 100 THEN q ELSE -1 END DESC, made, id) AS k
              FROM i JOIN n ON CAST(made AS DATE) = day)
        SELECT id AS "itemId" FROM r WHERE k > cap""",
    "p2_found": r"""
        WITH RECURSIVE j AS (SELECT string_split(regexp_replace(lower(pairKey), '\s+', '', 'g'), '|') AS p FROM cluster_decisions
                   WHERE kind = 'cluster_pair' AND relation = 'same_event'),
        e AS (SELECT p[1] AS a, p[2] AS b FROM j WHERE len(p) = 2 UNION ALL SELECT leftClusterId, rightClusterId FROM pair_cache WHERE vectorSimilarity >= 0.9),
        l AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b)),
        reach AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.seen)
        SELECT id AS "clusterId", min(seen) AS "groupId" FROM reach GROUP BY id""",
}

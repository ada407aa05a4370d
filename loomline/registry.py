"""Where query functions and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Common table expressions that the SQL of several queries starts from.
ITEMS = """it AS (SELECT id, lower(trim(sourceId)) AS sid, clusterId, canonicalUrl, originalUrl, originalTitle, translatedTitle, author, publishedAt,
    publishedAtKnown, summaryText, rssExcerpt, status, moderationStatus, qualityScore, isAggregation, parentItemId, eventType, eventSubject, eventAction,
    eventObject, eventDate, createdAt, updatedAt FROM items QUALIFY row_number() OVER (PARTITION BY id ORDER BY updatedAt DESC) = 1)"""
VISIBLE = (
    ITEMS
    + """, vis AS (SELECT it.*, s.groupId, c.title AS ctitle, c.summary AS csummary FROM it JOIN sources s ON s.id = it.sid
    LEFT JOIN content_clusters c ON c.id = it.clusterId WHERE it.status = 'processed' AND moderationStatus IN ('allowed', 'restored') AND NOT isAggregation
    AND s.enabled AND (it.clusterId IS NULL OR c.status = 'active'))"""
)
STATS = (
    VISIBLE
    + """, stats AS (SELECT clusterId, count(*) AS n, count(DISTINCT sid) AS sources, CAST(least(100, greatest(0, coalesce(floor(avg(qualityScore) + 0.5), 0))) AS INT) AS score,
    max(publishedAt) AS published, max(createdAt) AS created FROM vis WHERE clusterId IS NOT NULL GROUP BY clusterId)"""
)
DOMINANT = """, dom AS (SELECT clusterId, groupId FROM (SELECT clusterId, groupId, row_number() OVER (PARTITION BY clusterId ORDER BY count(*) DESC, min(createdAt), groupId) AS r
    FROM vis WHERE clusterId IS NOT NULL AND groupId IS NOT NULL GROUP BY clusterId, groupId) WHERE r = 1)"""
ENTRIES = (
    STATS
    + DOMINANT
    + """, entries AS (SELECT 'cluster' AS entryType, s.clusterId AS entryId, s.published, s.created, s.score, s.n AS itemCount, s.sources AS sourceCount, dom.groupId AS entryGroup
      FROM stats s LEFT JOIN dom USING (clusterId) WHERE s.n > 1
    UNION ALL SELECT 'single', v.id, v.publishedAt, v.createdAt, CAST(least(100, greatest(0, coalesce(v.qualityScore, 0))) AS INT), 1, 1, v.groupId
      FROM vis v LEFT JOIN stats s USING (clusterId) WHERE v.clusterId IS NULL OR s.n <= 1)"""
)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add

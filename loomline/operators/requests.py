"""Requests to the feed: parameters are resolved in Python, filters are composed into one plan."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.feed import contains, entries, page, search_terms, sql_contains, visible
from loomline.registry import DOMINANT, ENTRIES, STATS, VISIBLE, query

ZONE = 8 * 60  # minutes east of UTC of the feed's days
PAGE, MOST = 50, 200
RANGES = ("today", "3d", "7d", "1m", "1y", "all")
ADVANCED = ("groupId", "sourceId", "title", "publishedStart", "publishedEnd", "entryId", "entryType", "entryKeys")


@dataclass(frozen=True)
class Request:
    """A resolved request: what is null doesn't restrict."""

    start: datetime | None = None
    end: datetime | None = None
    published_start: datetime | None = None
    published_end: datetime | None = None
    source: str | None = None
    group: str | None = None
    title: str | None = None
    entry_id: str | None = None
    entry_type: str | None = None
    entry_keys: tuple[str, ...] = field(default=())
    order: str = "newest"
    number: int = 1
    size: int = PAGE


def date_input(text: str | None) -> str | None:
    """A date as YYYY-MM-DD if it is one of the calendar, else null."""
    if not text or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        return None
    return text


def shifted(at: datetime, months: int) -> datetime:
    """So many months on; a day that the month lacks runs over into the next."""
    year, month = divmod(at.year * 12 + at.month - 1 + months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return at.replace(year=year, month=month + 1, day=min(at.day, last)) + timedelta(days=max(0, at.day - last))


def range_start(name: str, now: datetime, zone: int = ZONE) -> datetime | None:
    """Where a relative range begins, in UTC: today at local midnight, days as spans of 24 hours, months and years by the local calendar."""
    local = now + timedelta(minutes=zone)
    if name == "today":
        return local.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(minutes=zone)
    if name in ("3d", "7d"):
        return now - timedelta(days=int(name[0]))
    if name in ("1m", "1y"):
        return shifted(local, -1 if name == "1m" else -12) - timedelta(minutes=zone)
    return None


def boundary(day: str | None, end: bool, zone: int = ZONE) -> datetime | None:
    """The first or last millisecond of a local day, in UTC."""
    if day is None:
        return None
    at = datetime.strptime(day, "%Y-%m-%d") - timedelta(minutes=zone)
    return at + timedelta(days=1) - timedelta(milliseconds=1) if end else at


def whole(text: str | None) -> int:
    m = re.match(r"\s*[+-]?\d+", text or "")
    return int(m[0]) if m else 0


def resolve(params: dict[str, str | list[str]], now: datetime, zone: int = ZONE) -> Request:
    """A request from its parameters: reversed dates are swapped, pages start at 1 and hold 200 entries at most, and the range is
    today unless something but the time of creation restricts the feed; then it is all."""
    get = lambda k: (params.get(k)[0] if isinstance(params.get(k), list) and params.get(k) else params.get(k)) or None
    text = lambda k: (get(k) or "").strip() or None
    dates = []
    for a, b in (("start", "end"), ("publishedStart", "publishedEnd")):
        x, y = date_input(get(a)), date_input(get(b))
        dates += [y, x] if x and y and x > y else [x, y]
    restricted = any(text(k) if not isinstance(params.get(k), list) else any(v.strip() for v in params[k]) for k in ADVANCED)
    timed = any(text(k) for k in ("range", "start", "end"))
    name = get("range") if get("range") in RANGES else "all" if restricted and not timed else "today"
    keys = params.get("entryKeys") or []
    number, size = whole(get("page")), whole(get("size"))
    return Request(
        start=boundary(dates[0], False, zone) if dates[0] or dates[1] else range_start(name, now, zone), end=boundary(dates[1], True, zone),
        published_start=boundary(dates[2], False, zone), published_end=boundary(dates[3], True, zone), source=text("sourceId"), group=text("groupId"), title=text("title"),
        entry_id=text("entryId"), entry_type=get("entryType") if get("entryType") in ("single", "cluster") else None, entry_keys=tuple(keys if isinstance(keys, list) else [keys]),
        order="score_desc" if get("sort") == "score_desc" else "newest", number=number if number > 0 else 1, size=min(size, MOST) if size > 0 else PAGE)


def like(term: str) -> str:
    """A pattern that finds the term itself, whatever signs it holds."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"


def item_filter(r: Request) -> Column:
    """The conditions on items of a request."""
    out = F.lit(True)
    for column, low, high in (("createdAt", r.start, r.end), ("publishedAt", r.published_start, r.published_end)):
        if low:
            out = out & (F.col(column) >= F.lit(low.isoformat()).cast("timestamp_ntz"))
        if high:
            out = out & (F.col(column) <= F.lit(high.isoformat()).cast("timestamp_ntz"))
    if r.source:
        out = out & (F.col("sid") == r.source)
    for term in search_terms(r.title) if r.title else ():
        out = out & contains(term)
    return out


def feed(vis: DataFrame, r: Request) -> DataFrame:
    """Entries of a request over visible items: the items that it finds decide which entries show and how many items they count;
    a cluster's score and group are those of all its visible items."""
    found = vis.filter(item_filter(r))
    out = entries(found)
    whole = entries(vis).filter("entryType = 'cluster'").select("entryId", F.col("score").alias("_s"), F.col("entryGroup").alias("_g"))
    out = out.join(whole, "entryId", "left").withColumn("score", F.when(F.col("entryType") == "cluster", F.coalesce("_s", "score")).otherwise(F.col("score")))
    out = out.withColumn("entryGroup", F.when(F.col("entryType") == "cluster", F.coalesce("_g", "entryGroup")).otherwise(F.col("entryGroup"))).drop("_s", "_g")
    for column, value in (("entryGroup", r.group), ("entryId", r.entry_id), ("entryType", r.entry_type)):
        if value:
            out = out.filter(F.col(column) == value)
    if r.entry_keys:
        out = out.filter(F.concat_ws(":", "entryType", "entryId").isin(list(r.entry_keys)))
    return out


def feed_page_of(vis: DataFrame, r: Request) -> DataFrame:
    """A request's page, each entry with hasMore and, if there is more, the number of the next page."""
    out = feed(vis, r)
    ahead = page(out, r.order, r.number, r.size)
    more = out.orderBy(*[F.desc(c) for c in ("created", "entryId")]).limit(r.number * r.size + 1).agg((F.count(F.lit(1)) > r.number * r.size).alias("hasMore"))  # one row
    return ahead.crossJoin(F.broadcast(more)).withColumn("nextPage", F.when(F.col("hasMore"), F.lit(r.number + 1)))


NOW = datetime(2026, 6, 30, 3, 30)
_FOUND = """, found AS (SELECT * FROM vis WHERE {}), fs AS (SELECT clusterId, count(*) AS n, count(DISTINCT sid) AS sources, max(publishedAt) AS published, max(createdAt) AS created FROM found WHERE clusterId IS NOT NULL GROUP BY 1),
    fe AS (SELECT 'cluster' AS entryType, fs.clusterId AS entryId, fs.published, fs.created, s.score, fs.n AS itemCount, fs.sources AS sourceCount, dom.groupId AS entryGroup FROM fs JOIN stats s USING (clusterId) LEFT JOIN dom USING (clusterId) WHERE fs.n > 1
      UNION ALL SELECT 'single', v.id, v.publishedAt, v.createdAt, CAST(least(100, greatest(0, coalesce(v.qualityScore, 0))) AS INT), 1, 1, v.groupId FROM found v LEFT JOIN fs USING (clusterId) WHERE v.clusterId IS NULL OR fs.n <= 1)"""


def _sql(where: str, after: str) -> str:
    return f"WITH {STATS}{DOMINANT}{_FOUND.format(where)} SELECT * FROM fe {after}"


@query(_sql("createdAt >= TIMESTAMP '2026-06-27 03:30:00'", "ORDER BY created DESC, score DESC, itemCount DESC, entryId DESC LIMIT 20 OFFSET 20"))
def feed_last_days(spark: SparkSession, d: str) -> DataFrame:
    return page(feed(visible(spark, d), r := resolve({"range": "3d", "page": "2", "size": "20"}, NOW)), r.order, r.number, r.size)


@query(_sql("createdAt >= TIMESTAMP '2026-06-24 16:00:00' AND createdAt <= TIMESTAMP '2026-06-27 15:59:59.999' AND publishedAt >= TIMESTAMP '2026-06-19 16:00:00'", ""))
def feed_between(spark: SparkSession, d: str) -> DataFrame:
    """Days are local; reversed ones are swapped."""
    return feed(visible(spark, d), resolve({"start": "2026-06-27", "end": "2026-06-25", "publishedStart": "2026-06-20"}, NOW))


@query(_sql("sid = (SELECT min(sid) FROM vis)", ""))
def feed_of_source(spark: SparkSession, d: str) -> DataFrame:
    vis = visible(spark, d)
    return feed(vis, resolve({"sourceId": vis.agg(F.min("sid")).collect()[0][0] or "none"}, NOW))


@query(_sql("true", "WHERE entryGroup = (SELECT min(id) FROM source_groups) AND entryType = 'cluster'"))
def feed_of_group(spark: SparkSession, d: str) -> DataFrame:
    group = spark.read.parquet(f"{d}/source_groups.parquet").agg(F.min("id")).collect()[0][0]
    return feed(visible(spark, d), resolve({"groupId": group or "none", "entryType": "cluster"}, NOW))


@query(_sql(" AND ".join(sql_contains(t) for t in search_terms("Plant chip")), ""))
def feed_search_terms(spark: SparkSession, d: str) -> DataFrame:
    """A given search: every term in any of the searched columns, over the whole time."""
    return feed(visible(spark, d), resolve({"title": " Plant chip "}, NOW))


TERM = "50%_a\\"


@query(f"""WITH {VISIBLE} SELECT id FROM vis WHERE contains(lower(originalTitle), lower('{TERM}')) OR contains(lower(coalesce(translatedTitle, '')), lower('{TERM}')) OR contains(lower(originalTitle), 'strike') AND contains(originalTitle, '-')""")
def feed_search_escaped(spark: SparkSession, d: str) -> DataFrame:
    """A given term as a pattern in which its own signs are plain."""
    found = F.col("originalTitle").ilike(like(TERM)) | F.coalesce(F.col("translatedTitle").ilike(like(TERM)), F.lit(False)) | (F.col("originalTitle").ilike(like("strike")) & F.col("originalTitle").like(like("-")))
    return visible(spark, d).filter(found).select("id")


@query(f"WITH {ENTRIES}, n AS (SELECT count(*) AS n FROM entries) SELECT entryId, n > 30 AS hasMore, CASE WHEN n > 30 THEN 3 END AS nextPage FROM entries, n ORDER BY created DESC, score DESC, itemCount DESC, entryId DESC LIMIT 15 OFFSET 15")
def feed_cursor(spark: SparkSession, d: str) -> DataFrame:
    return feed_page_of(visible(spark, d), Request(number=2, size=15)).select("entryId", "hasMore", "nextPage")

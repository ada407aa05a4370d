"""Readers of feed files: RSS and Atom documents, and OPML outlines."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "path string, guid string, title string, link string, published string, content string, error string"
FIELDS = ("path", "guid", "title", "link", "published", "content", "error")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def child(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for c in node:
            if local(c.tag) == name:
                return c.get("href") or "".join(c.itertext()).strip() or None
    return None


def utc(text: str | None) -> str | None:
    """RFC 822 or ISO time as ISO; null if it can't be read."""
    if not text:
        return None
    try:
        return parsedate_to_datetime(text).isoformat()
    except ValueError:
        return text if text[:4].isdigit() and "T" in text else None


def parse_feed(path: str, text: str) -> list[tuple]:
    """One row an entry; a document that is HTML or no XML gives one row with an error."""
    if "<html" in text[:1000].lower():
        return [(path, None, None, None, None, None, "html")]
    wrong = ""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        wrong = f"xml: {e}"
        try:  # once more, with quotes put around bare attribute values
            root = ET.fromstring(re.sub(r"""(<[^<>]*?\s[\w:-]+=)([^\s"'<>]+)(?=[\s/>])""", r'\1"\2"', text))
        except ET.ParseError:
            root = None
    if root is None:
        return [(path, None, None, None, None, None, wrong)]
    rows = []
    for node in root.iter():
        if local(node.tag) in ("item", "entry"):
            link = child(node, "link")
            rows.append((path, child(node, "guid", "id") or link, child(node, "title"), link, utc(child(node, "pubDate", "published", "updated")), child(node, "encoded", "content", "description", "summary"), None))
    return rows


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all feed documents under `path`: a document a row, parsed where it lies."""

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse_feed(p, t)]
            cols = list(zip(*rows)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=list(FIELDS))

    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value").mapInArrow(run, ITEM)


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """(rssUrl, name, groupName, error) of OPML files; an outline's group is its nearest named ancestor. Of outlines with one URL the first counts, by file and place; a file that can't be read gives a row with an error."""

    def walk(node: ET.Element, group: str | None):
        for c in node:
            if local(c.tag) != "outline":
                yield from walk(c, group)
            elif c.get("xmlUrl"):
                yield c.get("xmlUrl"), c.get("title") or c.get("text"), group
            else:
                yield from walk(c, c.get("title") or c.get("text") or group)

    def run(batches):
        for b in batches:
            rows = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(file, k, *r, None) for k, r in enumerate(walk(ET.fromstring(text), None))]
                except ET.ParseError as e:  # a bad file is reported and costs no other
                    rows.append((file, 0, None, None, None, f"xml: {e}"))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), *[pa.string()] * 4))], names=["path", "k", "rssUrl", "name", "groupName", "error"])

    read = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value").mapInArrow(run, "path string, k int, rssUrl string, name string, groupName string, error string")
    first = F.min(F.struct("path", "k", "name", "groupName"))
    good = read.filter("error is null").groupBy("rssUrl").agg(first.alias("m")).select("rssUrl", "m.name", "m.groupName", F.lit(None).cast("string").alias("error"))
    return good.unionByName(read.filter("error is not null").select("rssUrl", "name", "groupName", F.concat_ws(": ", "path", "error").alias("error")))


def sync_sources(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Sources after an import: a known rssUrl takes the new name and group, an unknown one is added with the hash of its URL as id; enabled
    ones first by name. Rows without a URL are left out."""
    new = found.filter("rssUrl is not null").groupBy("rssUrl").agg(F.min(F.struct("name", "groupName")).alias("n"))
    out = sources.select("id", "name", "rssUrl", "enabled").join(new, "rssUrl", "full")
    return out.select(F.coalesce("id", F.sha2("rssUrl", 256)).alias("id"), F.coalesce("n.name", "name", "rssUrl").alias("name"), "rssUrl", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.col("n.groupName").alias("groupName"))

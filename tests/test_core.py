"""Core operators: every query with SQL against DuckDB on the smallest tables, and small fixtures for the rest."""

import glob
import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomline import catalog
from loomline.operators import clusters, entities, feed, ingest
from loomline.plans.ingestion import ingest as ingest_plan
from loomline.sources import feeds
from loomline.streaming import backlog, views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def text(x):
        if isinstance(x, (list, np.ndarray)):
            return str([text(y) for y in x])
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.number)) or type(x).__name__ == "Decimal":
            return f"{float(x):.6g}"
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(x, y):
    """The similarity of two (compact, sorted words) by brute force; None if two names are not alike or share no block."""
    (c, s), (d, t) = x, y
    m = max(len(c), len(d))
    if c == d or s == t:
        return 0.99 if c == d else 0.96
    block = any(len(w) >= 2 and w in t for w in s) or (min(len(c), len(d)) >= 5 and (c[:3], len(c) // 2) == (d[:3], len(d) // 2))
    e = 1 - edit(c, d) / m if block and m >= 5 and abs(len(c) - len(d)) <= 0.2 * m else 0
    return round(min(0.94, e), 6) if e >= 0.82 else None


def test_entity_suggestions_of_all_blocks(spark, tmp_path):
    import random

    import regex

    r = random.Random(7)
    words = ["".join(r.choice("abcdé日") for _ in range(r.randrange(1, 12))) for _ in range(25)] + ["Institute", "of"]
    names = ["Meta AI", "AI Meta", "qq", "QQ", "Q-Q", "Zmith Robert", "Robert Smith", "Robert Smyth", "", "!!", "xbcdefgh Bank", "abcdefgh Bank", "Meta / AI", "Meta与AI", "Robert Smiths", "Big Parties", "Big Party"]
    for _ in range(130):
        base = r.sample(words, r.randrange(1, 5))
        typed = list(" ".join(base))
        for _ in range(r.randrange(1, 1 + max(1, len(typed) // 6) + 1)):
            typed.insert(r.randrange(len(typed) + 1), r.choice("abcdé"))
            del typed[r.randrange(len(typed))]
        names += [" ".join(base), "".join(typed), " ".join(reversed(base))]
    rows = [(f"e{i:04d}", n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "id string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    one = lambda w: w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if w.endswith("s") and len(w) > 3 and not w.endswith(("ss", "us")) else w
    low = {i: n.lower().strip() for i, n in rows}
    es = [(i, [one(w) for w in regex.split(r"[^\p{L}\p{N}]+", n.lower()) if w]) for i, n in rows if "/" not in n and "与" not in n]
    es = [(i, ("".join(w), sorted(w))) for i, w in es if w]
    want = {(a, b): s for k, (a, x) in enumerate(es) for b, y in es[k + 1 :] if low[a] != low[b] and (s := alike(x, y))}
    got = [(x.a, x.b, float(x.similarity)) for x in entities.entity_suggestions(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and all(abs(want.get((a, b), 0) - s) < 1e-5 for a, b, s in got)
    assert ("e0000", "e0001") in want and not any("e0012" in p or "e0013" in p for p in want)


def test_bm25_join_loses_no_pair(spark, monkeypatch):
    import random

    monkeypatch.setattr(clusters, "CHUNK", 3)
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    made = [(f"c{i:03d}", " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(40)], k=r.randrange(1, 12))), None, None, None) for i in range(60)] + [("e", "", None, None, None)]
    frame = spark.createDataFrame(made, "id string, title string, summary string, eventSubject string, eventObject string")
    con = duckdb.connect()
    con.register("content_clusters", pd.DataFrame(made, columns=frame.columns))
    for floor in (1, 50_000, 400_000, 1_500_000):
        want = con.execute(catalog.SQL["bm25_pairs"].replace(str(clusters.BM25_FLOOR), str(floor))).fetchdf()
        assert rows(clusters.bm25_join(frame, floor).toPandas()) == rows(want)


def made_clusters(spark):
    import random

    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    made = [(f"c{r.randrange(10**6):06d}", " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(300)], k=r.randrange(1, 20))), None, None, None, datetime(2026, 6, 25 + k % 6)) for k in range(160)]
    frame = spark.createDataFrame(made + [("e", "", None, None, None, None)], "id string, title string, summary string, eventSubject string, eventObject string, updatedAt timestamp_ntz")
    con = duckdb.connect()
    con.register("content_clusters", frame.toPandas())
    return frame, con


def test_bm25_pairs_by_tiles_are_not_shuffled(spark, monkeypatch):
    frame, con = made_clusters(spark)
    for block, tile in ((65_536, 1024), (50, 16), (64, 64)):
        monkeypatch.setattr(clusters, "BLOCK", block)
        monkeypatch.setattr(clusters, "TILE", tile)
        for floor in (1, 800_000):
            got = clusters.bm25_join(frame, floor)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            assert rows(got.toPandas()) == rows(con.execute(catalog.SQL["bm25_pairs"].replace(str(clusters.BM25_FLOOR), str(floor))).fetchdf())


def test_bm25_neighbours_of_changed_clusters(spark, monkeypatch, tmp_path):
    frame, con = made_clusters(spark)
    frame.write.parquet(f"{tmp_path}/content_clusters.parquet")
    monkeypatch.setattr(clusters, "BLOCK", 50)
    monkeypatch.setattr(clusters, "TILE", 16)
    want = con.execute(catalog.SQL["changed_neighbours"].replace(str(clusters.BM25_FLOOR), "200000").replace("<= 400", "<= 5")).fetchdf()
    best = clusters.bm25_blocks(*clusters.bm25_docs(frame, clusters.F.col("updatedAt") >= datetime(2026, 6, 29)), 200_000, 5).toPandas()
    kept = {(x.a, x.b): x.score for x in best.itertuples()}
    assert len(want) > 100 and all(kept[x.c, x.o] == x.score for x in want.itertuples()) and len(kept) < 54 * 6 * 5
    monkeypatch.setattr(clusters, "BM25_FLOOR", 700_000)
    want = con.execute(catalog.SQL["changed_neighbours"].replace("6000000", "700000")).fetchdf()
    assert rows(clusters.changed_neighbours(spark, str(tmp_path)).toPandas()) == rows(want)


@pytest.mark.parametrize("seeds", [4, 50, 0])  # 0: no pair gives a floor
def test_bm25_best_pairs_without_low_floors(spark, monkeypatch, seeds):
    frame, con = made_clusters(spark)
    monkeypatch.setattr(clusters, "SEEDS", seeds)
    monkeypatch.setattr(clusters, "CHUNK", 5)
    want = con.execute(catalog.SQL["clean_pairs"].replace("LIMIT 500", "LIMIT 40")).fetchdf()
    assert rows(clusters.bm25_best(frame, 40).toPandas()) == rows(want)


def test_item_ranking_shuffles_no_pairs(spark):
    got = clusters.item_cluster_ranking(spark, DATA)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_search_of_all_columns(spark):
    made = [("order", "Units of Ford: recalls", None), ("columns", "recalls", "the UNITS"), ("wide", "ｕｎｉｔｓ", "re-calls"), ("one", "recalls only", None), ("none", None, None), ("cjk", "芯新片厂", None)]
    df = spark.createDataFrame(made, "id string, a string, b string").withColumn("corpus", feed.search_corpus(("a", "b")))
    found = lambda q: {x.id for x in df.filter(feed.fuzzy_match(q, df.corpus)).collect()}
    assert found("units, Recalls") == {"order", "columns", "wide"}
    assert found("芯片") == {"cjk"} and found("片芯") == set() and found("") == {x[0] for x in made}


def test_filtered_review_of_all_columns(spark, tmp_path):
    from loomline.operators import review

    T = datetime(2026, 6, 25)
    texts = [("a", "Chip", None, None, None), ("b", "x", "a chip", None, None), ("c", "x", None, "CHIPS", None), ("d", "x", None, None, "chip"), ("e", "x", "y", "z", None)]
    made = [(i, *rest, "filtered", "s", T, T) for i, *rest in texts]
    schema = "id string, originalTitle string, translatedTitle string, summaryText string, rssExcerpt string, moderationStatus string, sourceId string, createdAt timestamp_ntz, updatedAt timestamp_ntz"
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/items.parquet")
    assert {x.id for x in review.filtered_review_all(spark, str(tmp_path)).collect()} == set("abcd")


def test_child_closure_is_deep_and_ends(spark, tmp_path):
    T = datetime(2026, 1, 1)
    chain = [(f"c{i}", f"c{i - 1}" if i else None, i in (0, 3)) for i in range(9)] + [("x", "y", True), ("y", "x", False)]
    frame = spark.createDataFrame([(i, p, g, "s", T) for i, p, g in chain], "id string, parentItemId string, isAggregation boolean, sourceId string, updatedAt timestamp")
    frame.write.parquet(f"{tmp_path}/items.parquet")
    got = [(x.root, x.id, x.depth) for x in feed.child_closure(spark, str(tmp_path)).collect()]
    want = {(f"c{r}", f"c{i}", i - r) for r in (0, 3) for i in range(r + 1, 9)} | {("x", "y", 1)}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("chunk", [2000, 0])  # 0: every vertex counts as a hub
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("a", "b"), ("b", "a"), ("c", "b")]
    got = {r.id: r.component for r in clusters.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"n{i}": "n0" for i in range(31)} | {"a": "a", "b": "a", "c": "a"}


T0 = datetime(2026, 1, 1, 10)
VIEWS = [(T0 + timedelta(minutes=m), p, v) for m, p, v in [(0, "/a", 1), (10, "/a", 1), (29, "/a", 1), (31, "/a", 1), (45, "/a", 1), (62, "/a", 1), (5, "/b", 1), (6, "/a", 2), (6, "/a", 2)]]
SEEN = {(0, "/a", 1), (31, "/a", 1), (62, "/a", 1), (5, "/b", 1), (6, "/a", 2)}


def minutes(collected):
    return {((r.ts - T0).total_seconds() / 60, r.path, r.visitor) for r in collected}


def test_view_dedupe(spark):
    df = spark.createDataFrame([*VIEWS, (None, "/a", 1), (T0, None, 1)], "ts timestamp, event_type string, user_id long")
    assert minutes(views.dedupe_views(df).collect()) == SEEN


def test_view_stream(spark, tmp_path):
    for k, part in enumerate((VIEWS[:4], VIEWS[4:])):
        spark.createDataFrame(part, "ts timestamp, event_type string, user_id long").coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema("ts timestamp, event_type string, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for name, df, mode in (("seen", views.dedupe_view_stream(stream), "append"), ("counts", views.view_counts_stream(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert minutes(spark.table("seen").collect()) == SEEN
    assert spark.table("counts").agg({"pv": "sum"}).collect()[0][0] == len(VIEWS)


def test_backlog(spark, tmp_path):
    b = backlog.Backlog(spark, str(tmp_path))
    row = lambda h, s, m: (h, f"i{h}", s, T0 + timedelta(minutes=m))
    b.batch(spark.createDataFrame([row("x", "new", 0), row("y", "new", 0), row("x", "failed", 1)], backlog.SCHEMA), 0)
    b.batch(spark.createDataFrame([row("y", "processed", 2), row("z", "new", 2)], backlog.SCHEMA), 1)
    b.batch(spark.createDataFrame([row("y", "processed", 2), row("z", "new", 2)], backlog.SCHEMA), 1)
    assert {(r.urlHash, r.status) for r in b.read(1).collect()} == {("x", "failed"), ("z", "new")}


RSS = """<rss><channel><item><title>A &amp; B</title><link>https://x.example/1</link><guid>g1</guid><pubDate>Tue, 02 Jun 2026 10:00:00 +0000</pubDate></item>
<item><title>C</title><link>https://x.example/2</link><pubDate>someday</pubDate></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>T</title><link href="https://y.example/"/><updated>2026-06-02T10:00:00Z</updated></entry></feed>'
OPML = '<opml><body><outline text="News"><outline text="X" xmlUrl="https://x.example/rss"/><outline><outline title="Y" xmlUrl="https://y.example/rss"/></outline></outline><outline text="Z" xmlUrl="https://z.example/rss"/></body></opml>'


def test_feeds(spark, tmp_path):
    for name, text in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<html><body/></html>"), ("d.xml", "<rss><broken")):
        (tmp_path / name).write_text(text)
    got = feeds.read_feeds(spark, str(tmp_path)).collect()
    assert {(r.guid, r.title, r.published) for r in got if not r.error} == {("g1", "A & B", "2026-06-02T10:00:00+00:00"), ("https://x.example/2", "C", None), ("e1", "T", "2026-06-02T10:00:00Z")}
    assert sum(bool(r.error) for r in got) == 2


def test_opml(spark, tmp_path):
    (tmp_path / "o.opml").write_text(OPML)
    (tmp_path / "bad.opml").write_text("<opml><broken")
    read = feeds.read_opml(spark, str(tmp_path))
    assert read.filter("error is not null").count() == 1
    have = spark.createDataFrame([("s1", "Old", "https://x.example/rss", False), ("s2", "Kept", "https://k.example/rss", True)], "id string, name string, rssUrl string, enabled boolean")
    after = {(r.id[:2], r.name, r.enabled) for r in feeds.sync_sources(have, read).collect() if r.id in ("s1", "s2")}
    assert after == {("s1", "X", False), ("s2", "Kept", True)} and feeds.sync_sources(have, read).count() == 4
    got = {(r.rssUrl[8], r.name, r.groupName) for r in read.filter("error is null").collect()}
    assert got == {("x", "X", "News"), ("y", "Y", "News"), ("z", "Z", None)}


def test_rules_and_plan(spark):
    body = "word " * 40
    items = [("1", "Big coupon", body, "https://x.example/a"), ("2", "News", body, "https://x.example/b?utm_source=q"), ("3", "strike now", body, "https://x.example/c"), ("4", "Short", "", "https://x.example/promo/"), ("5", None, None, None)]
    df = spark.createDataFrame(items, "id string, title string, content string, url string")
    got = {r.id: (r.score, r.filtered, r.reason) for r in ingest.rule_filter(df, "title", "content", "url", ingest.BLACKLIST).collect()}
    assert got == {"1": (55, False, "marketing"), "2": (100, False, None), "3": (0, True, "strike"), "4": (40, True, "sponsored_path"), "5": (100, False, None)}
    known = df.filter("id = '2'").select(__import__("pyspark.sql.functions", fromlist=["x"]).sha2("url", 256).alias("urlHash"))
    out = ingest_plan(df, known, lambda b: b[["id"]].assign(topic="t"), "id string, topic string").collect()
    assert {r.id for r in out} == {"1", "2", "5"}  # the tracking parameter is no part of the URL that was known


def test_canonical_url(spark):
    urls = {"https://x.example/a?utm_source=f&b=1#top": "https://x.example/a?b=1", "https://x.example/a?b=1&utm_term=z": "https://x.example/a?b=1", "https://x.example/a?utm_source=f": "https://x.example/a", "https://x.example/": "https://x.example/"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", ingest.canonical_url(df.u).alias("c")).collect()} == urls


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    from loomline.functions import scalars as S

    def each(values, f):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
        return [r.o for r in sorted(rows, key=lambda r: r.i)]

    dates = {"2026-06-02T10:00:00Z": datetime(2026, 6, 2, 10), "Tue, 02 Jun 2026 10:00:00 +0200": datetime(2026, 6, 2, 8), "2026-06-02 10:00": datetime(2026, 6, 2, 2), "Tue, 02 Jun 2026 10:00:00 GMT": datetime(2026, 6, 2, 10),
             "2026-06-02T10:00:00.123-03:30": datetime(2026, 6, 2, 13, 30), "2026-06-02 10:00:00 EST": None, "2026-06-02": None, "2026-02-30T10:00:00Z": None, "": None, None: None, "2026-06-02 10:00:00 XYZ": None}
    assert each(dates, S.published_at) == list(dates.values())
    authors = {" Ann ": "Ann", '{"name": "Bo"}': "Bo", '{"title": ["", "Cy"]}': "Cy", '{"email": " "}': None, "": None, None: None}
    assert each(authors, S.author) == list(authors.values())
    assert each(["&lt;a&gt; &amp;lt; &#233;&#38;&#20013;", None], S.decode_entities) == ["<a> &lt; é&中", None]
    assert each(["One. Two three four", "abc", "no stop at all here", "**bold text. and more", None], lambda c: S.at_sentence_end(c, 12)) == ["One. Two thr", "abc", "no stop at a", "bold text.", None]
    masked = each(["Authorization: Bearer abc.def", 'api_key="xyz", n', "é" * 10, None], lambda c: S.redacted(c, 60))
    assert masked == ["Authorization: Bearer [redacted]", 'api_key="[redacted]", n', "é" * 10, None]
    assert each(["é" * 10], lambda c: S.redacted(c, 5)) == ["éé"]
    assert each(["https://a.example/", "https://a.example", "https://a.example/x", "https://a.example?q=1", "mailto:x", None], S.specific_url) == [False, False, True, True, False, False]


def test_requests():
    from loomline.operators import requests as R

    now = datetime(2026, 3, 31, 20, 0)  # the first of April at 04:00 in UTC+8
    assert R.range_start("today", now) == datetime(2026, 3, 31, 16) and R.range_start("3d", now) == datetime(2026, 3, 28, 20)
    assert R.shifted(datetime(2026, 3, 31), -1) == datetime(2026, 3, 3) and R.shifted(datetime(2024, 2, 29), -12) == datetime(2023, 3, 1)
    assert R.resolve({}, now).start == datetime(2026, 3, 31, 16) and R.resolve({"title": "x"}, now).start is None
    r = R.resolve({"start": "2026-02-30", "end": "2026-03-02", "size": "999", "page": "-3", "sort": "score_desc", "entryType": "x"}, now)
    assert (r.start, r.end, r.size, r.number, r.order, r.entry_type) == (None, datetime(2026, 3, 2, 15, 59, 59, 999000), 200, 1, "score_desc", None)
    r = R.resolve({"start": "2026-03-05", "end": "2026-03-01"}, now)
    assert r.start == datetime(2026, 2, 28, 16) and r.end.day == 5
    assert R.like("5%_") == "%5\\%\\_%"


def test_answers_members_and_runs(spark):
    from loomline.operators import pairs, tasks

    answers = spark.createDataFrame([('{"decisions": [{"pair_id": "p1", "relation": "same_event", "confidence": 120}, {"pair_id": "p9", "relation": "unrelated"}, {"pair_id": "p2", "relation": "maybe"}, {"pair_id": "p1", "relation": "unrelated"}]}',), ("nonsense",)], "text string")
    got = {(r.pair_id, r.relation, r.confidence, r.dropped) for r in tasks.salvaged(answers, spark.createDataFrame([("p1",), ("p2",)], "pair_id string")).collect()}
    assert got == {("p1", "same_event", 100, None), ("p9", "unrelated", None, "unknown pair"), ("p2", "maybe", None, "unknown relation"), ("p1", "unrelated", None, "repeated pair"), (None, None, None, "unreadable")}
    g = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3), ("u", "a", 1)], "target string, source string, rank int")
    assert {(r.target, r.source) for r in pairs.safe_members(g, spark.createDataFrame([("b", "a")], "a string, b string")).collect()} == {("t", "a"), ("t", "c"), ("u", "a")}
    assert tasks.next_run(8, 30, datetime(2026, 6, 1, 0, 0)) == datetime(2026, 6, 1, 0, 30) and tasks.next_run(8, 0, datetime(2026, 6, 1, 0, 0)) == datetime(2026, 6, 2, 0, 0)


def test_pages_beyond_the_last_are_the_last(spark):
    rows = [(datetime(2026, 1, 1) + timedelta(hours=i), i, 1, f"e{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "created timestamp, score int, itemCount int, entryId string")
    ids = lambda n: sorted(r.entryId for r in feed.page(df, "newest", n, 3).collect())
    assert ids(1) == ["e4", "e5", "e6"] and ids(3) == ids(9) == ["e0"] and feed.page(df.limit(0), "newest", 2).count() == 0


def test_embeddings_are_cached_and_failures_stay_alone(spark):
    from loomline.operators import lists

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([("1", "h1", "abc"), ("2", "h2", "bad"), ("3", "h3", "xy"), ("4", "h3", "xy")], "id string, hash string, text string")
    cache = spark.createDataFrame([("h1", [9.0])], "hash string, vector array<float>")
    got = {r.id: r.vector for r in lists.embedded(texts, cache, embed).collect()}
    assert got == {"1": [9.0], "2": None, "3": [2.0], "4": [2.0]}

"""Entities: names of items, alias resolution, blocking and similarity, shared items, co-occurrence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.feed import items_once
from loomline.registry import ITEMS, query
from loomline.runtime import materialize, pairs_within, table

# Punctuation cut from a name's edges, and names too general to be entities.
EDGE = r"[\s#＃\"“”‘’`.,，。:：;；!?！？、()\[\]{}【】<>《》]+"
GENERIC = ("公司 机构 产品 平台 服务 功能 能力 产品能力 方案 项目 工具 模型 版本 政策 漏洞 论文 行业 市场 多项更新 roundup 新闻 资讯 文章 更新 动态 科技 技术 互联网 "
           "news article update updates technology tech").split()  # fmt: skip
GENERIC_SQL = ", ".join(f"'{g}'" for g in GENERIC)


def entity_name(c: Column) -> Column:
    """Edge punctuation cut, white space collapsed; null if empty, over 40 characters or too general."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^" + EDGE, ""), EDGE + "$", ""), r"\s+", " "))
    return F.when((F.length(name) > 0) & (F.length(name) <= 40) & ~F.lower(name).isin(GENERIC), name)


def name_sql(c: str) -> str:
    edge = EDGE.replace("'", "''")
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '^{edge}', ''), '{edge}$', ''), '\\s+', ' ', 'g'))"


ITEM_ENTITIES = f"""{ITEMS}, raw AS (SELECT id, {name_sql('eventSubject')} AS n FROM it WHERE eventSubject IS NOT NULL UNION ALL SELECT id, {name_sql('eventObject')} FROM it WHERE eventObject IS NOT NULL),
    ie AS (SELECT id, lower(n) AS k, min(n) AS name FROM raw WHERE length(n) BETWEEN 1 AND 40 AND lower(n) NOT IN ({GENERIC_SQL}) GROUP BY 1, 2)"""


def item_entity_links(spark: SparkSession, d: str) -> DataFrame:
    """(id, k, name): the different entities of each item."""
    raw = items_once(spark, d).select("id", F.explode(F.array("eventSubject", "eventObject")).alias("n")).withColumn("n", entity_name(F.col("n"))).filter("n is not null")
    return raw.groupBy("id", F.lower("n").alias("k")).agg(F.min("n").alias("name"))


@query(f"WITH {ITEM_ENTITIES} SELECT id, k, name FROM ie")
def item_entities(spark: SparkSession, d: str) -> DataFrame:
    return item_entity_links(spark, d)


@query(f"WITH n AS (SELECT id, {name_sql('name')} AS n FROM entities) SELECT id, n AS name, lower(n) AS normalized FROM n WHERE length(n) BETWEEN 1 AND 40 AND lower(n) NOT IN ({GENERIC_SQL})")
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "entities").select("id", entity_name(F.col("name")).alias("name")).filter("name is not null")
    return n.withColumn("normalized", F.lower("name"))


@query(f"""WITH {ITEM_ENTITIES}, a AS (SELECT aliasNormalized AS k, min(e.name) AS n FROM aliases JOIN entities e ON e.id = entityId GROUP BY 1), e AS (SELECT normalized AS k, min(name) AS n FROM entities WHERE normalized IS NOT NULL GROUP BY 1)
    SELECT ie.id, ie.k, coalesce(a.n, e.n, ie.name) AS canonical, a.n IS NOT NULL AS byAlias, e.n IS NOT NULL AS byName FROM ie LEFT JOIN a USING (k) LEFT JOIN e USING (k)""")
def resolved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The canonical name of every mention: an alias's entity, else an entity of that name, else the mention itself."""
    ent = table(spark, d, "entities")
    alias = table(spark, d, "aliases").join(ent.select(F.col("id").alias("entityId"), "name"), "entityId").groupBy(F.col("aliasNormalized").alias("k")).agg(F.min("name").alias("a"))
    exact = ent.filter("normalized is not null").groupBy(F.col("normalized").alias("k")).agg(F.min("name").alias("e"))
    out = item_entity_links(spark, d).join(alias, "k", "left").join(exact, "k", "left")
    return out.select("id", "k", F.coalesce("a", "e", "name").alias("canonical"), F.col("a").isNotNull().alias("byAlias"), F.col("e").isNotNull().alias("byName"))


# Signs and words that join two names into a relation.
RELATION = r"[、/&|]|(?:^|[\s(\[{（【])(?:与|和|及|以及)(?=$|[\s)\]}）】])|[\p{L}\p{N}](?:与|和|及|以及)[\p{L}\p{N}]|(?:^|\s)(?:vs|versus)(?=$|\s)"


def singular(w: Column) -> Column:
    return F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(
        w.endswith("s") & (F.length(w) > 3) & ~w.endswith("ss") & ~w.endswith("us"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


ALIKE = 0.82


def most_edits(length: int) -> int:
    """Edits that leave two names alike, the longer of this length."""
    return int((1 - ALIKE) * length + 1e-9)


def segments(length: int) -> tuple[int, list[tuple[int, int]]]:
    """(K, places) of a name that may meet names as long or longer: of K + 1 pieces, one survives any K edits."""
    longest = length
    while longest + 1 - length <= most_edits(longest + 1):
        longest += 1
    k = most_edits(longest)
    cut = [length * i // (k + 1) for i in range(k + 2)]
    return k, list(zip(cut, cut[1:]))


def letter_bits(name: str) -> int:
    """62 bits: of each of 31 classes of characters whether it occurs once and twice. An edit changes at most two bits."""
    bits = 0
    for c in name:
        one = 1 << 2 * (ord(c) % 31)
        bits |= one << 1 if bits & one else one
    return bits


def segment_keys(names: DataFrame) -> DataFrame:
    """(compact, bits, key, index) of (compact): a name's own pieces, and the pieces of shorter or equal names that it may hold.

    With at most K edits some piece i is intact after exactly i edits or fewer on its left and K - i or fewer on its
    right, so it has moved by no more than that: two names within the bound always share a key.
    """

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.column(0).to_pylist():
                n, bits, got = len(s), letter_bits(s), set()
                k, places = segments(n)
                out += [(s, bits, f"{n}:{i}:{s[p:q]}", True) for i, (p, q) in enumerate(places)]
                for m in range(max(1, n - most_edits(n)), n + 1):
                    k, places = segments(m)
                    for i, (p, q) in enumerate(places):
                        lo, hi = max(-i, n - m - (k - i)), min(i, n - m + (k - i))
                        got |= {f"{m}:{i}:{s[p + x : q + x]}" for x in range(max(lo, -p), min(hi, n - q) + 1)}
                out += [(s, bits, g, False) for g in got]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["compact", "bits", "key", "index"])

    return names.select("compact").mapInArrow(run, "compact string, bits long, key string, index boolean")


def alike_names(names: DataFrame) -> DataFrame:
    """(a, b, similarity, reason): pairs of different ids of (id, name) alike by spelling that share any of the four blocks: compact text,
    sorted words, a word of two letters or more, first three characters and half the length; a < b, the best of an id's names.

    Equal compact text counts .99, the same words in another order .96, otherwise the share of characters that edits leave, from .82
    to .94, in names of five or more. Equal names and names of relations are no pair. Blocks of frequent words are
    never paired out: equal texts meet by text, names within the edit bound by an intact piece (`segment_keys`, lossless), and
    sharing a block is then a condition on the pair. No block is left out for its size.
    """
    from loomline.functions.text import nfkc  # defining it needs a session

    e = names.filter("id is not null and name is not null").select("id", F.lower(F.trim(nfkc(F.col("name")))).alias("low")).filter(~F.col("low").rlike(RELATION))
    e = materialize(e.withColumn("w", F.filter(F.split("low", r"[^\p{L}\p{N}]+"), lambda x: x != "")).distinct(), "lower")
    words = F.transform("w", singular)
    e = e.select("id", F.regexp_replace("low", r"\s+", "").alias("tight"), F.array_join(words, "").alias("compact"), F.array_join(F.array_sort(words), " ").alias("sorted"), F.filter(words, lambda x: F.length(x) >= 2).alias("words"), "low")
    e = e.filter("compact <> ''").withColumn("k", F.when(F.length("compact") >= 5, F.concat(F.substring("compact", 1, 3), F.floor(F.length("compact") / 2).cast("string"))))
    e = materialize(e, "names")
    x, y = e.alias("x"), e.alias("y")
    sides = [F.col("x.id").alias("a"), F.col("y.id").alias("b")]
    ordered = (F.col("x.id") < F.col("y.id")) & (F.col("x.low") != F.col("y.low"))
    why = F.when(F.col("x.tight") == F.col("y.tight"), "punctuation_match").otherwise("compact_match")
    same = x.join(y, (F.col("x.compact") == F.col("y.compact")) & ordered).select(*sides, F.lit(0.99).alias("similarity"), why.alias("reason"))
    moved = x.join(y, (F.col("x.sorted") == F.col("y.sorted")) & ordered & (F.col("x.compact") != F.col("y.compact"))).select(*sides, F.lit(0.96).alias("similarity"), F.lit("singular_match").alias("reason"))
    keys = materialize(segment_keys(e.select("compact").distinct()), "segments")
    p, q = keys.filter("index").alias("p"), keys.filter("not index").alias("q")
    longer = F.greatest(F.length("p.compact"), F.length("q.compact"))
    most = F.floor((1 - ALIKE) * longer + 1e-9).cast("int")
    near = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.compact") != F.col("q.compact")) & (F.bit_count(F.col("p.bits").bitwiseXOR(F.col("q.bits"))) <= 2 * most))
    near = near.select(F.least("p.compact", "q.compact").alias("l"), F.greatest("p.compact", "q.compact").alias("r"), longer.alias("m"), most.alias("most")).filter("m >= 5")
    near = near.withColumn("d", F.expr("levenshtein(l, r, most)")).filter("d >= 0").withColumn("edit", 1.0 - F.col("d") / F.col("m"))
    near = near.filter(F.col("edit") >= ALIKE).select("l", "r", "edit").distinct()
    block = F.arrays_overlap("x.words", "y.words") | F.coalesce(F.col("x.k") == F.col("y.k"), F.lit(False))
    pairs = near.join(x, F.col("l") == F.col("x.compact")).join(y, F.col("r") == F.col("y.compact"))
    pairs = pairs.filter((F.col("x.id") != F.col("y.id")) & (F.col("x.sorted") != F.col("y.sorted")) & block)
    close = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.round(F.least(F.lit(0.94), F.col("edit")), 6).alias("similarity"), F.lit("edit_distance").alias("reason"))
    best = same.unionByName(moved).unionByName(close).groupBy("a", "b").agg(F.max(F.struct("similarity", "reason")).alias("m"))
    return best.select("a", "b", "m.similarity", "m.reason")


@query()
def entity_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entities alike by spelling. Edits are counted in characters, which SQL here counts in bytes: tested by brute force."""
    return alike_names(table(spark, d, "entities").select("id", "name"))


@query()
def entity_best_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The same over all forms of an entity: its name, its normal form and its aliases."""
    e = table(spark, d, "entities")
    forms = e.select("id", "name").unionByName(e.select("id", F.col("normalized").alias("name"))).unionByName(table(spark, d, "aliases").select(F.col("entityId").alias("id"), F.col("aliasName").alias("name")))
    return alike_names(forms)


SIZED = f"{ITEM_ENTITIES}, n AS (SELECT k, count(*) AS items FROM ie GROUP BY 1), al AS (SELECT entityId, count(*) AS aliases FROM aliases GROUP BY 1), sz AS (SELECT e.id, e.name, e.normalized, e.createdAt, coalesce(items, 0) AS items, coalesce(aliases, 0) AS aliases FROM entities e LEFT JOIN n ON n.k = e.normalized LEFT JOIN al ON al.entityId = e.id)"


def sized(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their numbers of items and aliases."""
    n = item_entity_links(spark, d).groupBy(F.col("k").alias("normalized")).agg(F.count(F.lit(1)).alias("items"))
    a = table(spark, d, "aliases").groupBy(F.col("entityId").alias("id")).agg(F.count(F.lit(1)).alias("aliases"))
    return table(spark, d, "entities").select("id", "name", "normalized", "createdAt").join(n, "normalized", "left").join(a, "id", "left").fillna(0, ["items", "aliases"])


def preference(p: str) -> Column:
    """What a canonical entity is chosen by, the least first: more items, more aliases, the shorter name, the older, then the id."""
    return F.struct((-F.col(f"{p}.items")).alias("i"), (-F.col(f"{p}.aliases")).alias("a"), F.length(f"{p}.name").alias("l"), F.col(f"{p}.createdAt").alias("c"), F.col(f"{p}.id").alias("id"))


@query()
def suggestion_records(spark: SparkSession, d: str) -> DataFrame:
    """Suggested merges: source into target by preference, with shared items; pairs that an alias already joins are left out, and each expires in a week."""
    s, z = alike_names(table(spark, d, "entities").select("id", "name")), sized(spark, d)
    p = s.join(z.alias("x"), F.col("a") == F.col("x.id")).join(z.alias("y"), F.col("b") == F.col("y.id"))
    first = preference("x") < preference("y")
    pick = lambda c, yes, no: F.when(first, F.col(f"{yes}.{c}")).otherwise(F.col(f"{no}.{c}"))
    p = p.select(pick("id", "y", "x").alias("source"), pick("id", "x", "y").alias("target"), pick("normalized", "y", "x").alias("ks"), pick("normalized", "x", "y").alias("kt"), "similarity", "reason")
    known = table(spark, d, "aliases").filter("entityId is not null").select(F.col("entityId").alias("target"), F.col("aliasNormalized").alias("ks")).distinct()
    ie = item_entity_links(spark, d).select("id", "k")
    both = p.join(ie.select("id", F.col("k").alias("ks")), "ks").join(ie.select("id", F.col("k").alias("kt")), ["id", "kt"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared"))
    out = p.join(known, ["target", "ks"], "left_anti").join(both, ["source", "target"], "left").fillna(0, ["shared"])
    return out.select("source", "target", "similarity", "reason", "shared", F.lit("2026-07-07").cast("date").alias("expires"))


@query()
def suggestion_list(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty suggestions by confidence, then by shared items."""
    return suggestion_records(spark, d).orderBy(F.desc("similarity"), F.desc("shared"), "source", "target").limit(50)


@query()
def alias_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The thirty likeliest aliases to be judged: names alike, and subjects that stand together in clusters, the votes of each counted in."""
    alike = suggestion_records(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"), F.round(F.col("similarity") * 100).cast("long").alias("votes"))
    ids = table(spark, d, "entities").filter("normalized is not null").groupBy("normalized").agg(F.min("id").alias("id"))
    v = subject_votes(spark, d).filter("votes >= 2").join(ids.select(F.col("normalized").alias("a"), F.col("id").alias("ia")), "a").join(ids.select(F.col("normalized").alias("b"), F.col("id").alias("ib")), "b")
    both = alike.unionByName(v.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "votes"))
    g = both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("votes").alias("votes"))
    return g.orderBy(F.desc("votes"), "a", "b").limit(30)


@query()
def resolved_on_write(spark: SparkSession, d: str) -> DataFrame:
    """Mentions without an alias or an entity of their name, and the entity whose spelling is nearest, the preferred of equals; null if none is near."""
    open_ = resolved_mentions(spark, d).filter("not byAlias and not byName").select("k").distinct()
    z = sized(spark, d).select(F.concat(F.lit("e:"), "id").alias("id"), "name", "items")
    p = alike_names(z.select("id", "name").unionByName(open_.select(F.concat(F.lit("m:"), "k").alias("id"), F.col("k").alias("name"))))
    hit = p.filter("a like 'e:%' and b like 'm:%'").join(z.select(F.col("id").alias("a"), "items"), "a").groupBy("b").agg(F.max(F.struct("similarity", "items", "a")).alias("m"))
    return open_.join(hit.select(F.substring("b", 3, 1000).alias("k"), F.substring(F.col("m.a"), 3, 1000).alias("entityId"), F.col("m.similarity").alias("similarity")), "k", "left")


MERGED = "mg AS (SELECT e.id AS source, min(a.entityId) AS target FROM entities e JOIN aliases a ON a.aliasNormalized = e.normalized AND a.entityId <> e.id GROUP BY 1), once AS (SELECT source, target FROM mg WHERE target NOT IN (SELECT source FROM mg))"


def merge_entities(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Links (id, entityId) after (source, target) merges; an item linked to both keeps one."""
    moved = links.join(merges.select(F.col("source").alias("entityId"), "target"), "entityId", "left")
    return moved.select("id", F.coalesce("target", "entityId").alias("entityId")).distinct()


@query(f"WITH {ITEM_ENTITIES}, {MERGED}, l AS (SELECT ie.id, e.id AS entityId FROM ie JOIN entities e ON e.normalized = ie.k) SELECT DISTINCT l.id, coalesce(target, entityId) AS entityId FROM l LEFT JOIN once ON source = entityId")
def merged_entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Items' entities after every entity that is another's alias is merged into it."""
    e = table(spark, d, "entities").filter("normalized is not null").select(F.col("id").alias("entityId"), F.col("normalized").alias("k"))
    links = item_entity_links(spark, d).select("id", "k").join(e, "k").select("id", "entityId")
    a = table(spark, d, "aliases").filter("entityId is not null").select(F.col("aliasNormalized").alias("k"), F.col("entityId").alias("target"))
    m = e.join(a, "k").filter("entityId <> target").groupBy(F.col("entityId").alias("source")).agg(F.min("target").alias("target"))
    return merge_entities(links, m.join(m.select(F.col("source").alias("target")), "target", "left_anti"))


@query(f"WITH {ITEM_ENTITIES} SELECT k AS normalized, min(name) AS name, count(*) AS items FROM ie WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.normalized = ie.k) GROUP BY 1")
def entity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Names of items that are no entity yet, each once."""
    have = table(spark, d, "entities").filter("normalized is not null").select(F.col("normalized").alias("k"))
    return item_entity_links(spark, d).join(have, "k", "left_anti").groupBy(F.col("k").alias("normalized")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("items"))


SORTS = {"items": ("items", "aliases"), "aliases": ("aliases", "items"), "newest": ("createdAt",), "name": ()}


@query(f"WITH {SIZED} SELECT id, name, items, aliases FROM sz WHERE contains(lower(name), 'bank') ORDER BY aliases DESC, items DESC, name, id LIMIT 25 OFFSET 0")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return entity_page(sized(spark, d), "Bank", "aliases")


def entity_page(entities: DataFrame, search: str | None, sort: str, number: int = 1, size: int = 25) -> DataFrame:
    """A page of sized entities whose name holds the search text, in one of four orders."""
    found = entities.filter(F.lower("name").contains(search.lower())) if search else entities
    return found.orderBy(*[F.desc(c) for c in SORTS[sort]], "name", "id").offset((number - 1) * size).limit(size).select("id", "name", "items", "aliases")


@query(f"WITH {ITEM_ENTITIES} SELECT a.k AS a, b.k AS b, count(*) AS items FROM ie a JOIN ie b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 3")
def shared_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that two entities share. An item has two entities at most, so the self-join on items stays linear."""
    ie = item_entity_links(spark, d).select("id", "k")
    p = ie.groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("ks")).filter("size(ks) = 2")
    return p.groupBy(F.col("ks")[0].alias("a"), F.col("ks")[1].alias("b")).agg(F.count(F.lit(1)).alias("items")).filter("items >= 3")


@query(f"""WITH {ITEMS}, s AS (SELECT DISTINCT clusterId, lower(eventSubject) AS k FROM it WHERE clusterId IS NOT NULL AND eventSubject IS NOT NULL)
    SELECT a.k AS a, b.k AS b, count(*) AS votes FROM s a JOIN s b ON a.clusterId = b.clusterId AND a.k < b.k GROUP BY 1, 2""")
def subject_votes(spark: SparkSession, d: str) -> DataFrame:
    """How many clusters hold two subjects together: different subjects of a cluster are few, its items may be many."""
    s = items_once(spark, d, "clusterId is not null and eventSubject is not null").select("clusterId", F.lower("eventSubject").alias("k")).distinct()
    return pairs_within(s, "clusterId", "k").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))


@query(f"""WITH {ITEM_ENTITIES}, n AS (SELECT k, count(*) AS items FROM ie GROUP BY 1), a AS (SELECT entityId, count(*) AS aliases FROM aliases GROUP BY 1)
    SELECT e.id, e.name, coalesce(items, 0) AS items, coalesce(aliases, 0) AS aliases FROM entities e LEFT JOIN n ON n.k = e.normalized LEFT JOIN a ON a.entityId = e.id ORDER BY items DESC, aliases DESC, id LIMIT 100""")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    n = item_entity_links(spark, d).groupBy(F.col("k").alias("normalized")).agg(F.count(F.lit(1)).alias("items"))
    a = table(spark, d, "aliases").groupBy(F.col("entityId").alias("id")).agg(F.count(F.lit(1)).alias("aliases"))
    e = table(spark, d, "entities").select("id", "name", "normalized").join(n, "normalized", "left").join(a, "id", "left").fillna(0, ["items", "aliases"])
    return e.orderBy(F.desc("items"), F.desc("aliases"), "id").limit(100).select("id", "name", "items", "aliases")

"""Whether two clusters are one event: text similarity, safety, score, admission, and what follows from judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.clusters import TOKENS_SQL, bm25_tokens, components
from loomline.operators.feed import items_once, visible
from loomline.registry import ITEMS, VISIBLE, query
from loomline.runtime import materialize, pairs_within, table

# Words too common to tell events apart, objects that name a relation, actions that deny, limits and weights of the score.
COMMON = "发布 推出 上线 更新 变更 调整 宣布 报道 消息 产品 功能 服务 平台 公司 新闻 内容 new launch launched release released update updates announces announced".split()
RELATIONAL = "合同 协议 合作 交易 收购 融资 投资 诉讼 政策".split()
DENIALS = "否认 辟谣 取消 终止 撤回 暂停 下架 deny cancel terminate".split()
GRAY, NEAR, EXEMPT, BRIDGE_WORDS, DAY = 55, 0.72, 20, 3, 86_400_000_000

# One text serves both dialects; what differs stands in braces.
SPARK = {"inter": "array_intersect", "size": "size", "minus": "array_except", "starts": "startswith", "list": "array", "join": "concat", "us": "unix_micros", "days": "abs(datediff(try_to_date({0}, 'yyyy-MM-dd'), try_to_date({1}, 'yyyy-MM-dd')))"}
DUCK = {"inter": "list_intersect", "size": "len", "minus": "list_minus", "starts": "starts_with", "list": "list_value", "join": "list_concat", "us": "epoch_us", "days": "abs(date_diff('day', TRY_CAST({0} AS DATE), TRY_CAST({1} AS DATE)))"}


def _words(ws: list[str], d: dict) -> str:
    return f"{d['list']}(" + ", ".join(f"'{w}'" for w in ws) + ")"


def similar(x: str, y: str, d: dict) -> tuple[str, str]:
    """(strong, similar) of two texts with token columns x_k and y_k: one holds the other, or they share two words, or one of a text of two."""
    some = f"(coalesce({x}, '') <> '' AND coalesce({y}, '') <> '')"
    overlap = f"{d['size']}({d['inter']}({x}_k, {y}_k))"
    strong = f"({some} AND coalesce({x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR {overlap} >= 2, false))"
    return strong, f"({strong} OR ({some} AND {overlap} >= 1 AND ({d['size']}({x}_k) <= 2 OR {d['size']}({y}_k) <= 2)))"


def compatible_dates(x: str, y: str, d: dict) -> str:
    """Equal, one within the other's month or year, or both days at most two apart; a missing date fits any."""
    near = f"(length({x}) = 10 AND length({y}) = 10 AND {d['days'].format(x, y)} <= 2)"
    return f"coalesce({x} = {y} OR {d['starts']}({y}, {x} || '-') OR {d['starts']}({x}, {y} || '-') OR {near}, true)"


def steps(d: dict) -> list[list[tuple[str, str]]]:
    """Columns of a pair, step by step; those of a step may use those of the steps before."""
    s_strong, s_like = similar("l_s", "r_s", d)
    o_strong, o_like = similar("l_o", "r_o", d)
    t_strong, t_like = similar("l_t", "r_t", d)
    role = f"({similar('l_s', 'r_o', d)[1]} OR {similar('r_s', 'l_o', d)[1]})"
    minus = f"{d['minus']}({d['inter']}(l_t_k, r_t_k), {d['join']}({d['join']}({d['join']}(l_s_k, r_s_k), {d['join']}(l_a_k, r_a_k)), {_words(COMMON, d)}))" if d is SPARK else \
        f"list_filter(list_intersect(l_t_k, r_t_k), lambda w: NOT list_contains(list_concat(l_s_k, r_s_k, l_a_k, r_a_k, {_words(COMMON, d)}), w))"
    denies = lambda side: "(" + " OR ".join(f"contains({side}_a, '{w}')" for w in DENIALS) + ")"
    action = f"(l_a IS NULL OR r_a IS NULL OR l_a = r_a OR coalesce(l_e = r_e, false) OR {d['size']}({d['inter']}(l_a_k, r_a_k)) > 0 OR {denies('l')} = {denies('r')})"
    relation = f"({d['size']}({d['inter']}({d['inter']}(l_o_k, r_o_k), {_words(RELATIONAL, d)})) > 0)"
    first = [("s_strong", s_strong), ("s_like", s_like), ("o_strong", o_strong), ("o_like", o_like), ("t_strong", t_strong), ("t_like", t_like), ("role", role), ("own", f"{d['size']}({minus})"),
             ("actions", f"coalesce({action}, false)"), ("related", relation), ("dates", compatible_dates("l_d", "r_d", d)), ("gap", f"abs({d['us']}(l_p) - {d['us']}(r_p))")]
    other = "CASE WHEN l_s IS NOT NULL AND r_s IS NOT NULL THEN NOT s_like ELSE l_s IS NOT NULL OR r_s IS NOT NULL END"
    second = [("bridge", f"({other} AND gap <= {DAY} AND t_strong AND own >= {BRIDGE_WORDS} AND actions AND (o_like OR role))"), ("strangers", "(l_s IS NOT NULL AND r_s IS NOT NULL AND NOT s_like AND NOT o_like AND NOT role)")]
    third = [("conflict", "(l_o IS NOT NULL AND r_o IS NOT NULL AND NOT o_strong AND NOT related AND NOT bridge)"), ("anchor", "(o_like OR own > 0 OR bridge)"),
             ("points", f"""CASE WHEN s_like THEN 35 ELSE 0 END + CASE WHEN o_like THEN 40 ELSE 0 END + CASE WHEN l_a = r_a THEN 20 WHEN l_e = r_e THEN 12 ELSE 0 END
      + CASE WHEN l_d IS NULL OR r_d IS NULL THEN 0 WHEN l_d = r_d THEN 15 WHEN dates THEN 6 ELSE -12 END + CASE WHEN t_strong THEN 20 WHEN t_like THEN 8 ELSE 0 END
      + CASE WHEN gap <= {DAY} THEN 8 WHEN gap <= {3 * DAY} THEN 4 ELSE 0 END + CASE WHEN bridge THEN 15 ELSE 0 END""")]  # fmt: skip
    reason = "CASE WHEN strangers THEN 'unrelated_subjects' WHEN conflict THEN 'object_conflict' WHEN NOT anchor THEN 'no_event_anchor' END"
    safety = f"CASE WHEN strangers THEN 'unrelated_subjects' WHEN conflict AND s_strong AND own >= {EXEMPT} THEN NULL WHEN conflict THEN 'object_conflict' WHEN NOT anchor THEN 'no_event_anchor' END"
    return [first, second, third, [("reason", reason), ("safety", safety), ("score", "CASE WHEN strangers OR conflict THEN 0 ELSE points END")]]


def _side_sql(p: str) -> str:
    tokens = lambda c, a: f"{TOKENS_SQL.replace('(x,', '(' + c + ',')} AS {p}_{a}_k"
    return f"""SELECT *, {tokens('coalesce(' + p + "_s, '')", 's')}, {tokens('coalesce(' + p + "_o, '')", 'o')}, {tokens('coalesce(' + p + "_a, '')", 'a')}, {tokens(p + '_t', 't')} FROM (SELECT id AS {p}_id,
      lower(trim(regexp_replace(eventSubject, '\\s+', ' ', 'g'))) AS {p}_s, lower(trim(regexp_replace(eventObject, '\\s+', ' ', 'g'))) AS {p}_o, lower(trim(coalesce(eventAction, eventType))) AS {p}_a, eventType AS {p}_e, eventDate AS {p}_d, latestPublishedAt AS {p}_p,
      lower(trim(regexp_replace(concat_ws(' ', title, summary, eventSubject, eventObject), '\\s+', ' ', 'g'))) AS {p}_t FROM content_clusters)"""


CACHED = "cached AS (SELECT least(leftClusterId, rightClusterId) AS a, greatest(leftClusterId, rightClusterId) AS b, max(vectorSimilarity) AS sim, max(bm25Score) AS bm25 FROM pair_cache WHERE leftClusterId <> rightClusterId GROUP BY 1, 2)"


def _scored_sql() -> str:
    sql = f"{CACHED}, s0 AS (SELECT * FROM cached JOIN ({_side_sql('l')}) ON l_id = a JOIN ({_side_sql('r')}) ON r_id = b)"
    for i, step in enumerate(steps(DUCK)):
        sql += f", s{i + 1} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step) + f" FROM s{i})"
    return sql


SCORED = _scored_sql()


def score_pairs(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds reason, safety, score, bridge to pairs (a, b, ...) of clusters: both sides are looked up, then all is expressions of one row."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    def side(p: str) -> DataFrame:
        c = clusters.select(
            F.col("id").alias(f"{p}_id"), plain("eventSubject").alias(f"{p}_s"), plain("eventObject").alias(f"{p}_o"), F.lower(F.trim(F.coalesce("eventAction", "eventType"))).alias(f"{p}_a"), F.col("eventType").alias(f"{p}_e"),
            F.col("eventDate").alias(f"{p}_d"), F.col("latestPublishedAt").cast("timestamp").alias(f"{p}_p"), plain(F.concat_ws(" ", "title", "summary", "eventSubject", "eventObject")).alias(f"{p}_t"))
        return c.select("*", *[bm25_tokens(F.coalesce(f"{p}_{x}", F.lit(""))).alias(f"{p}_{x}_k") for x in "soat"])

    out = pairs.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), F.col("b") == F.col("r_id"))
    for step in steps(SPARK):
        out = out.select("*", *[F.expr(e).alias(n) for n, e in step])
    return out


def cached_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "pair_cache").filter("leftClusterId <> rightClusterId")
    return c.groupBy(F.least("leftClusterId", "rightClusterId").alias("a"), F.greatest("leftClusterId", "rightClusterId").alias("b")).agg(F.max("vectorSimilarity").alias("sim"), F.max("bm25Score").alias("bm25"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return score_pairs(cached_pairs(spark, d), table(spark, d, "content_clusters"))


@query(f"WITH {SCORED} SELECT a, b, s_like AS subjects, o_like AS objects, t_strong AS texts, own, dates FROM s4")
def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike the subjects, objects and texts of cached pairs are, and how many telling words they share."""
    return scored(spark, d).select("a", "b", F.col("s_like").alias("subjects"), F.col("o_like").alias("objects"), F.col("t_strong").alias("texts"), "own", "dates")


@query(f"WITH {SCORED} SELECT a, b, safety FROM s4")
def pair_safety(spark: SparkSession, d: str) -> DataFrame:
    """Why a pair must not be merged; null if it may."""
    return scored(spark, d).select("a", "b", "safety")


@query(f"WITH {SCORED} SELECT a, b, score, reason, bridge FROM s4")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rule score of each cached pair, why it is rejected, and whether shared text bridges different subjects."""
    return scored(spark, d).select("a", "b", "score", "reason", "bridge")


ADMIT = f"CASE WHEN reason IS NULL AND score >= {GRAY} THEN 'rule' WHEN sim >= {NEAR} THEN 'vector' END"
ADMITTED = f"{SCORED}, adm AS (SELECT *, {ADMIT} AS path, CASE WHEN reason IS NULL AND score >= {GRAY} THEN score ELSE CAST(floor(sim * 100 + 0.5) AS INT) END AS priority FROM s4)"


def admitted(spark: SparkSession, d: str) -> DataFrame:
    p = scored(spark, d).withColumn("path", F.expr(ADMIT)).filter("path is not null")
    return p.withColumn("priority", F.expr("case when path = 'rule' then score else cast(floor(sim * 100 + 0.5) as int) end"))


@query(f"WITH {ADMITTED} SELECT a, b, path, priority FROM adm WHERE path IS NOT NULL")
def admitted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs worth judging: by the rule score, else by their vectors."""
    return admitted(spark, d).select("a", "b", "path", "priority")


HASH = "sha256(concat_ws('|', title, summary, coalesce(eventType, ''), coalesce(eventSubject, ''), coalesce(eventAction, ''), coalesce(eventObject, ''), coalesce(eventDate, '')))"


def input_hash() -> Column:
    blank = [F.coalesce(c, F.lit("")) for c in ("eventType", "eventSubject", "eventAction", "eventObject", "eventDate")]
    return F.sha2(F.concat_ws("|", "title", "summary", *blank), 256)


STORED = "stored AS (SELECT id, arg_max(h, (createdAt, h)) AS h FROM (SELECT leftClusterId AS id, leftInputHash AS h, createdAt FROM pair_cache UNION ALL SELECT rightClusterId, rightInputHash, createdAt FROM pair_cache) GROUP BY 1)"


def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Of each cluster the input hash stored last."""
    p = table(spark, d, "pair_cache")
    sides = p.select(F.explode(F.array(*[F.struct(F.col(f"{s}ClusterId").alias("id"), F.col(f"{s}InputHash").alias("h"), "createdAt") for s in ("left", "right")])).alias("x")).select("x.*")
    return sides.groupBy("id").agg(F.max(F.struct("createdAt", "h")).alias("m")).select("id", F.col("m.h").alias("h"))


@query(f"WITH {STORED} SELECT c.id, {HASH} AS hash, h IS NULL AS unseen FROM content_clusters c LEFT JOIN stored USING (id) WHERE h IS NULL OR h <> {HASH}")
def dirty_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose content isn't that of which pairs were computed last."""
    c = table(spark, d, "content_clusters").select("id", input_hash().alias("hash")).join(stored_hashes(spark, d), "id", "left")
    return c.filter("h is null or h <> hash").select("id", "hash", F.col("h").isNull().alias("unseen"))


@query(f"""WITH {STORED} SELECT DISTINCT p.id, p.score, p.bm25Score FROM pair_cache p JOIN stored l ON l.id = leftClusterId AND l.h = leftInputHash JOIN stored r ON r.id = rightClusterId AND r.h = rightInputHash
    WHERE attemptCount < 3 AND (expiresAt IS NULL OR expiresAt > TIMESTAMP '2026-06-29') ORDER BY p.score DESC, p.bm25Score DESC, p.id LIMIT 20""")
def precomputed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best cached pairs that still hold: both inputs unchanged, tried less than three times, not expired."""
    h = stored_hashes(spark, d)
    p = table(spark, d, "pair_cache").filter("attemptCount < 3 and (expiresAt is null or expiresAt > timestamp_ntz'2026-06-29')")
    for s in ("left", "right"):
        p = p.join(h.select(F.col("id").alias(f"{s}ClusterId"), F.col("h").alias(f"{s}InputHash")), [f"{s}ClusterId", f"{s}InputHash"], "left_semi")
    return p.select("id", "score", "bm25Score").distinct().orderBy(F.desc("score"), F.desc("bm25Score"), "id").limit(20)


@query(f"""WITH {ADMITTED}, f AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM content_clusters x JOIN content_clusters y ON x.eventSubject = y.eventSubject AND x.eventObject = y.eventObject AND x.eventType = y.eventType AND x.id < y.id AND coalesce(x.eventAction, '') = coalesce(y.eventAction, '')),
    e AS (SELECT a, b, priority AS score, path FROM adm WHERE path IS NOT NULL UNION ALL SELECT a, b, 100, 'fingerprint' FROM f), m AS (SELECT a, b, max(score) AS score, array_to_string(list_sort(list_distinct(list(path))), '+') AS via FROM e GROUP BY 1, 2),
    s AS (SELECT a AS c, b AS o, score, via FROM m UNION ALL SELECT b, a, score, via FROM m) SELECT c, o, score, via, k FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, o) AS k FROM s) WHERE k <= 3""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's three best partners among admitted pairs and clusters of one event signature; channels of a pair are merged."""
    c = table(spark, d, "content_clusters").filter("eventSubject is not null and eventObject is not null and eventType is not null")
    same = c.select("id", F.concat_ws("\x1f", "eventType", "eventSubject", F.coalesce("eventAction", F.lit("")), "eventObject").alias("sig"))
    e = admitted(spark, d).select("a", "b", F.col("priority").alias("score"), "path").unionByName(pairs_within(same, "sig", "id").select("a", "b", F.lit(100).alias("score"), F.lit("fingerprint").alias("path")))
    m = e.groupBy("a", "b").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("path")), "+").alias("via"))
    s = m.select(F.col("a").alias("c"), F.col("b").alias("o"), "score", "via").unionByName(m.select(F.col("b").alias("c"), F.col("a").alias("o"), "score", "via"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "o"))).filter("k <= 3")


VERDICTS = f"""v AS (SELECT least(leftClusterId, rightClusterId) AS a, greatest(leftClusterId, rightClusterId) AS b, arg_max(relation, (createdAt, id)) AS relation, arg_max(coalesce(reasonCode, ''), (createdAt, id)) AS reasonCode FROM cluster_decisions
    WHERE kind = 'cluster_pair' AND leftClusterId <> rightClusterId GROUP BY 1, 2)"""
NEGATIVE = "(?i)(different|unrelated|conflict|not_same)"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The latest judgement of each pair."""
    dec = table(spark, d, "cluster_decisions").filter("kind = 'cluster_pair' and leftClusterId <> rightClusterId")
    g = dec.groupBy(F.least("leftClusterId", "rightClusterId").alias("a"), F.greatest("leftClusterId", "rightClusterId").alias("b"))
    return g.agg(F.max(F.struct("createdAt", "id", "relation", F.coalesce("reasonCode", F.lit("")).alias("reasonCode"))).alias("m")).select("a", "b", "m.relation", "m.reasonCode")


def _judged_sql() -> str:
    sql = SCORED.replace(CACHED, VERDICTS + ", cached AS (SELECT *, CAST(NULL AS DOUBLE) AS sim FROM v)")
    return sql + f", judged AS (SELECT a, b, CASE WHEN relation = 'same_event' AND (regexp_matches(reasonCode, '{NEGATIVE}') OR safety = 'unrelated_subjects') THEN 'uncertain' ELSE relation END AS relation, safety FROM s4)"


JUDGED = _judged_sql()


def judged(spark: SparkSession, d: str) -> DataFrame:
    p = score_pairs(verdicts(spark, d), table(spark, d, "content_clusters"))
    doubt = (F.col("relation") == "same_event") & (F.col("reasonCode").rlike(NEGATIVE) | (F.coalesce("safety", F.lit("")) == "unrelated_subjects"))
    return p.select("a", "b", F.when(doubt, "uncertain").otherwise(F.col("relation")).alias("relation"), "safety")


@query(f"WITH {JUDGED} SELECT a, b, relation FROM judged")
def consistent_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Latest judgements; an approval whose reason or subjects speak against it counts as uncertain."""
    return judged(spark, d).select("a", "b", "relation")


@query(f"""WITH RECURSIVE {JUDGED}, e AS (SELECT a, b FROM judged WHERE relation = 'same_event'), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.seen),
    comp AS (SELECT id, min(seen) AS g FROM reach GROUP BY 1), bad AS (SELECT DISTINCT x.g FROM judged j JOIN comp x ON x.id = j.a JOIN comp y ON y.id = j.b AND y.g = x.g WHERE j.relation = 'unrelated'),
    t AS (SELECT comp.g, arg_max(comp.id, (itemCount, comp.id)) AS target FROM comp JOIN content_clusters c ON c.id = comp.id WHERE comp.g NOT IN (SELECT g FROM bad) GROUP BY 1)
    SELECT l.b AS source, t.target FROM t JOIN l ON l.a = t.target""")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    """What merges into what: of each component of approved pairs without a rejected one, the direct neighbours of its largest cluster into it."""
    j = materialize(judged(spark, d), "judged")
    e = j.filter("relation = 'same_event'").select("a", "b")
    comp = components(e)
    x = j.filter("relation = 'unrelated'").join(comp.select(F.col("id").alias("a"), F.col("component").alias("ga")), "a").join(comp.select(F.col("id").alias("b"), F.col("component").alias("gb")), "b")
    kept = comp.join(x.filter("ga = gb").select(F.col("ga").alias("component")).distinct(), "component", "left_anti")
    size = table(spark, d, "content_clusters").select("id", "itemCount")
    t = kept.join(size, "id").groupBy("component").agg(F.max(F.struct("itemCount", "id")).alias("m")).select(F.col("m.id").alias("target"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return t.join(both, F.col("target") == F.col("a")).select(F.col("b").alias("source"), "target")


def safe_members(groups: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(target, source) of (target, source, rank): of each target the sources, best rank first, that conflict with none taken before.

    A target's sources are its direct neighbours, ranked; the fold over them stays in the JVM. conflicts holds (a, b), either way round.
    """
    bad = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("source")).agg(F.collect_set("b").alias("bad"))
    g = groups.join(bad, "source", "left").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "source", F.coalesce("bad", F.array().cast("array<string>")).alias("bad")))).alias("all"))
    taken = F.aggregate("all", F.array().cast("array<string>"), lambda kept, x: F.when(F.arrays_overlap(kept, x["bad"]), kept).otherwise(F.array_append(kept, x["source"])))
    return g.select("target", F.explode(taken).alias("source"))


def apply_merge(items: DataFrame, clusters: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and clusters after (source, target) merges: items move, clusters left without items go, and counts are taken anew."""
    moved = items.join(merges.select(F.col("source").alias("clusterId"), "target"), "clusterId", "left").withColumn("clusterId", F.coalesce("target", "clusterId")).drop("target")
    n = moved.filter("clusterId is not null").groupBy(F.col("clusterId").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    gone = merges.select(F.col("source").alias("id"))
    left = clusters.join(gone, "id", "left_anti").join(n, "id", "left").withColumn("itemCount", F.coalesce("_n", F.lit(0))).drop("_n")
    return moved.select(items.columns), left.select(clusters.columns)


MERGES = "m AS (SELECT source, min(target) AS target FROM (SELECT leftClusterId AS source, rightClusterId AS target FROM pair_cache WHERE score >= 80 AND leftClusterId > rightClusterId) GROUP BY 1), once AS (SELECT source, target FROM m WHERE target NOT IN (SELECT source FROM m))"


@query(f"""WITH {ITEMS}, {MERGES}, mv AS (SELECT id, coalesce(target, clusterId) AS clusterId FROM it LEFT JOIN once ON source = clusterId), n AS (SELECT clusterId, count(*) AS n FROM mv GROUP BY 1)
    SELECT c.id, coalesce(n, 0) AS itemCount FROM content_clusters c LEFT JOIN n ON n.clusterId = c.id WHERE c.id NOT IN (SELECT source FROM once)""")
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters after merging each into the least of its well-scored partners that stays."""
    p = table(spark, d, "pair_cache").filter("score >= 80 and leftClusterId > rightClusterId").groupBy(F.col("leftClusterId").alias("source")).agg(F.min("rightClusterId").alias("target"))
    once = p.join(p.select(F.col("source").alias("target")), "target", "left_anti")
    return apply_merge(items_once(spark, d), table(spark, d, "content_clusters"), once)[1].select("id", "itemCount")


@query("""WITH p AS (SELECT DISTINCT id, relation, createdAt, string_split(regexp_replace(lower(pairKey), '\\s+', '', 'g'), '|') AS p FROM cluster_decisions WHERE relation IN ('same_event', 'unrelated')), q AS (SELECT least(p[1], p[2]) AS a, greatest(p[1], p[2]) AS b, * FROM p)
    SELECT a, b, CASE relation WHEN 'same_event' THEN 'must' ELSE 'cannot' END AS kind, min(createdAt) AS since, count(*) AS votes FROM q WHERE a <> b GROUP BY 1, 2, 3""")
def link_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Must-links and cannot-links: one row for each kind and pair, whichever side stood first and however often it was said."""
    p = F.split(F.regexp_replace(F.lower("pairKey"), r"\s+", ""), r"\|")
    q = table(spark, d, "cluster_decisions").filter("relation in ('same_event', 'unrelated')").select("id", "relation", "createdAt", p.alias("p")).distinct()
    q = q.select(F.array_min("p").alias("a"), F.array_max("p").alias("b"), "relation", "createdAt").filter("a <> b")
    return q.groupBy("a", "b", F.when(F.col("relation") == "same_event", "must").otherwise("cannot").alias("kind")).agg(F.min("createdAt").alias("since"), F.count(F.lit(1)).alias("votes"))


@query(f"""WITH {CACHED}, {ITEMS}, no AS (SELECT DISTINCT least(leftClusterId, rightClusterId) AS a, greatest(leftClusterId, rightClusterId) AS b FROM cluster_decisions WHERE relation = 'unrelated' AND leftClusterId IS NOT NULL AND rightClusterId IS NOT NULL),
    pi AS (SELECT x.parentItemId AS p, x.clusterId AS c FROM it x WHERE x.parentItemId IS NOT NULL AND x.clusterId IS NOT NULL), ni AS (SELECT DISTINCT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM pi x JOIN pi y ON x.p = y.p AND x.c <> y.c)
    SELECT a, b FROM cached WHERE NOT EXISTS (SELECT 1 FROM no WHERE no.a = cached.a AND no.b = cached.b) AND NOT EXISTS (SELECT 1 FROM ni WHERE ni.a = cached.a AND ni.b = cached.b)""")
def linkable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cached pairs that no cannot-link forbids: neither one between the clusters, nor one between any two of their items, as which the
    different children of one roundup count. Links of items are brought to their clusters, so no pair of members is made."""
    no = table(spark, d, "cluster_decisions").filter("relation = 'unrelated' and leftClusterId is not null and rightClusterId is not null").select(F.least("leftClusterId", "rightClusterId").alias("a"), F.greatest("leftClusterId", "rightClusterId").alias("b"))
    kids = items_once(spark, d, "parentItemId is not null and clusterId is not null").select("parentItemId", "clusterId").distinct()
    ni = pairs_within(kids, "parentItemId", "clusterId").select("a", "b")
    return cached_pairs(spark, d).select("a", "b").join(no.unionByName(ni).distinct(), ["a", "b"], "left_anti")


CASCADE = f"""{ITEMS}, i AS (SELECT * FROM it WHERE clusterId IS NULL AND status = 'processed'), c AS (SELECT * FROM content_clusters WHERE status = 'active'),
    f AS (SELECT i.id, arg_max(c.id, (c.latestPublishedAt, c.id)) AS c FROM i JOIN c ON c.eventType = i.eventType AND c.eventSubject = i.eventSubject AND coalesce(c.eventAction, '') = coalesce(i.eventAction, '') AND c.eventObject = i.eventObject GROUP BY 1),
    y AS (SELECT i.id, arg_max(c.id, (c.latestPublishedAt, c.id)) AS c FROM i JOIN c ON c.eventSubject = i.eventSubject AND c.eventObject = i.eventObject AND c.eventDate = i.eventDate GROUP BY 1),
    t AS (SELECT i.id, arg_max(c.id, (c.latestPublishedAt, c.id)) AS c FROM i JOIN c ON lower(trim(c.title)) = lower(trim(i.originalTitle)) GROUP BY 1)"""


@query(f"WITH {CASCADE} SELECT i.id, coalesce(f.c, y.c, t.c) AS clusterId, CASE WHEN f.c IS NOT NULL THEN 'fingerprint' WHEN y.c IS NOT NULL THEN 'identity' WHEN t.c IS NOT NULL THEN 'title' WHEN i.eventSubject IS NULL OR i.eventObject IS NULL THEN 'pending' ELSE 'new' END AS how FROM i LEFT JOIN f USING (id) LEFT JOIN y USING (id) LEFT JOIN t USING (id)")
def cluster_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Where each unassigned item goes: the first cluster, newest first, of its fingerprint, else of its identity, else of its title; else
    it waits if its signature is incomplete, or founds a cluster. Each way is one join on its own key."""
    it = items_once(spark, d, "clusterId is null and status = 'processed'")
    c = table(spark, d, "content_clusters").filter("status = 'active'").withColumn("act", F.coalesce("eventAction", F.lit("")))
    it = it.withColumn("act", F.coalesce("eventAction", F.lit(""))).withColumn("t", F.lower(F.trim("originalTitle"))).select("id", "eventType", "eventSubject", "act", "eventObject", "eventDate", "t")
    out = it
    for name, keys, src in (("f", ["eventType", "eventSubject", "act", "eventObject"], c), ("y", ["eventSubject", "eventObject", "eventDate"], c), ("n", ["t"], c.withColumn("t", F.lower(F.trim("title"))))):
        first = src.groupBy(*keys).agg(F.max(F.struct("latestPublishedAt", "id")).alias("m")).select(*keys, F.col("m.id").alias(name))
        out = out.join(first, keys, "left")
    waits = F.col("eventSubject").isNull() | F.col("eventObject").isNull()
    how = F.when(F.col("f").isNotNull(), "fingerprint").when(F.col("y").isNotNull(), "identity").when(F.col("n").isNotNull(), "title").when(waits, "pending").otherwise("new")
    return out.select("id", F.coalesce("f", "y", "n").alias("clusterId"), how.alias("how"))


@query("""WITH a AS (SELECT aliasNormalized AS k, min(e.name) AS n FROM aliases JOIN entities e ON e.id = entityId GROUP BY 1), e AS (SELECT normalized AS k, min(name) AS n FROM entities WHERE normalized IS NOT NULL GROUP BY 1)
    SELECT c.id, coalesce(a1.n, e1.n, eventSubject) AS subject, coalesce(a2.n, e2.n, eventObject) AS object FROM content_clusters c LEFT JOIN a a1 ON a1.k = lower(trim(eventSubject)) LEFT JOIN e e1 ON e1.k = lower(trim(eventSubject)) LEFT JOIN a a2 ON a2.k = lower(trim(eventObject)) LEFT JOIN e e2 ON e2.k = lower(trim(eventObject))""")
def canonical_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with the canonical names of subject and object, as they are scored."""
    ent = table(spark, d, "entities")
    alias = table(spark, d, "aliases").join(ent.select(F.col("id").alias("entityId"), "name"), "entityId").groupBy(F.col("aliasNormalized").alias("k")).agg(F.min("name").alias("a"))
    names = ent.filter("normalized is not null").groupBy(F.col("normalized").alias("k")).agg(F.min("name").alias("e")).join(alias, "k", "full").select("k", F.coalesce("a", "e").alias("n"))
    c = table(spark, d, "content_clusters").select("id", "eventSubject", "eventObject")
    for column, out in (("eventSubject", "subject"), ("eventObject", "object")):
        c = c.withColumn("k", F.lower(F.trim(column))).join(names, "k", "left").withColumn(out, F.coalesce("n", column)).drop("k", "n")
    return c.select("id", "subject", "object")


@query(f"""WITH {VISIBLE}, m AS (SELECT DISTINCT clusterId FROM vis), hit AS (SELECT DISTINCT clusterId FROM vis WHERE createdAt >= TIMESTAMP '2026-06-29') SELECT c.id, c.id IN (SELECT clusterId FROM hit WHERE clusterId IS NOT NULL) AS affected FROM content_clusters c
    WHERE status = 'active' AND latestPublishedAt >= TIMESTAMP '2026-06-23' AND c.id IN (SELECT clusterId FROM m WHERE clusterId IS NOT NULL) ORDER BY affected DESC, latestPublishedAt DESC, c.id LIMIT 2500""")
def merge_window(spark: SparkSession, d: str) -> DataFrame:
    """The clusters that a merge run scans: active, of the last seven days, with a visible member; those with new items first."""
    m = visible(spark, d).filter("clusterId is not null").groupBy(F.col("clusterId").alias("id")).agg(F.bool_or(F.col("createdAt") >= F.lit("2026-06-29").cast("timestamp_ntz")).alias("affected"))
    c = table(spark, d, "content_clusters").filter("status = 'active' and latestPublishedAt >= timestamp_ntz'2026-06-23'").join(m, "id")
    return c.orderBy(F.desc("affected"), F.desc("latestPublishedAt"), "id").limit(2500).select("id", "affected")


FIELDS = ("eventType", "eventSubject", "eventAction", "eventObject", "eventDate")


@query(f"""WITH {VISIBLE}, s AS ({' UNION ALL '.join(f"SELECT clusterId, '{f}' AS field, {f} AS v, qualityScore AS q, createdAt AS t FROM vis" for f in FIELDS)}), g AS (SELECT clusterId, field, v, count(*) AS n, max(q) AS q, max(t) AS t FROM s WHERE v IS NOT NULL AND clusterId IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT clusterId, field, arg_max(v, (n, coalesce(q, -1), t, v)) AS v FROM g GROUP BY 1, 2), a AS (SELECT clusterId, max(coalesce(qualityScore, 0)) AS quality, min(publishedAt) AS first, count(*) AS items FROM vis WHERE clusterId IS NOT NULL GROUP BY 1)
    SELECT clusterId, quality, first, items, {', '.join(f"(SELECT v FROM d WHERE d.clusterId = a.clusterId AND field = '{f}') AS {f}" for f in FIELDS)} FROM a""")
def recomputed_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters anew from their visible items: best quality, first publication, count, and of each part of the signature the commonest
    value, then that of the best item, then of the latest."""
    v = visible(spark, d).filter("clusterId is not null")
    long = v.unpivot(["clusterId", "qualityScore", "createdAt"], list(FIELDS), "field", "v").filter("v is not null")
    g = long.groupBy("clusterId", "field", "v").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("qualityScore"), F.lit(-1)).alias("q"), F.max("createdAt").alias("t"))
    sig = g.groupBy("clusterId").agg(*[F.max(F.when(F.col("field") == f, F.struct("n", "q", "t", "v"))).alias(f) for f in FIELDS]).select("clusterId", *[F.col(f"{f}.v").alias(f) for f in FIELDS])
    a = v.groupBy("clusterId").agg(F.max(F.coalesce("qualityScore", F.lit(0))).alias("quality"), F.min("publishedAt").alias("first"), F.count(F.lit(1)).alias("items"))
    return a.join(sig, "clusterId", "left")

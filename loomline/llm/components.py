"""Consolidate pairwise matches into groups: connected components by randomised graph contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import hot_keys, lookup, materialize


def contract(edges: DataFrame, seed: int = 11) -> DataFrame:
    """(id, component) for every vertex of `edges` (a, b): component is a vertex of the id's group.

    Each round every vertex hooks to the neighbour (or itself) of least hash, under a hash fresh in
    that round; edges are relabelled, loops and repeats dropped, until none is left. The expected
    number of vertices falls by a constant factor per round, so rounds are logarithmic in the
    longest chain. The rounds' maps are then expanded, last first. Nulls and self-links are ignored.
    The thousand vertices of most links are looked up by broadcast, so no hub gathers in one task.
    """
    edges = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    step = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = F.xxhash64("b", F.lit(seed + step))
        hook = both.groupBy("a").agg(F.min(F.struct(h.alias("h"), F.col("b"))).alias("m"), F.count(F.lit(1)).alias("n"))
        own = F.xxhash64("a", F.lit(seed + step))
        hook = materialize(
            hook.select(F.col("a").alias("v"), F.when(own <= F.col("m.h"), F.col("a")).otherwise(F.col("m.b")).alias("r"), "n"), "hooks"
        )
        hot = hot_keys(hook).select("v", "r")
        plain = hook.select("v", "r")
        left = lookup(edges.withColumnRenamed("a", "v"), "v", plain, hot).select(F.col("r").alias("ra"), F.col("b").alias("v"))
        pairs = lookup(left, "v", plain, hot).select("ra", F.col("r").alias("rb")).filter("ra <> rb")
        edges = materialize(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        maps.append(plain)
        step += 1
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    full = maps.pop()
    while maps:
        earlier = maps.pop()
        counts = earlier.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
        hot = full.join(F.broadcast(hot_keys(counts).select(F.col("r").alias("v"))), "v", "left_semi")
        later = full.withColumnRenamed("r", "r2").withColumnRenamed("v", "r")
        joined = lookup(earlier, "r", later, hot.select(F.col("v").alias("r"), F.col("r").alias("r2")))
        full = materialize(joined.select("v", F.coalesce("r2", "r").alias("r")), "expanded")
    return full.select(F.col("v").alias("id"), F.col("r").alias("component"))


def group_ids(edges: DataFrame) -> DataFrame:
    """(clusterId, groupId): every id linked to another, with the least id of its group."""
    full = contract(edges)
    least = full.groupBy("component").agg(F.min("id").alias("groupId"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(least).select("component", "groupId")
    return lookup(full, "component", least.select("component", "groupId"), hot).select(F.col("id").alias("clusterId"), "groupId")


def decision_links(decisions: DataFrame, cache: DataFrame, similarity: float = 0.9) -> DataFrame:
    """Links (a, b): same_event cluster pairs by pairKey, and cached pairs of vector similarity >= 0.9.

    Letter case and white space in keys and ids don't count; malformed keys and nulls give no link.
    """
    clean = lambda c: F.regexp_replace(F.lower(c), r"[\s ]+", "")
    part = F.split(clean(F.col("pairKey")), r"\|")
    judged = decisions.filter("kind = 'cluster_pair' and relation = 'same_event'").select(part.alias("p")).filter(F.size("p") == 2)
    judged = judged.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    near = cache.filter(F.col("vectorSimilarity") >= similarity).select(clean(F.col("leftClusterId")).alias("a"), clean(F.col("rightClusterId")).alias("b"))
    return judged.unionByName(near).filter("a <> '' and b <> '' and a <> b")

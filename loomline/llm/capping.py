"""Cap records per dominant contributor: quality-weighted reservoir sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import materialize


def reservoir_key(score: Column, unit_id: Column, temperature: float, seed: int = 0) -> Column:
    """Key whose largest values a weighted reservoir keeps, weights being exp(score / temperature).

    With u uniform and w the weight, u ** (1 / w) orders as log(w) - log(-log(u)), so the key is
    score / temperature plus Gumbel noise. u comes from a hash of the id, so a recomputed task draws
    the same number. At temperature 0, the limit, noise has no part: the key is the score itself.
    """
    if temperature <= 0:
        return score.cast("double")
    u = (F.pmod(F.xxhash64(unit_id, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return score / F.lit(float(temperature)) - F.log(-F.log(u))


def rank_cut(df: DataFrame, group: list[str], cap: str, levels: list[Column], ties: list[Column]) -> DataFrame:
    """Add `kept`: whether a row is among its group's first `cap` rows by levels, then ties, ascending.

    No group is gathered in one task. Level by level a map-side combined count per (group, digit)
    finds the digit in which the cap is reached; rows below it are kept, rows above it are not, and
    only rows in that one digit go on. A window at last orders the rows that share every digit of a
    group's cut. `levels` must be non-null and of bounded cardinality per group.
    """
    open_rows, done = df.withColumn("_left", F.col(cap).cast("long")), []
    cell: list[str] = []
    for i, level in enumerate(levels):
        d = f"_d{i}"
        open_rows = open_rows.withColumn(d, level)
        keys = [*group, *cell]
        counts = open_rows.groupBy(*keys, d).agg(F.count(F.lit(1)).alias("_n"), F.max("_left").alias("_quota"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(d).rowsBetween(Window.unboundedPreceding, 0))
        cut = counts.withColumn("_upto", upto).select(
            *keys, d, F.when(F.col("_upto") <= F.col("_quota"), 1).when(F.col("_upto") - F.col("_n") >= F.col("_quota"), -1).otherwise(0).alias("_side"),
            (F.col("_quota") - (F.col("_upto") - F.col("_n"))).alias("_rest"))
        named = cut.select(*[F.col(c).alias(f"_c_{c}") for c in [*keys, d]], "_side", "_rest")
        met = F.lit(True)
        for c in [*keys, d]:
            met = met & open_rows[c].eqNullSafe(F.col(f"_c_{c}"))
        judged = open_rows.join(named, met).select(*open_rows.columns, "_side", "_rest")
        done.append(judged.filter("_side <> 0").select(*df.columns, (F.col("_side") == 1).alias("kept")))
        cell.append(d)
        open_rows = judged.filter("_side = 0").withColumn("_left", F.col("_rest")).drop("_side", "_rest")
    rank = F.row_number().over(Window.partitionBy(*group, *cell).orderBy(*ties))
    out = open_rows.withColumn("kept", rank <= F.col("_left")).select(*df.columns, "kept")
    for part in done:
        out = out.unionByName(part)
    return out


def cap_contributors(
    items: DataFrame, share: int = 25, temperature: float = 0.0, seed: int = 0, id_col: str = "id", contributor: str = "sourceId",
    score: str = "qualityScore", created: str = "createdAt",
) -> DataFrame:
    """Per UTC day of `created`, keep at most floor(n / share) records of each contributor, n the day's records.

    Records are taken once per id (the least of a repeated id's rows); contributors are compared in
    lower case without outer white space, a null contributor is a contributor of its own. Scores that are null or
    outside 0..100 rank below all others, as equals. At temperature 0 the order is score, earlier
    creation, smaller id; above 0 it is the weighted reservoir's key. Rows without an id or a
    creation time are no records. Returns (id, day, contributor, kept); an empty input gives no row.
    """
    base = (
        items.select(F.col(id_col).cast("string").alias("id"), F.col(created).alias("at"), F.col(contributor).alias("who"), F.col(score).cast("int").alias("q"))
        .filter(F.col("id").isNotNull() & F.col("at").isNotNull())
        .groupBy("id").agg(F.min(F.struct("at", "who", "q")).alias("r")).select("id", "r.*")
        .select("id", "at", F.to_date("at").alias("day"), F.regexp_replace(F.lower("who"), r"^\s+|\s+$", "").alias("contributor"),
                F.when(F.col("q").between(0, 100), F.col("q")).otherwise(-1).alias("q"))
    )
    base = materialize(base, "capping")
    days = base.groupBy("day", "contributor").agg(F.count(F.lit(1)).alias("m")).groupBy("day").agg(F.floor(F.sum("m") / share).alias("cap"))
    rows = base.join(days, "day")
    if temperature > 0:
        # one digit of 1/64 units of the key (its range is bounded, as a 52-bit uniform is), then the key itself
        key = reservoir_key(F.col("q"), F.col("id"), temperature, seed)
        levels = [(-F.floor(key * 64)).cast("long")]
        ties = [key.desc(), F.col("id").asc()]
    else:
        levels = [-reservoir_key(F.col("q"), F.col("id"), 0.0).cast("int"), F.hour("at") * 60 + F.minute("at")]
        ties = [F.col("at").asc(), F.col("id").asc()]
    return rank_cut(rows, ["day", "contributor"], "cap", levels, ties).select("id", "day", "contributor", "kept")

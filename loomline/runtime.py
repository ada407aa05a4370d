"""Session helpers: table loading, shared-folder materialisation, lookups that survive skew."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many of the heaviest keys are looked up by broadcast; every other key holds under 1/HOT_SHARE of all rows.
HOT_SHARE = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only on local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="loomline-")
    atexit.register(shutil.rmtree, folder[7:], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what runs inside are removed at its end."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: unlike executor-local blocks it outlives executors.

    Files lie under <spark.checkpoint.dir>/<application id>/ and may be removed when the application ends.
    Shuffle files are removed once the table is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    if path.startswith("file://"):
        atexit.register(shutil.rmtree, path[7:], ignore_errors=True)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the tables that `materialize` wrote and `df` reads; nothing that is still to run may read them."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        assert f"/{sc.applicationId}/" in folder
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, count: str = "n") -> DataFrame:
    """The HOT_SHARE rows of the highest counts; any key beyond them holds under 1/HOT_SHARE of all rows."""
    return df.orderBy(F.desc(count)).limit(HOT_SHARE)


def lookup(left: DataFrame, key: str, right: DataFrame, hot: DataFrame, how: str = "left") -> DataFrame:
    """Equi-join `left` to `right` (one row per key) on `key`, whatever the skew of `left`.

    `hot` holds the rows of `right` for the heavy keys, at most HOT_SHARE by construction, and is
    broadcast; all other rows go through a shuffle join. Rows with a null key find no partner.
    """
    value = [c for c in right.columns if c != key]
    h = F.broadcast(hot.select(F.col(key).alias("_hk"), F.struct(*value).alias("_hv")))
    r = right.select(F.col(key).alias("_rk"), F.struct(*value).alias("_rv"))
    # rows that found a hot partner, and null keys, get a scattered key that meets nothing
    spread = F.concat(F.lit("\x00"), F.xxhash64(*left.columns).cast("string"))
    joined = (
        left.join(h, left[key] == F.col("_hk"), "left")
        .withColumn("_jk", F.when(F.col("_hv").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(spread))
        .join(r.withColumn("_rk", F.col("_rk").cast("string")), F.col("_jk") == F.col("_rk"), "left")
        .withColumn("_v", F.coalesce("_hv", "_rv"))
    )
    if how == "inner":
        joined = joined.filter(F.col("_v").isNotNull())
    return joined.select(*[left[c] for c in left.columns], *[F.col(f"_v.{c}").alias(c) for c in value])


def pairs_within(members: DataFrame, group: str, key: str, chunk: int = 2000) -> DataFrame:
    """(group, a, b): each pair of different keys of a group, a < b; keys are unique within a group.

    A group of more than `chunk` keys is cut into parts by hash, and every two of its parts meet under a key of their
    own, so that no task makes more than about chunk squared pairs. Rows with a null group or key pair with nothing.
    """
    m = members.select(group, key).filter(F.col(group).isNotNull() & F.col(key).isNotNull())
    large = m.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk).select(group, F.ceil(F.col("_n") / chunk).cast("int").alias("_parts"))
    m = m.join(large, group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    m = m.withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    x = m.select(group, F.col("_part").alias("_p"), F.col("_other").alias("_o"), F.col(key).alias("a"))
    y = m.select(group, F.col("_other").alias("_p"), F.col("_part").alias("_o"), F.col(key).alias("b"))
    return x.join(y, [group, "_p", "_o"]).filter("a < b").select(group, "a", "b")

"""A durable backlog: micro-batches upsert waiting items and drop completed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.ingest import upsert

SCHEMA = "urlHash string, id string, status string, updatedAt timestamp"


PARTS = 64  # the table is kept in so many parts by hash; a batch rewrites those that it touches


class Backlog:
    """Versions of a part lie side by side under `path`; a batch writes version n + 1 of the parts that it touches, so a lost or
    repeated batch changes nothing, and what it writes grows with the batch. Versions but the last two of a part are dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, part: int) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={part}")
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={part}/{n}/_SUCCESS")))

    def _read(self, parts: list[int], version: int) -> DataFrame:
        """The parts as they were after batch `version`."""
        last = [(p, max((v for v in self._versions(p) if v <= version), default=None)) for p in parts]
        paths = [f"{self.path}/part={p}/v{v}" for p, v in last if v is not None]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self, version: int) -> DataFrame:
        return self._read(list(range(PARTS)), version)

    def batch(self, df: DataFrame, epoch: int) -> None:
        """For foreachBatch: the last state of each hash wins; completed ones leave."""
        part = F.pmod(F.xxhash64("urlHash"), F.lit(PARTS)).cast("int")
        changes = df.filter("urlHash is not null").select("urlHash", "id", "status", F.col("updatedAt").cast("timestamp").alias("updatedAt")).withColumn("part", part).persist()
        touched = sorted(r.part for r in changes.select("part").distinct().collect())  # PARTS at most
        for p in touched:
            new = upsert(self._read([p], epoch - 1), changes.filter(F.col("part") == p).drop("part"), "urlHash", "updatedAt")
            new.filter("status not in ('processed', 'filtered')").write.mode("overwrite").parquet(f"{self.path}/part={p}/v{epoch}")
            for old in [v for v in self._versions(p) if v < epoch][:-1]:
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={p}/v{old}"), True)
        changes.unpersist()

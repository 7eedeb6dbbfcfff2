"""A written table with upserts that rewrite only the parts that change.

Rows lie in partitions by the hash of their key. An upsert reads and writes only the partitions that a new key falls
into, by Spark's dynamic partition overwrite; the files of all others stay as they are. The write is idempotent: if it
is interrupted while partitions are moved into place, running it again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.operators.upserts import upsert

BUCKETS = 64
BUCKET = "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, placed: DataFrame, mode: str) -> None:
        # One task to a partition, so that every partition is one file.
        dealt = placed.repartition(self.buckets, BUCKET)
        writer = dealt.write.mode(mode).partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._placed(rows), "error")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def upsert(self, new: DataFrame) -> list[int]:
        """Rows of ``new`` replace those of the same key or come in; returns the partitions that were rewritten."""
        placed = self._placed(new)
        touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        if touched:
            old = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched))
            self._write(upsert(old, placed.select(*old.columns), self.keys), "overwrite")
        return touched

"""Small helpers the operators share: reading tables, row keys, batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BATCH_ROWS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keeps a batch handed to Python small also where single texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row; equal rows share them, nulls included."""
    present = [F.col(c).isNull().cast("int") for c in columns]
    whole = [F.col(c) for c in columns]
    return [
        F.xxhash64(*whole, *present).alias("_k1"),
        F.xxhash64(F.lit("key"), *reversed(whole), *present).alias("_k2"),
    ]

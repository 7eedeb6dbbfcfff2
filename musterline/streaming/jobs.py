"""Streams run to the end of what is there, and the sinks they write to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterline.cluster import scratch_path
from musterline.sources.events import log_batch


def run_available(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes everything available now, writing each micro-batch once."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: log_batch(batch, batch_id, sink_path))
        .start()
    )
    query.awaitTermination()


def replayed(
    spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None
) -> DataFrame:
    """What a stream has written after one run over its source; with ``keys``, as for update mode,
    only the latest version of each."""
    sink = scratch_path(spark, name)
    run_available(stream, sink, scratch_path(spark, f"{name}-progress"), mode)
    return written(spark, stream, sink, keys)


def written(spark: SparkSession, stream: DataFrame, sink: str, keys: list[str] | None = None) -> DataFrame:
    """What ``run_available`` has put into ``sink``; with ``keys`` the latest version of each."""
    if keys is None:
        return spark.read.schema(stream.schema).parquet(sink)
    log = spark.read.schema(T.StructType([*stream.schema.fields]).add("batch_id", T.LongType())).parquet(sink)
    rest = [c for c in stream.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_latest"))
    return latest.select(*keys, "_latest.*")


def claim_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Events as a queue: the stream's checkpoint gives every file to exactly one micro-batch, so
    workers with separate directories never see the same event."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )

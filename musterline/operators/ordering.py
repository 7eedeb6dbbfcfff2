"""Order-dependent columns over keys that may hold a large share of all rows.

A window over such a key would sort it in one task. These helpers cut the key into ranges of
its order column, work inside the ranges, and carry one row per range across the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: Column, range_width: int, name: str
) -> DataFrame:
    """Adds the last non-null ``value`` before each row; ``order[0]`` must be a bigint.

    With a struct value, which is never null, this is ``lag``.
    """
    ranges = keys + ["_range"]
    ranged = df.withColumn("_range", F.floor(F.col(order[0]) / F.lit(range_width))).withColumn(
        "_value", value
    )
    before = Window.partitionBy(*ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_before", F.last("_value", ignorenulls=True).over(before))

    known = ranged.filter(F.col("_value").isNotNull())
    last_of_range = known.groupBy(*ranges).agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    every_range = ranged.select(*ranges).distinct().join(last_of_range, ranges, "left")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every_range.select(
        *ranges, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    filled = inside.join(carried, ranges, "left")
    return filled.withColumn(name, F.coalesce("_before", "_carried")).drop(
        "_range", "_value", "_before", "_carried"
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], weight: Column, name: str
) -> DataFrame:
    """Adds the running sum of ``weight`` per key in the given order, however large one key is.

    Rows are range-partitioned by key and order, so the parts are even in size; the sum inside a
    part is shifted by the key's sum over earlier parts.
    """
    by = [F.col(k) for k in keys] + order
    parts = df.repartitionByRange(*by).withColumns({"_part": F.spark_partition_id(), "_weight": weight})
    parts = cut_lineage(parts)
    sizes = parts.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    so_far = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_inside", F.sum("_weight").over(so_far))
    return (
        local.join(shifts, keys + ["_part"])
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_weight", "_inside", "_shift")
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, 3, ... per key in the given order."""
    return running_total(df, keys, order, F.lit(1), name)

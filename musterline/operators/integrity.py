"""What changed between two snapshots, and which rows break the rules of the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.functions.scalars import changed


def status_history(old: DataFrame, new: DataFrame, key: str, legacy: bool = False) -> DataFrame:
    """One row per record whose status differs, nulls counting as a value (legacy: ignored)."""
    before = old.select(key, F.col("status").alias("old_status"))
    after = new.select(key, F.col("status").alias("new_status"))
    was, now = F.col("old_status"), F.col("new_status")
    differs = (was != now) if legacy else changed(was, now)
    return before.join(after, key).filter(differs).withColumn("changed_at", F.current_timestamp())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter(F.col("copies") > 1)


def reject_known(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target does not have yet."""
    return new.join(known.select(*keys), keys, "left_anti")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass. A null result is not a violation."""
    counts = df.agg(*[F.count(F.when(~ok, F.lit(1))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that point at a parent which is not there; null points at nothing."""
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")


def foreign_key_report(checks: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Number of orphans per declared key; child keys are counted before they are compared."""
    counted = []
    for name, (child, parent, child_key, parent_key) in checks.items():
        keys = child.groupBy(child_key).agg(F.count(F.lit(1)).alias("_rows"))
        lost = orphans(keys, parent, child_key, parent_key)
        total = F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphans")
        counted.append(lost.agg(total).select(F.lit(name).alias("foreign_key"), "orphans"))
    return reduce(DataFrame.unionByName, counted)


def conflicting_slots(timetable: DataFrame) -> DataFrame:
    """More than one active slot for a section, weekday and period."""
    return duplicate_keys(timetable.filter("is_active"), ["section_id", "day_of_week", "period_id"])


def status_from_duration(duration: Column, status: Column) -> Column:
    """Legacy rule at insert: 45 minutes count as present, anything shorter as absent."""
    return F.when(duration >= 45, "Present").when(duration > 0, "Absent").otherwise(status)

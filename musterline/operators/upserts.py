"""Keyed writes as joins: the result is the new content of the target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.functions.vectors import l2_normalize


def unique_rows(new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` itself, failing the job when two of its rows share a key."""
    rest = [c for c in new.columns if c not in keys]
    grouped = new.groupBy(*keys).agg(
        F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    clash = F.raise_error(F.concat(F.lit("duplicate key in one upsert: "), F.to_json(F.struct(*keys))))
    checked = F.when(F.col("_n") > 1, clash.cast(grouped.schema["_row"].dataType)).otherwise(F.col("_row"))
    return grouped.withColumn("_row", checked).select(*keys, "_row.*").select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; all others stay."""
    fresh = unique_rows(new, keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not there yet; of several with one key the ``first`` wins."""
    rest = [c for c in new.columns if c not in keys]
    order = F.lit(0) if first is None else first
    single = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    single = single.select(*keys, "_row.*").select(*new.columns)
    return old.unionByName(single.join(old.select(*keys), keys, "left_anti"))


def insert_events(events: DataFrame, new: DataFrame, first: Column | None = None) -> DataFrame:
    """Published events; a known event id is ignored and ``matched_at`` defaults to now."""
    stamped = new.withColumn("matched_at", F.coalesce("matched_at", F.current_timestamp()))
    return insert_if_absent(events, stamped, ["event_id"], first)


def replace_events(events: DataFrame, updates: DataFrame, sequence: str) -> DataFrame:
    """Each update rewrites the event with its id, the last by ``sequence`` winning; an update
    without an event is appended. An update without a match time gets the present one."""
    if "matched_at" in updates.columns:
        updates = updates.withColumn("matched_at", F.coalesce("matched_at", F.current_timestamp()))
    rest = [c for c in events.columns if c != "event_id"]
    latest = updates.groupBy("event_id").agg(F.max_by(F.struct(*rest), sequence).alias("_row"))
    latest = latest.select("event_id", "_row.*")
    kept = events.join(latest.select("event_id"), "event_id", "left_anti")
    return kept.unionByName(latest)


def raise_events(events: DataFrame, updates: DataFrame) -> DataFrame:
    """An update counts only when its confidence is strictly higher; unknown ids are ignored.

    Camera and student of the event stay. Of several updates the best one counts, and the first
    by capture time among equals.
    """
    changing = ["confidence", "frame_captured_at", "matched_at", "track_id", "model_version"]
    best = updates.groupBy("event_id").agg(
        F.min_by(
            F.struct(*changing), F.struct((-F.col("confidence")).alias("c"), "frame_captured_at")
        ).alias("_new")
    )
    joined = events.join(best, "event_id", "left")
    better = F.coalesce(F.col("_new.confidence") > F.col("confidence"), F.lit(False))
    now = F.current_timestamp()
    new_value = {c: F.col(f"_new.{c}") for c in changing}
    new_value["matched_at"] = F.coalesce(new_value["matched_at"], now)
    picked = {c: F.when(better, new_value[c]).otherwise(F.col(c)) for c in changing}
    return joined.select(*[picked[c].alias(c) if c in picked else F.col(c) for c in events.columns])


def insert_unresolved(unresolved: DataFrame, new: DataFrame) -> DataFrame:
    return insert_if_absent(unresolved, new, ["detection_id"])


def load_embeddings(gallery: DataFrame, records: DataFrame, source: str = "enrollment") -> DataFrame:
    """Gallery after loading: vectors normalized, known embedding ids ignored."""
    stored = records.withColumn("embedding", l2_normalize(F.col("embedding"))).withColumn(
        "source", F.lit(source)
    )
    return insert_if_absent(gallery, stored.select(*gallery.columns), ["embedding_id"])


def mark_registered(students: DataFrame, records: DataFrame) -> DataFrame:
    """Students with the flag set for everybody who has a loaded embedding."""
    loaded = records.select("student_id").distinct().withColumn("_loaded", F.lit(True))
    flag = F.coalesce("face_registered", F.lit(False)) | F.coalesce("_loaded", F.lit(False))
    return students.join(loaded, "student_id", "left").withColumn("face_registered", flag).drop("_loaded")


def upsert_cameras(old: DataFrame, new: DataFrame) -> DataFrame:
    """Label, source and region are overwritten; every other column keeps its value. A new camera
    is enabled."""
    overwrite = ["location_label", "source_ref", "roi"]
    return _upsert_columns(old, new, "camera_id", overwrite, {"enabled": True})


def upsert_students(old: DataFrame, new: DataFrame) -> DataFrame:
    """By university id: only the name changes, a known student id is kept. A new student is active
    and has no face registered."""
    defaults = {"enrollment_status": "active", "face_registered": False}
    return _upsert_columns(old, new, "university_id", ["full_name"], defaults)


def _upsert_columns(
    old: DataFrame, new: DataFrame, key: str, overwrite: list[str], defaults: dict[str, object]
) -> DataFrame:
    fresh = unique_rows(new, [key]).withColumn("_fresh", F.lit(True))
    known = old.withColumn("_known", F.lit(True))
    joined = known.alias("o").join(fresh.alias("n"), key, "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c not in new.columns:
            absent = F.lit(defaults.get(c)).cast(old.schema[c].dataType)
            return F.when(F.col("_known").isNull(), absent).otherwise(F.col(f"o.{c}")).alias(c)
        incoming, current = F.col(f"n.{c}"), F.col(f"o.{c}")
        take = F.col("_fresh").isNotNull() if c in overwrite else F.col("_known").isNull()
        return F.when(take, incoming).otherwise(current).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def names_for(students: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names of the wanted university ids; unknown ids give no row."""
    named = wanted.select("university_id").distinct()  # an id may be wanted by very many rows
    return students.join(named, "university_id", "left_semi").select(
        "university_id", "full_name"
    )


def resolve_names(wanted: DataFrame, roster: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, missing): roster names win over existing ones; missing are wanted but unnamed."""
    listed = roster.select("university_id", F.col("full_name").alias("_listed"))
    stored = existing.select("university_id", F.col("full_name").alias("_stored"))
    names = listed.join(stored, "university_id", "full_outer").select(
        "university_id", F.coalesce("_listed", "_stored").alias("full_name")
    )
    missing = wanted.select("university_id").distinct().join(names, "university_id", "left_anti")
    return names, missing.orderBy("university_id")


def claim(
    events: DataFrame, students: DataFrame, consumed: DataFrame, batch_size: int = 100
) -> DataFrame:
    """The oldest events by capture time that nobody has consumed yet, with the university id.

    The caller appends the claimed ids to ``consumed``; the next claim is then disjoint.
    """
    open_events = events.join(consumed.select("event_id"), "event_id", "left_anti")
    named = open_events.drop("university_id").join(students.select("student_id", "university_id"), "student_id")
    return named.orderBy("frame_captured_at", "event_id").limit(batch_size)


def consumption_entries(claimed: DataFrame) -> DataFrame:
    return claimed.select("event_id", F.current_timestamp().alias("consumed_at"))

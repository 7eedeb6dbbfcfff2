"""From identification events to marks: class slot, once-only ingest, minutes, and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.functions.scalars import count_where, percentage, seconds_between

# Minutes in the room that make a mark.
PRESENT_MINUTES, LATE_MINUTES = 45, 15


def attribute_to_slots(
    events: DataFrame,
    cameras: DataFrame,
    timetable: DataFrame,
    periods: DataFrame,
    days_off: DataFrame,
) -> DataFrame:
    """Events in the active class slot of the camera's classroom at their weekday and time.

    ``periods(period_id, start_second, end_second)`` in seconds of the day; Monday is day 1;
    ``days_off(day)`` lists holidays and non-working days. The join is an equi-join on classroom
    and weekday, and a classroom has a handful of periods a day.
    """
    rooms = cameras.filter(F.col("classroom_id").isNotNull()).select("camera_id", "classroom_id")
    slots = timetable.filter("is_active").select(
        "timetable_id", "classroom_id", "day_of_week", "period_id"
    ).join(periods.select("period_id", "start_second", "end_second"), "period_id")
    captured = F.col("frame_captured_at")
    timed = events.withColumns(
        {
            "attendance_date": F.to_date(captured),
            "day_of_week": F.weekday(captured) + 1,
            "_second": F.hour(captured) * 3600 + F.minute(captured) * 60 + F.second(captured),
        }
    )
    working = timed.join(days_off.select(F.col("day").alias("attendance_date")), "attendance_date", "left_anti")
    placed = working.join(rooms, "camera_id").join(slots, ["classroom_id", "day_of_week"])
    inside = F.col("_second").between(F.col("start_second"), F.col("end_second"))
    return placed.filter(inside).drop("_second", "start_second", "end_second")


def ingest_once(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events that were never applied, one row per event id."""
    fresh = events.join(ledger.select("event_id"), "event_id", "left_anti")
    return fresh.dropDuplicates(["event_id"])


def ledger_entries(events: DataFrame, attributed: DataFrame) -> DataFrame:
    """What became of each event: its slot, or why it was ignored."""
    applied = attributed.groupBy("event_id").agg(F.min("timetable_id").alias("timetable_id"))
    joined = events.select("event_id").join(applied, "event_id", "left")
    return joined.withColumn(
        "ignored_reason", F.when(F.col("timetable_id").isNull(), F.lit("no class at this time"))
    )


def marks_from_presence(attributed: DataFrame) -> DataFrame:
    """One mark per student, slot and date from the minutes between first and last sighting."""
    seen = attributed.groupBy("student_id", "timetable_id", "attendance_date").agg(
        F.min("frame_captured_at").alias("entry_time"), F.max("frame_captured_at").alias("exit_time")
    )
    minutes = F.floor(seconds_between(F.col("exit_time"), F.col("entry_time")) / 60).cast("int")
    status = (
        F.when(F.col("duration_minutes") >= PRESENT_MINUTES, "present")
        .when(F.col("duration_minutes") >= LATE_MINUTES, "late")
        .otherwise("absent")
    )
    return seen.withColumn("duration_minutes", minutes).withColumn("status", status)


def monthly_summary(records: DataFrame, students: DataFrame, sections: DataFrame) -> DataFrame:
    """Per year, month and section; counted per student before sections are joined."""
    months = records.groupBy(
        "student_id", F.year("attendance_date").alias("year_no"), F.month("attendance_date").alias("month_no")
    ).agg(
        F.count("attendance_id").alias("_records"),
        count_where(F.col("status").isin("present", "late")).alias("_present"),
        count_where(F.col("status") == "absent").alias("_absent"),
    )
    placed = months.join(students.select("student_id", "section_id"), "student_id").join(
        sections.select("section_id", "department_id"), "section_id"
    )
    return placed.groupBy("year_no", "month_no", "department_id", "section_id").agg(
        F.sum("_records").alias("total_classes"),
        F.sum("_present").alias("total_present"),
        F.sum("_absent").alias("total_absent"),
        percentage(F.sum("_present"), F.sum("_records")).alias("attendance_percentage"),
    )


def unknown_occurrences(unresolved: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """How often and when somebody unknown was seen: per person where vectors were kept and
    grouped (``clusters(detection_id, cluster_id)``), otherwise per camera."""
    keys = ["camera_id"]
    if clusters is not None:
        unresolved, keys = unresolved.join(clusters, "detection_id"), ["cluster_id"]
    return unresolved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("frame_captured_at").alias("first_seen"),
        F.max("frame_captured_at").alias("last_seen"),
    )


def event_latencies(events: DataFrame, consumed: DataFrame) -> DataFrame:
    """(stage, ms) samples: capture to event, and event to consumer."""
    joined = events.join(consumed.select("event_id", "consumed_at"), "event_id", "left")
    presence = seconds_between(F.col("matched_at"), F.col("frame_captured_at")) * 1000
    lag = seconds_between(F.col("consumed_at"), F.col("matched_at")) * 1000
    samples = joined.select(
        F.explode(
            F.create_map(F.lit("presence_latency"), presence, F.lit("consumer_lag"), lag)
        ).alias("stage", "ms")
    )
    return samples.filter(F.col("ms").isNotNull())

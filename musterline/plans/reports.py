"""Attendance summaries, alerts and dashboards.

Dimensions are joined without hints: Spark broadcasts those whose size allows it and adaptive
execution splits skewed keys otherwise. Facts are counted per key, combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.functions.scalars import ALERT_BELOW, alert_band, boolean_sum, count_where, percentage
from musterline.operators.keyed_table import KeyedTable
from musterline.operators.upserts import upsert

ATTENDED = ("present", "late")


def _is(*statuses: str) -> Column:
    return F.col("status").isin(*statuses)


def _legacy_percentage(part: str = "status") -> Column:
    present = boolean_sum(F.col(part) == "Present")
    return percentage(present, F.count("attendance_id"))


def subject_summary(records: DataFrame, timetable: DataFrame, legacy: bool = False) -> DataFrame:
    """Per student, subject, year and semester. ``late`` counts as attended and on its own,
    ``excused`` only in the total. The legacy form counts Present alone."""
    slots = timetable.select("timetable_id", "subject_id", "academic_year_id", "semester_id")
    joined = records.select("student_id", "timetable_id", "status").join(slots, "timetable_id")
    attended, absent = (_is("Present"), _is("Absent")) if legacy else (_is(*ATTENDED), _is("absent"))
    total, part = F.count(F.lit(1)), count_where(attended)
    columns = [
        total.alias("total_classes"),
        part.alias("attended_classes"),
        count_where(absent).alias("absent_classes"),
        count_where(_is("late")).alias("late_classes"),
        percentage(part, total).alias("percentage"),
    ]
    if legacy:
        columns.pop(3)
    return joined.groupBy("student_id", "subject_id", "academic_year_id", "semester_id").agg(*columns)


def refresh_subject_summary(old: DataFrame, records: DataFrame, timetable: DataFrame) -> DataFrame:
    """The summary table afterwards. Its key has no year, so two years of one student, subject and
    semester fail the job instead of overwriting each other."""
    fresh = subject_summary(records, timetable).withColumn("last_updated", F.current_timestamp())
    return upsert(old, fresh, ["student_id", "subject_id", "semester_id"])


def daily_summary(
    records: DataFrame, students: DataFrame, sections: DataFrame, date: str, legacy: bool = False
) -> DataFrame:
    """One row per section with students on a date; sections without (active) students are absent.

    The day's records are first counted per student, so the join to the students neither
    multiplies rows nor meets a hot key.
    """
    day = records.filter(F.col("attendance_date") == F.lit(date).cast("date"))
    attended, absent = (_is("Present"), _is("Absent")) if legacy else (_is(*ATTENDED), _is("absent"))
    counts = day.groupBy("student_id").agg(
        F.count("attendance_id").alias("_records"),
        count_where(attended).alias("_present"),
        count_where(absent).alias("_absent"),
        count_where(_is("late")).alias("_late"),
    )
    members = students if legacy else students.filter(F.col("enrollment_status") == "active")
    members = members.select("student_id", "section_id")
    placed = sections.select("department_id", "section_id").join(members, "section_id").join(
        counts, "student_id", "left"
    )
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("_records", "_present", "_absent", "_late")}
    columns = [
        F.count("student_id").alias("total_students"),
        total["_present"].alias("present_count"),
        total["_absent"].alias("absent_count"),
        total["_late"].alias("late_count"),
        percentage(total["_present"], total["_records"]).alias("attendance_percentage"),
    ]
    if legacy:
        columns.pop(3)
    summed = placed.groupBy("department_id", "section_id").agg(*columns)
    return summed.withColumn("attendance_date", F.lit(date).cast("date"))


def refresh_daily_summary(
    old: DataFrame, records: DataFrame, students: DataFrame, sections: DataFrame, date: str
) -> DataFrame:
    fresh = daily_summary(records, students, sections, date)
    return upsert(old, fresh, ["attendance_date", "section_id"])


def defaulter_alerts(summary: DataFrame, legacy: bool = False) -> DataFrame:
    """Banded alerts for summaries below the bound; exactly on it, or unknown, is no alert."""
    low = summary.filter(F.col("percentage") < ALERT_BELOW)
    band = alert_band(F.col("percentage"), legacy).alias("alert_type")
    return low.select("student_id", "subject_id", "semester_id", "percentage", band)


ALERT_KEY = ["student_id", "subject_id", "semester_id"]


def refresh_alerts(old: DataFrame, summary: DataFrame, mode: str = "upsert") -> DataFrame:
    """``upsert`` keeps alerts of students who have recovered; ``replace`` is the legacy wipe, with the legacy
    names of the bands. Where alerts carry ``generated_at``, new and renewed ones get the present time."""
    fresh = defaulter_alerts(summary, legacy=mode == "replace")
    if "generated_at" in old.columns:
        fresh = fresh.withColumn("generated_at", F.current_timestamp())
    return fresh if mode == "replace" else upsert(old, fresh, ALERT_KEY)


def refresh_alert_table(alerts: KeyedTable, summary: DataFrame) -> list[int]:
    """``refresh_alerts`` on a written table keyed by ``ALERT_KEY``: only partitions with a fresh alert are rewritten."""
    return alerts.upsert(defaulter_alerts(summary).withColumn("generated_at", F.current_timestamp()))


def student_attendance(
    records: DataFrame, timetable: DataFrame, subjects: DataFrame, students: DataFrame
) -> DataFrame:
    """Per student and subject. Students without records give one row with an unknown subject;
    subjects of the same name stay apart although their id is not shown.

    Records are counted per student and subject before students are joined.
    """
    slots = timetable.select("timetable_id", "subject_id")
    named = subjects.select("subject_id", "subject_name")
    counted = (
        records.select("student_id", "timetable_id", "attendance_id", "status")
        .join(slots, "timetable_id", "left")
        .join(named, "subject_id", "left")
        .groupBy("student_id", "subject_id", "subject_name")
        .agg(
            F.count("attendance_id").alias("total"),
            F.count(F.when(_is(*ATTENDED), F.col("attendance_id"))).alias("attended"),
        )
    )
    people = students.select("student_id", "university_id", "full_name")
    joined = people.join(counted, "student_id", "left")
    return joined.select(
        "student_id",
        "university_id",
        "full_name",
        "subject_name",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("attended", F.lit(0)).alias("attended"),
        percentage(F.col("attended"), F.col("total")).alias("percentage"),
    )


def legacy_student_attendance(
    records: DataFrame, timetable: DataFrame, subjects: DataFrame, students: DataFrame
) -> DataFrame:
    """The inner-join form: only students with records, Present alone counts."""
    joined = (
        records.join(timetable.select("timetable_id", "subject_id"), "timetable_id")
        .join(subjects.select("subject_id", "subject_name"), "subject_id")
        .groupBy("student_id", "subject_id", "subject_name")
        .agg(
            F.count("attendance_id").alias("total"),
            boolean_sum(F.col("status") == "Present").alias("attended"),
            _legacy_percentage().alias("percentage"),
        )
    )
    return joined.join(students.select("student_id", "university_id", "full_name"), "student_id").drop("subject_id")


def defaulters(attendance: DataFrame) -> DataFrame:
    return attendance.filter(F.col("percentage") < ALERT_BELOW)


def daily_report(
    records: DataFrame, timetable: DataFrame, subjects: DataFrame, sections: DataFrame, legacy: bool = False
) -> DataFrame:
    """Per date, subject and section: present (with late), late and absent."""
    joined = (
        records.select("attendance_date", "timetable_id", "status")
        .join(timetable.select("timetable_id", "subject_id", "section_id"), "timetable_id")
        .join(subjects.select("subject_id", "subject_name"), "subject_id")
        .join(sections.select("section_id", "section_name"), "section_id")
    )
    columns = (
        [
            boolean_sum(F.col("status") == "Present").alias("present"),
            boolean_sum(F.col("status") == "Absent").alias("absent"),
        ]
        if legacy
        else [
            count_where(_is(*ATTENDED)).alias("present"),
            count_where(_is("late")).alias("late"),
            count_where(_is("absent")).alias("absent"),
        ]
    )
    grouped = joined.groupBy("attendance_date", "subject_id", "subject_name", "section_id", "section_name")
    return grouped.agg(*columns).drop("subject_id", "section_id")


def camera_dashboard(cameras: DataFrame, classrooms: DataFrame) -> DataFrame:
    rooms = classrooms.select("classroom_id", "room_number", "block_name")
    return cameras.join(rooms, "classroom_id", "left").select(
        "camera_id", "location_label", "enabled", "room_number", "block_name"
    )


def legacy_camera_dashboard(cameras: DataFrame, classrooms: DataFrame) -> DataFrame:
    """The older dashboard: what a camera is and delivers, and its room where it has one."""
    rooms = classrooms.select("classroom_id", "room_number")
    return cameras.join(rooms, "classroom_id", "left").select(
        "camera_id", "camera_name", "room_number", "status", "ip_address", "resolution", "fps"
    )


def legacy_unknown_faces(unknown: DataFrame, cameras: DataFrame) -> DataFrame:
    """The older list of unknown faces: only those of known cameras, under the camera's name."""
    return unknown.join(cameras.select("camera_id", "camera_name"), "camera_id").select(
        "face_id", "camera_name", "image_path", "confidence", "first_seen", "last_seen", "reviewed"
    )


def unknown_reviews(unresolved: DataFrame, reviews: DataFrame) -> DataFrame:
    joined = unresolved.join(reviews.select("detection_id", "reviewed", "remarks"), "detection_id", "left")
    return joined.select(
        "detection_id",
        "camera_id",
        "frame_captured_at",
        "stage",
        "reason",
        "best_similarity",
        F.coalesce("reviewed", F.lit(False)).alias("reviewed"),
        "remarks",
    )


def detection_summary(recognition_log: DataFrame) -> DataFrame:
    status = F.col("recognition_status")
    return recognition_log.groupBy(F.to_date("detection_time").alias("detection_date")).agg(
        F.count(F.lit(1)).alias("total_detections"),
        boolean_sum(status == "Recognized").alias("recognized"),
        boolean_sum(status == "Unknown").alias("unknown_faces"),
    )


def _records_per_student(records: DataFrame) -> DataFrame:
    return records.groupBy("student_id").agg(
        F.count("attendance_id").alias("_records"), boolean_sum(F.col("status") == "Present").alias("_present")
    )


def class_advisor_dashboard(records: DataFrame, students: DataFrame, sections: DataFrame) -> DataFrame:
    """Per section: students and overall percentage, over all dates."""
    members = students.select("student_id", "section_id")
    placed = sections.select("section_id", "section_name").join(members, "section_id")
    joined = placed.join(_records_per_student(records), "student_id", "left")
    return (
        joined.groupBy("section_id", "section_name")
        .agg(
            F.count("student_id").alias("total_students"),
            percentage(F.sum("_present"), F.sum("_records")).alias("attendance_percentage"),
        )
        .drop("section_id")
    )


def department_dashboard(
    departments: DataFrame, sections: DataFrame, students: DataFrame, staff: DataFrame, records: DataFrame
) -> DataFrame:
    """Per department: students, staff and overall percentage.

    Students and staff are counted on their own branches and joined afterwards. Joining them first
    would repeat every record once per staff member, which changes neither counts nor ratio.
    """
    members = sections.select("section_id", "department_id").join(
        students.select("student_id", "section_id"), "section_id"
    )
    learning = (
        members.join(_records_per_student(records), "student_id", "left")
        .groupBy("department_id")
        .agg(
            F.count("student_id").alias("_students"),
            percentage(F.sum("_present"), F.sum("_records")).alias("overall_percentage"),
        )
    )
    teaching = staff.groupBy("department_id").agg(F.countDistinct("staff_id").alias("_staff"))
    return (
        departments.join(learning, "department_id", "left")
        .join(teaching, "department_id", "left")
        .select(
            "department_name",
            F.coalesce("_students", F.lit(0)).alias("total_students"),
            F.coalesce("_staff", F.lit(0)).alias("total_staff"),
            "overall_percentage",
        )
    )


def live_cameras(cameras: DataFrame, classrooms: DataFrame, camera_status: DataFrame) -> DataFrame:
    """The latest heartbeat of every camera, also of those that never sent one."""
    latest = camera_status.groupBy("camera_id").agg(F.max("checked_at").alias("last_checked"))
    rooms = classrooms.select("classroom_id", "room_number")
    return (
        cameras.join(rooms, "classroom_id", "left")
        .join(latest, "camera_id", "left")
        .select("camera_name", "room_number", "status", "last_checked")
    )


def staff_attendance(
    records: DataFrame, timetable: DataFrame, staff: DataFrame, users: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Records per staff member and subject; counted before names are joined."""
    counted = (
        records.select("timetable_id", "attendance_id")
        .join(timetable.select("timetable_id", "staff_id", "subject_id"), "timetable_id")
        .groupBy("staff_id", "subject_id")
        .agg(F.count("attendance_id").alias("total_records"))
    )
    return _name_staff(counted, staff, users, subjects).select(
        "staff_code", F.col("first_name").alias("staff_name"), "subject_name", "total_records"
    )


def _name_staff(counted: DataFrame, staff: DataFrame, users: DataFrame, subjects: DataFrame) -> DataFrame:
    people = staff.join(users.select("user_id", "first_name"), "user_id").select(
        "staff_id", "staff_code", "first_name"
    )
    return counted.join(people, "staff_id").join(subjects.select("subject_id", "subject_name"), "subject_id")


def staff_subject_report(
    timetable: DataFrame, staff: DataFrame, users: DataFrame, subjects: DataFrame, records: DataFrame
) -> DataFrame:
    """Per staff member and subject, from the timetable: slots without records count as zero
    classes, and their present and absent sums stay unknown."""
    per_slot = records.groupBy("timetable_id").agg(
        F.count("attendance_id").alias("_records"),
        boolean_sum(F.col("status") == "Present").alias("_present"),
        boolean_sum(F.col("status") == "Absent").alias("_absent"),
    )
    slots = timetable.select("timetable_id", "staff_id", "subject_id").join(per_slot, "timetable_id", "left")
    counted = slots.groupBy("staff_id", "subject_id").agg(
        F.coalesce(F.sum("_records"), F.lit(0)).alias("classes_handled"),
        F.sum("_present").alias("total_present"),
        F.sum("_absent").alias("total_absent"),
    )
    return _name_staff(counted, staff, users, subjects).select(
        "staff_code", "first_name", "subject_name", "classes_handled", "total_present", "total_absent"
    )


def student_dashboard(students: DataFrame, users: DataFrame, records: DataFrame) -> DataFrame:
    named = students.join(users.select("user_id", "first_name", "email"), "user_id")
    joined = named.join(_records_per_student(records), "student_id", "left")
    return joined.select(
        "student_id",
        "university_id",
        "first_name",
        "email",
        percentage(F.col("_present"), F.col("_records")).alias("overall_percentage"),
    )


def subject_absentees(
    records: DataFrame, students: DataFrame, users: DataFrame, timetable: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Every absence with its subject and student; the status filter reaches the scan."""
    absent = records.filter(F.col("status") == "Absent").select("student_id", "timetable_id", "attendance_date")
    people = students.join(users.select("user_id", "first_name"), "user_id").select(
        "student_id", "university_id", "first_name"
    )
    return (
        absent.join(timetable.select("timetable_id", "subject_id"), "timetable_id")
        .join(subjects.select("subject_id", "subject_name"), "subject_id")
        .join(people, "student_id")
        .select("subject_name", "university_id", "first_name", "attendance_date")
    )

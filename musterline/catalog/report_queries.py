"""Summaries, alerts, views and legacy dashboards over the whole record table."""

from __future__ import annotations

from pyspark.sql import functions as F

from musterline.catalog.registry import query
from musterline.cluster import scratch_path
from musterline.operators import integrity, marks, upserts
from musterline.operators.keyed_table import KeyedTable
from musterline.plans import reports

DAY = "1998-01-15"


def plain(df, *decimals):
    """Percentages as doubles, as the checking SQL returns them."""
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


def pct(part: str, whole: str) -> str:
    return f"cast(round(cast(100.0 * ({part}) AS DECIMAL(38, 10)) / nullif({whole}, 0), 2) AS DOUBLE)"


HERE = {"here": "('present', 'late')", "away": "('absent')", "tardy": "('late')"}
LEGACY = {"here": "('Present')", "away": "('Absent')"}


def tally(view: str, keys: str, marks: dict[str, str] = HERE, where: str = "true", null_if_unmarked: bool = False) -> str:
    """Marks of a record view counted per key, before any name is attached; without any known mark a
    count is 0, or null if asked."""
    count = "CASE WHEN count(status) > 0 THEN {} END" if null_if_unmarked else "{}"
    counted = ", ".join(
        f"{count.format(f'count(*) FILTER (WHERE status IN {states})')} AS {name}" for name, states in marks.items()
    )
    return f"(SELECT {keys}, count(*) AS n, {counted} FROM {view} WHERE {where} GROUP BY ALL)"


def total(*names: str) -> str:
    return ", ".join(f"cast(sum({name}) AS BIGINT) AS {name}" for name in names)


_SUMMARY = f""", counted AS (
  SELECT student_id, subject_id, academic_year_id, semester_id, {total("n", "here", "away", "tardy")}
  FROM {tally("records", "student_id, timetable_id")} JOIN timetable USING (timetable_id) GROUP BY ALL),
  summary AS (SELECT student_id, subject_id, academic_year_id, semester_id, n AS total_classes, here AS attended_classes,
    away AS absent_classes, tardy AS late_classes, {pct("here", "n")} AS percentage FROM counted)
"""


def _summary(g):
    return reports.subject_summary(g.view("records"), g.view("timetable"))


@query("A02_J06_F21_subject_summary", _SUMMARY + "SELECT * FROM summary", ("records", "timetable"))
def subject_summary(g):
    return plain(_summary(g), "percentage")


@query(
    "A02_legacy_subject_summary",
    f""", counted AS (
      SELECT student_id, subject_id, academic_year_id, semester_id, {total("n", "here", "away")}
      FROM {tally("legacy_records", "student_id, timetable_id", LEGACY)} JOIN timetable USING (timetable_id) GROUP BY ALL)
    SELECT student_id, subject_id, academic_year_id, semester_id, n AS total_classes, here AS attended_classes,
      away AS absent_classes, {pct("here", "n")} AS percentage FROM counted""",
    ("legacy_records", "timetable"),
)
def legacy_subject_summary(g):
    summary = reports.subject_summary(g.view("legacy_records"), g.view("timetable"), legacy=True)
    return plain(summary, "percentage")


@query(
    "A04_F22_defaulter_alerts",
    _SUMMARY
    + """SELECT student_id, subject_id, semester_id, percentage,
           CASE WHEN percentage < 50 THEN 'critical' WHEN percentage < 60 THEN 'below60' ELSE 'below75' END AS alert_type
         FROM summary WHERE percentage < 75""",
    ("records", "timetable"),
)
def defaulter_alerts(g):
    return plain(reports.defaulter_alerts(_summary(g)), "percentage")


@query(
    "U01_A04_alert_upsert",
    _SUMMARY
    + """, fresh AS (SELECT student_id, subject_id, semester_id, percentage,
           CASE WHEN percentage < 50 THEN 'critical' WHEN percentage < 60 THEN 'below60' ELSE 'below75' END AS alert_type
         FROM summary WHERE percentage < 75),
         old AS (SELECT student_id, subject_id, semester_id, 1.0e0 AS percentage, 'critical' AS alert_type
                 FROM summary WHERE late_classes > 0)
         SELECT * FROM fresh UNION ALL
         SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.student_id = old.student_id
           AND f.subject_id = old.subject_id AND f.semester_id = old.semester_id)""",
    ("records", "timetable"),
)
def alert_upsert(g):
    summary = _summary(g)
    old = summary.filter("late_classes > 0").select(
        "student_id",
        "subject_id",
        "semester_id",
        F.lit(1).cast("decimal(5,2)").alias("percentage"),
        F.lit("critical").alias("alert_type"),
    )
    return plain(reports.refresh_alerts(old, summary), "percentage")


@query(
    "U01_A04_alerts_in_a_keyed_table",
    _SUMMARY
    + """, fresh AS (SELECT student_id, subject_id, semester_id, percentage,
           CASE WHEN percentage < 50 THEN 'critical' WHEN percentage < 60 THEN 'below60' ELSE 'below75' END AS alert_type, true AS renewed
         FROM summary WHERE percentage < 75),
         old AS (SELECT student_id, subject_id, semester_id, 1.0e0 AS percentage, 'critical' AS alert_type, false AS renewed
                 FROM summary WHERE late_classes > 0)
         SELECT * FROM fresh UNION ALL
         SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.student_id = old.student_id
           AND f.subject_id = old.subject_id AND f.semester_id = old.semester_id)""",
    ("records", "timetable"),
)
def alerts_in_a_keyed_table(g):
    """The same alerts in a written table, of which only partitions with fresh alerts are rewritten."""
    summary = _summary(g)
    old = summary.filter("late_classes > 0").select(
        *reports.ALERT_KEY,
        F.lit(1).cast("decimal(5,2)").alias("percentage"),
        F.lit("critical").alias("alert_type"),
        F.to_timestamp(F.lit("2020-01-01 00:00:00")).alias("generated_at"),
    )
    table = KeyedTable(g.spark, scratch_path(g.spark, "alerts"), reports.ALERT_KEY, 16)
    table.create(old)
    reports.refresh_alert_table(table, summary)
    renewed = (F.year("generated_at") > 2020).alias("renewed")
    return plain(table.read().select(*reports.ALERT_KEY, "percentage", "alert_type", renewed), "percentage")


@query(
    "A02_U01_refreshed_subject_summary",
    _SUMMARY
    + """, old AS (SELECT student_id, CASE WHEN late_classes > 0 THEN subject_id ELSE -subject_id - 1 END AS subject_id, academic_year_id,
           semester_id, 1 AS total_classes, 1 AS attended_classes, 0 AS absent_classes, 0 AS late_classes, 100.0e0 AS percentage FROM summary)
         SELECT * FROM summary UNION ALL SELECT * FROM old WHERE subject_id < 0""",
    ("records", "timetable"),
)
def refreshed_subject_summary(g):
    """Old rows of the same keys are replaced, those of other keys stay."""
    summary = _summary(g)
    moved = F.when(F.col("late_classes") > 0, F.col("subject_id")).otherwise(-F.col("subject_id") - 1)
    ones = {"total_classes": 1, "attended_classes": 1, "absent_classes": 0, "late_classes": 0}
    old = summary.withColumns(
        {
            "subject_id": moved.cast(summary.schema["subject_id"].dataType),
            "percentage": F.lit(100).cast(summary.schema["percentage"].dataType),
            **{c: F.lit(v).cast("bigint") for c, v in ones.items()},
            "last_updated": F.current_timestamp(),
        }
    )
    refreshed = reports.refresh_subject_summary(old, g.view("records"), g.view("timetable"))
    return plain(refreshed.drop("last_updated"), "percentage")


@query(
    "A04_replaced_alerts",
    _SUMMARY
    + """SELECT student_id, subject_id, semester_id, percentage,
           CASE WHEN percentage < 50 THEN 'Critical' WHEN percentage < 60 THEN 'Below60' ELSE 'Below75' END AS alert_type
         FROM summary WHERE percentage < 75""",
    ("records", "timetable"),
)
def replaced_alerts(g):
    """The wiping refresh: alerts of those who have recovered go."""
    summary = _summary(g)
    old = reports.defaulter_alerts(summary).withColumn("semester_id", F.lit(-1))
    return plain(reports.refresh_alerts(old, summary, mode="replace"), "percentage")


_DAILY = f""", heads AS (SELECT section_id, student_id FROM students WHERE enrollment_status = 'active'),
  counted AS (SELECT section_id, count(DISTINCT student_id) AS heads, coalesce(sum(n), 0) AS n, coalesce(sum(here), 0) AS here,
      coalesce(sum(away), 0) AS away, coalesce(sum(tardy), 0) AS tardy
    FROM heads LEFT JOIN {tally("records", "student_id", where=f"attendance_date = DATE '{DAY}'")} USING (student_id) GROUP BY section_id)
  SELECT DATE '{DAY}' AS attendance_date, department_id, section_id, heads AS total_students, cast(here AS BIGINT) AS present_count,
    cast(away AS BIGINT) AS absent_count, cast(tardy AS BIGINT) AS late_count,
    {pct("cast(here AS BIGINT)", "cast(n AS BIGINT)")} AS attendance_percentage
  FROM counted JOIN sections USING (section_id)"""


@query("A03_J07_G09_daily_summary", _DAILY, ("sections", "students", "records"))
def daily_summary(g):
    summary = reports.daily_summary(g.view("records"), g.view("students"), g.view("sections"), DAY)
    return plain(summary, "attendance_percentage")


@query(
    "A03_U01_refreshed_daily_summary",
    _DAILY.replace("FROM counted JOIN sections USING (section_id)", "FROM counted JOIN sections USING (section_id) UNION ALL\n  SELECT DATE '1990-01-01', department_id, section_id, 1, 1, 0, 0, 100.0e0 FROM sections"),
    ("sections", "students", "records"),
)
def refreshed_daily_summary(g):
    """Another day's rows stay, and the day's own are replaced."""
    columns = ["attendance_date", "department_id", "section_id", "total_students", "present_count", "absent_count", "late_count", "attendance_percentage"]
    fresh = reports.daily_summary(g.view("records"), g.view("students"), g.view("sections"), DAY).select(*columns)

    def all_present(date):
        counts = {"total_students": 1, "present_count": 1, "absent_count": 0, "late_count": 0, "attendance_percentage": 100}
        rows = g.view("sections").withColumns({c: F.lit(v) for c, v in counts.items()})
        rows = rows.withColumn("attendance_date", F.lit(date).cast("date"))
        return rows.select(*[F.col(c).cast(fresh.schema[c].dataType).alias(c) for c in columns])

    old = all_present("1990-01-01").unionByName(
        all_present(DAY).join(fresh.select("section_id"), "section_id", "left_semi").select(*columns)
    )
    views = (g.view(v) for v in ("records", "students", "sections"))
    return plain(reports.refresh_daily_summary(old, *views, DAY).select(*columns), "attendance_percentage")


@query(
    "A03_legacy_daily_summary",
    f""", counted AS (SELECT section_id, count(DISTINCT student_id) AS heads, cast(coalesce(sum(n), 0) AS BIGINT) AS n,
      cast(coalesce(sum(here), 0) AS BIGINT) AS here, cast(coalesce(sum(away), 0) AS BIGINT) AS away
    FROM (SELECT section_id, student_id FROM students)
    LEFT JOIN {tally("legacy_records", "student_id", LEGACY, f"attendance_date = DATE '{DAY}'")} USING (student_id) GROUP BY section_id)
  SELECT DATE '{DAY}' AS attendance_date, department_id, section_id, heads AS total_students, here AS present_count,
    away AS absent_count, {pct("here", "n")} AS attendance_percentage
  FROM counted JOIN sections USING (section_id)""",
    ("sections", "students", "legacy_records"),
)
def legacy_daily_summary(g):
    summary = reports.daily_summary(
        g.view("legacy_records"), g.view("students"), g.view("sections"), DAY, legacy=True
    )
    return plain(summary, "attendance_percentage")


_SUBJECT_OF = "(SELECT timetable_id, subject_id, subject_name FROM timetable JOIN subjects USING (subject_id))"
_ATTENDANCE = f""", facts AS (
  SELECT student_id, subject_id, subject_name, {total("n", "here")}
  FROM {tally("records", "student_id, timetable_id")} LEFT JOIN {_SUBJECT_OF} USING (timetable_id) GROUP BY ALL),
  attendance AS (SELECT student_id, university_id, full_name, subject_name, coalesce(n, 0) AS total, coalesce(here, 0) AS attended,
    {pct("here", "n")} AS percentage
  FROM (SELECT student_id, university_id, full_name FROM students) LEFT JOIN facts USING (student_id))
"""
_STAR = ("students", "records", "timetable", "subjects")


def _attendance(g):
    return reports.student_attendance(*[g.view(v) for v in ("records", "timetable", "subjects", "students")])


@query("A05_J08_student_attendance", _ATTENDANCE + "SELECT * FROM attendance", _STAR)
def student_attendance(g):
    return plain(_attendance(g), "percentage")


@query("A06_defaulters", _ATTENDANCE + "SELECT * FROM attendance WHERE percentage < 75", _STAR)
def defaulters(g):
    return plain(reports.defaulters(_attendance(g)), "percentage")


@query(
    "A05_J09_legacy_student_attendance",
    f""", facts AS (
      SELECT student_id, subject_id, subject_name, {total("n", "here")}
      FROM {tally("legacy_records", "student_id, timetable_id", LEGACY, null_if_unmarked=True)} JOIN {_SUBJECT_OF} USING (timetable_id) GROUP BY ALL)
    SELECT student_id, university_id, full_name, subject_name, n AS total, here AS attended, {pct("here", "n")} AS percentage
    FROM facts JOIN (SELECT student_id, university_id, full_name FROM students) USING (student_id)""",
    ("legacy_records", "students", "timetable", "subjects"),
)
def legacy_student_attendance(g):
    built = reports.legacy_student_attendance(
        *[g.view(v) for v in ("legacy_records", "timetable", "subjects", "students")]
    )
    return plain(built, "percentage")


@query(
    "A07_daily_report",
    f""", counted AS (
      SELECT attendance_date, subject_id, section_id, {total("here", "tardy", "away")}
      FROM {tally("records", "attendance_date, timetable_id")} JOIN timetable USING (timetable_id) GROUP BY ALL)
    SELECT attendance_date, subject_name, section_name, here AS present, tardy AS late, away AS absent
    FROM counted JOIN (SELECT subject_id, subject_name FROM subjects) USING (subject_id)
      JOIN (SELECT section_id, section_name FROM sections) USING (section_id)""",
    ("records", "timetable", "subjects", "sections"),
)
def daily_report(g):
    return reports.daily_report(*[g.view(v) for v in ("records", "timetable", "subjects", "sections")])


@query(
    "A07_F23_legacy_daily_report",
    f""", counted AS (
      SELECT attendance_date, subject_id, section_id, {total("here", "away")}
      FROM {tally("legacy_records", "attendance_date, timetable_id", LEGACY, null_if_unmarked=True)} JOIN timetable USING (timetable_id) GROUP BY ALL)
    SELECT attendance_date, subject_name, section_name, here AS present, away AS absent
    FROM counted JOIN (SELECT subject_id, subject_name FROM subjects) USING (subject_id)
      JOIN (SELECT section_id, section_name FROM sections) USING (section_id)""",
    ("legacy_records", "timetable", "subjects", "sections"),
)
def legacy_daily_report(g):
    views = [g.view(v) for v in ("legacy_records", "timetable", "subjects", "sections")]
    return reports.daily_report(*views, legacy=True)


@query(
    "J10_camera_dashboard",
    """ SELECT camera_id, location_label, enabled,
          (SELECT any_value(room_number) FROM classrooms k WHERE k.classroom_id = own.classroom_id) AS room_number,
          (SELECT any_value(block_name) FROM classrooms k WHERE k.classroom_id = own.classroom_id) AS block_name
        FROM cameras own""",
    ("cameras", "classrooms"),
)
def camera_dashboard(g):
    return reports.camera_dashboard(g.view("cameras"), g.view("classrooms"))


@query(
    "J10_legacy_camera_dashboard",
    """ SELECT camera_id, camera_name, status, concat('10.0.0.', cast(length(camera_id) AS STRING)) AS ip_address, '640x480' AS resolution,
          length(camera_id) * 5 AS fps,
          (SELECT any_value(room_number) FROM classrooms k WHERE k.classroom_id = own.classroom_id) AS room_number
        FROM cameras own""",
    ("cameras", "classrooms"),
)
def legacy_camera_dashboard(g):
    size = F.length("camera_id").cast("bigint")
    delivered = {
        "ip_address": F.concat(F.lit("10.0.0."), size.cast("string")), "resolution": F.lit("640x480"), "fps": size * 5,
    }
    return reports.legacy_camera_dashboard(g.view("cameras").withColumns(delivered), g.view("classrooms"))


@query(
    "J11_legacy_unknown_faces",
    """, met AS (SELECT student_id AS face_id, CASE WHEN cast(student_id AS BIGINT) % 4 = 0 THEN 'removed' ELSE min(camera_id) END AS camera_id,
           concat('faces/', student_id, '.jpg') AS image_path, round(max(confidence), 2) AS confidence,
           min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(*) > 2 AS reviewed
         FROM sightings GROUP BY student_id)
       SELECT face_id, upper(camera_id) AS camera_name, image_path, confidence, first_seen, last_seen, reviewed
       FROM met WHERE camera_id IN (SELECT camera_id FROM cameras)""",
    ("sightings", "cameras"),
)
def legacy_unknown_faces(g):
    met = g.view("sightings").groupBy(F.col("student_id").alias("face_id")).agg(
        F.min("camera_id").alias("camera_id"),
        F.round(F.max("confidence"), 2).alias("confidence"),
        F.min("captured_at").alias("first_seen"),
        F.max("captured_at").alias("last_seen"),
        (F.count(F.lit(1)) > 2).alias("reviewed"),
    )
    gone = F.col("face_id").cast("bigint") % 4 == 0
    met = met.withColumn("camera_id", F.when(gone, "removed").otherwise(F.col("camera_id")))
    met = met.withColumn("image_path", F.concat(F.lit("faces/"), "face_id", F.lit(".jpg")))
    return reports.legacy_unknown_faces(met, g.view("cameras"))


@query(
    "J11_unknown_reviews",
    """ SELECT det_idx AS detection_id, camera_id, captured_at AS frame_captured_at, 'match' AS stage, 'below threshold' AS reason,
        round(detector_score, 6) AS best_similarity, coalesce(p_size > 25, false) AS reviewed, p_name AS remarks
        FROM detections LEFT JOIN part ON det_idx = p_partkey""",
    ("detections",),
)
def unknown_reviews(g):
    unresolved = g.view("detections").select(
        F.col("det_idx").alias("detection_id"),
        "camera_id",
        F.col("captured_at").alias("frame_captured_at"),
        F.lit("match").alias("stage"),
        F.lit("below threshold").alias("reason"),
        F.round("detector_score", 6).alias("best_similarity"),
    )
    reviews = g.table("part").select(
        F.col("p_partkey").alias("detection_id"),
        (F.col("p_size") > 25).alias("reviewed"),
        F.col("p_name").alias("remarks"),
    )
    return reports.unknown_reviews(unresolved, reviews)


@query(
    "A09_class_advisor_dashboard",
    f""", counted AS (
      SELECT section_id, count(DISTINCT student_id) AS heads, {total("n", "here")}
      FROM (SELECT section_id, student_id FROM students) LEFT JOIN {tally("legacy_records", "student_id", LEGACY, null_if_unmarked=True)} USING (student_id)
      GROUP BY section_id)
    SELECT section_name, heads AS total_students, {pct("here", "n")} AS attendance_percentage
    FROM counted JOIN sections USING (section_id)""",
    ("sections", "students", "legacy_records"),
)
def class_advisor_dashboard(g):
    built = reports.class_advisor_dashboard(*[g.view(v) for v in ("legacy_records", "students", "sections")])
    return plain(built, "attendance_percentage")


@query(
    "A10_J12_department_dashboard",
    f""", members AS (SELECT department_id, student_id FROM students JOIN (SELECT section_id, department_id FROM sections) USING (section_id)),
    studying AS (SELECT department_id, count(DISTINCT student_id) AS total_students FROM members GROUP BY 1),
    working AS (SELECT department_id, count(DISTINCT staff_id) AS total_staff FROM staff GROUP BY 1),
    attending AS (SELECT department_id, {total("n", "here")} FROM members
      JOIN {tally("legacy_records", "student_id", LEGACY, null_if_unmarked=True)} USING (student_id) GROUP BY 1)
    SELECT department_name, coalesce(total_students, 0) AS total_students, coalesce(total_staff, 0) AS total_staff,
      {pct("here", "n")} AS overall_percentage
    FROM departments LEFT JOIN studying USING (department_id) LEFT JOIN working USING (department_id)
      LEFT JOIN attending USING (department_id)""",
    ("departments", "sections", "students", "staff", "legacy_records"),
)
def department_dashboard(g):
    views = ("departments", "sections", "students", "staff", "legacy_records")
    return plain(reports.department_dashboard(*[g.view(v) for v in views]), "overall_percentage")


@query(
    "A11_live_cameras",
    """, newest AS (SELECT camera_id, max(checked_at) AS last_checked FROM camera_status GROUP BY camera_id)
        SELECT camera_name, (SELECT any_value(room_number) FROM classrooms k WHERE k.classroom_id = own.classroom_id) AS room_number,
          status, last_checked
        FROM cameras own LEFT JOIN newest USING (camera_id)""",
    ("cameras", "classrooms", "camera_status"),
)
def live_cameras(g):
    return reports.live_cameras(g.view("cameras"), g.view("classrooms"), g.view("camera_status"))


@query(
    "A12_staff_attendance",
    f""", counted AS (
      SELECT staff_id, subject_id, {total("n")} FROM {tally("legacy_records", "timetable_id", LEGACY)}
      JOIN timetable USING (timetable_id) GROUP BY ALL)
    SELECT staff_code, first_name AS staff_name, subject_name, n AS total_records
    FROM counted JOIN (SELECT staff_id, staff_code, first_name FROM staff JOIN users USING (user_id)) USING (staff_id)
      JOIN (SELECT subject_id, subject_name FROM subjects) USING (subject_id)""",
    ("legacy_records", "timetable", "staff", "users", "subjects"),
)
def staff_attendance(g):
    views = ("legacy_records", "timetable", "staff", "users", "subjects")
    return reports.staff_attendance(*[g.view(v) for v in views])


@query(
    "A13_J13_staff_subject_report",
    f""", counted AS (
      SELECT staff_id, subject_id, {total("n", "here", "away")} FROM (SELECT timetable_id, staff_id, subject_id FROM timetable)
      LEFT JOIN {tally("legacy_records", "timetable_id", LEGACY, null_if_unmarked=True)} USING (timetable_id) GROUP BY ALL)
    SELECT staff_code, first_name, subject_name, coalesce(n, 0) AS classes_handled, here AS total_present, away AS total_absent
    FROM counted JOIN (SELECT staff_id, staff_code, first_name FROM staff JOIN users USING (user_id)) USING (staff_id)
      JOIN (SELECT subject_id, subject_name FROM subjects) USING (subject_id)""",
    ("timetable", "staff", "users", "subjects", "legacy_records"),
)
def staff_subject_report(g):
    views = ("timetable", "staff", "users", "subjects", "legacy_records")
    return reports.staff_subject_report(*[g.view(v) for v in views])


@query(
    "A14_student_dashboard",
    f""" SELECT student_id, university_id, first_name, email, {pct("here", "n")} AS overall_percentage
    FROM (SELECT student_id, university_id, first_name, email FROM students JOIN users USING (user_id))
      LEFT JOIN {tally("legacy_records", "student_id", LEGACY, null_if_unmarked=True)} USING (student_id)""",
    ("students", "users", "legacy_records"),
)
def student_dashboard(g):
    built = reports.student_dashboard(*[g.view(v) for v in ("students", "users", "legacy_records")])
    return plain(built, "overall_percentage")


@query(
    "P10_J09_subject_absentees",
    f""", missed AS (SELECT student_id, timetable_id, attendance_date FROM legacy_records WHERE status = 'Absent')
        SELECT subject_name, university_id, first_name, attendance_date
        FROM missed JOIN (SELECT student_id, university_id, first_name FROM students JOIN users USING (user_id)) USING (student_id)
          JOIN {_SUBJECT_OF} USING (timetable_id)""",
    ("legacy_records", "students", "users", "timetable", "subjects"),
)
def subject_absentees(g):
    views = ("legacy_records", "students", "users", "timetable", "subjects")
    return reports.subject_absentees(*[g.view(v) for v in views])


@query(
    "X04_monthly_summary",
    f""" SELECT cast(year(attendance_date) AS INT) AS year_no, cast(month(attendance_date) AS INT) AS month_no, sec.department_id, sec.section_id,
      count(attendance_id) AS total_classes, count(*) FILTER (WHERE status IN ('present', 'late')) AS total_present,
      count(*) FILTER (WHERE status = 'absent') AS total_absent,
      {pct("count(*) FILTER (WHERE status IN ('present', 'late'))", "count(*)")} AS attendance_percentage
    FROM records r JOIN students s ON r.student_id = s.student_id JOIN sections sec ON s.section_id = sec.section_id
    GROUP BY 1, 2, 3, 4""",
    ("records", "students", "sections"),
)
def monthly_summary(g):
    built = marks.monthly_summary(g.view("records"), g.view("students"), g.view("sections"))
    return plain(built, "attendance_percentage")


@query(
    "C01_F26_status_history",
    """, a AS (SELECT student_id, min(status) FILTER (WHERE status <> 'Absent') AS status FROM legacy_records GROUP BY 1),
         b AS (SELECT student_id, min(status) FILTER (WHERE attendance_date > DATE '2000-01-01') AS status
               FROM legacy_records GROUP BY 1)
       SELECT a.student_id, a.status AS old_status, b.status AS new_status FROM a JOIN b ON a.student_id = b.student_id
       WHERE a.status IS DISTINCT FROM b.status""",
    ("legacy_records",),
)
def status_history(g):
    records = g.view("legacy_records")
    old = records.groupBy("student_id").agg(
        F.min(F.when(F.col("status") != "Absent", F.col("status"))).alias("status")
    )
    late = F.col("attendance_date") > F.lit("2000-01-01").cast("date")
    new = records.groupBy("student_id").agg(F.min(F.when(late, F.col("status"))).alias("status"))
    return integrity.status_history(old, new, "student_id").drop("changed_at")


@query(
    "C02_duplicate_marks",
    """ SELECT student_id, timetable_id, attendance_date, count(*) AS copies FROM records
        GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    ("records",),
)
def duplicate_marks(g):
    return integrity.duplicate_keys(g.view("records"), ["student_id", "timetable_id", "attendance_date"])


@query(
    "C03_domain_checks",
    """, counted AS (SELECT count(*) FILTER (WHERE NOT (status IN ('present', 'absent', 'late'))) AS known_status,
          count(*) FILTER (WHERE NOT (attendance_id > 0)) AS positive_id,
          count(*) FILTER (WHERE NOT (year(attendance_date) BETWEEN 1995 AND 2000)) AS year_in_range FROM records)
        SELECT rule, violations FROM counted UNPIVOT (violations FOR rule IN (known_status, positive_id, year_in_range))""",
    ("records",),
)
def domain_checks(g):
    rules = {
        "known_status": F.col("status").isin("present", "absent", "late"),
        "positive_id": F.col("attendance_id") > 0,
        "year_in_range": F.year("attendance_date").between(1995, 2000),
    }
    return integrity.rule_violations(g.view("records"), rules)


@query(
    "C04_foreign_keys",
    """ SELECT 'records_timetable' AS foreign_key, count(*) AS orphans FROM records WHERE timetable_id NOT IN (SELECT timetable_id FROM timetable)
        UNION ALL SELECT 'timetable_staff', count(*) FROM timetable WHERE staff_id NOT IN (SELECT staff_id FROM staff)
        UNION ALL SELECT 'records_active_students', count(*) FROM records WHERE student_id NOT IN
          (SELECT student_id FROM students WHERE enrollment_status = 'active')""",
    ("records", "timetable", "staff", "students"),
)
def foreign_keys(g):
    records, timetable = g.view("records"), g.view("timetable")
    active = g.view("students").filter("enrollment_status = 'active'")
    return integrity.foreign_key_report(
        {
            "records_timetable": (records, timetable, "timetable_id", "timetable_id"),
            "timetable_staff": (timetable, g.view("staff"), "staff_id", "staff_id"),
            "records_active_students": (records, active, "student_id", "student_id"),
        }
    )


@query(
    "C05_conflicting_slots",
    """ SELECT section_id, day_of_week, period_id, count(*) AS copies FROM timetable WHERE is_active
        GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    ("timetable",),
)
def conflicting_slots(g):
    return integrity.conflicting_slots(g.view("timetable"))


@query(
    "C06_legacy_duration_rule",
    """SELECT CASE WHEN l_quantity - 10 >= 45 THEN 'Present' WHEN l_quantity - 10 > 0 THEN 'Absent' ELSE 'Late' END AS status,
              count(*) AS records FROM lineitem GROUP BY 1""",
)
def legacy_duration_rule(g):
    minutes = F.col("l_quantity") - 10
    marked = g.table("lineitem").select(integrity.status_from_duration(minutes, F.lit("Late")).alias("status"))
    return marked.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


@query(
    "J16_insert_if_absent",
    """ SELECT section_id, section_name FROM (
          SELECT section_id, 'kept' AS section_name FROM sections WHERE department_id < 2
          UNION ALL SELECT section_id, section_name FROM sections WHERE department_id >= 2)""",
    ("sections",),
)
def insert_if_absent(g):
    sections = g.view("sections")
    old = sections.filter("department_id < 2").select("section_id", F.lit("kept").alias("section_name"))
    return upserts.insert_if_absent(old, sections.select("section_id", "section_name"), ["section_id"])

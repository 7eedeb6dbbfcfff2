"""Enrollment, sinks, upserts, integrity, reports."""

import json
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at
from musterline.functions import scalars, vectors
from musterline.operators import enrollment, integrity, upserts
from musterline.plans import reports
from musterline.plans.enroll import load_enrollment
from musterline.schemas import (
    FACE_EMBEDDINGS,
    IDENTIFICATION_EVENTS,
    REFERENCE_DETECTIONS,
    STUDENTS,
    UNRESOLVED_DETECTIONS,
)
from musterline.settings import EnrollmentSettings
from musterline.sources import events as sinks
from musterline.sources import files
from test_gate import FRONTAL


def test_student_ids_are_version_5_uuids(spark):
    names = ["2024-001", "ä-1", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    space = uuid.UUID(scalars.STUDENT_NAMESPACE)
    for r in df.select("n", scalars.student_id_for(F.col("n")).alias("id")).collect():
        assert r.id == str(uuid.uuid5(space, r.n))


def test_iso_times(spark):
    df = spark.createDataFrame([(at(0),), (at(0.25),)], "t timestamp")
    assert [r[0] for r in df.select(scalars.iso_utc(F.col("t"))).collect()] == [
        "2026-01-01T00:00:00Z", "2026-01-01T00:00:00.250000Z",
    ]


def test_norm_is_checked(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    with pytest.raises(Exception, match="L2-normalized"):
        df.select(vectors.require_unit(F.col("v"))).collect()
    assert df.select(vectors.l2_normalize(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    with pytest.raises(Exception, match="zero vector"):
        zero.select(vectors.l2_normalize(F.col("v"))).collect()


def test_reference_files(spark, tmp_path):
    for name in ("B/2.jpg", "B/1.PNG", "B/deep/3.jpg", "B/notes.txt", "A.jpg", "B.webp", "C.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    out = files.list_reference_files(spark, str(tmp_path)).orderBy("university_id", "place").collect()
    assert [(r.university_id, r.path.rsplit("/", 1)[1]) for r in out] == [
        ("A", "A.jpg"), ("B", "1.PNG"), ("B", "2.jpg"), ("B", "B.webp"),
    ]
    with pytest.raises(Exception, match="not a directory"):
        files.list_reference_files(spark, str(tmp_path / "A.jpg")).collect()


def test_roster_last_line_wins_across_splits(spark, tmp_path):
    lines = ["university_id,full_name"] + [f" U{i % 50} , Name {i} " for i in range(5000)]
    path = tmp_path / "roster.csv"
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        roster = files.read_roster(spark, str(path))
        got = {r.university_id: r.full_name for r in roster.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"U{i % 50}": f"Name {i}" for i in range(4950, 5000)}


def photo(path, student, readable=True, faces=1, height=120.0):
    box = (0.0, 0.0, 0.8 * height, height)
    return (path, readable, faces, box, 0.9, FRONTAL, 500.0, [0.6, 0.8], "m1", student)


def test_enrollment(spark):
    rows = [
        photo("a/1", "a", readable=False), photo("a/2", "a"), photo("a/3", "a", faces=0), photo("a/4", "a"),
        photo("a/5", "a", faces=2), photo("a/6", "a"), photo("b/1", "b", height=40.0), photo("b/2", "b", faces=3),
    ]
    photos = spark.createDataFrame(rows, REFERENCE_DETECTIONS + ", university_id string")
    done = enrollment.enroll(photos, settings=EnrollmentSettings(max_per_student=2))
    assert done.gallery.count() == 2 and {r.university_id for r in done.gallery.collect()} == {"a"}
    assert {(r.path, r.reject_reason) for r in done.skipped.collect()} == {
        ("a/1", "unreadable image"), ("a/3", "no face detected"),
        ("b/1", "face_height 40px < 100px"), ("b/2", "3 faces detected, expected exactly one"),
    }
    assert [(r.university_id, r.photos) for r in enrollment.not_enrolled(done.photos).collect()] == [("b", 2)]
    lenient = enrollment.enroll(photos, settings=EnrollmentSettings(enforce_quality=False)).gallery
    assert "b" in {r.university_id for r in lenient.collect()}


def test_nothing_is_loaded_while_names_are_missing(spark):
    photos = spark.createDataFrame([photo("a/1", "a"), photo("b/1", "b")], REFERENCE_DETECTIONS + ", university_id string")
    students = spark.createDataFrame([("old-id", "a", "Old", None, "active", False)], STUDENTS)
    gallery = spark.createDataFrame([], FACE_EMBEDDINGS).drop("created_at")
    roster = spark.createDataFrame([("a", "Oviya")], "university_id string, full_name string")
    with pytest.raises(ValueError, match="no full_name for: b"):
        load_enrollment(photos, roster, students, gallery)
    both = roster.union(spark.createDataFrame([("b", "Rithika")], roster.schema))
    stored = load_enrollment(photos, both, students, gallery)
    people = {r.university_id: r for r in stored.students.collect()}
    assert people["a"].student_id == "old-id" and people["a"].full_name == "Oviya"
    assert people["b"].face_registered and people["b"].enrollment_status == "active"
    assert {r.student_id for r in stored.gallery.collect()} == {r.student_id for r in people.values()}


def test_gallery_round_trip(spark, tmp_path):
    rows = [("e1", "s1", "u1", [0.6, 0.8], "m1")]
    schema = "embedding_id string, student_id string, university_id string, embedding array<float>, model_version string"
    files.write_gallery(spark.createDataFrame(rows, schema), str(tmp_path / "g"))
    assert files.read_gallery(spark, str(tmp_path / "g")).first().embedding == pytest.approx([0.6, 0.8])


def test_names(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "university_id string")
    schema = "university_id string, full_name string"
    roster = spark.createDataFrame([("1", "Oviya")], schema)
    existing = spark.createDataFrame([("1", "Old Name"), ("2", "Rithika")], schema)
    names, missing = upserts.resolve_names(ids, roster, existing)
    assert {tuple(r) for r in names.collect()} == {("1", "Oviya"), ("2", "Rithika")} and missing.count() == 0
    assert [r[0] for r in upserts.resolve_names(ids, roster, existing.limit(0))[1].collect()] == ["2"]


def event(event_id, confidence, track=1, matched=None, captured=0.0):
    return (event_id, "s", "u", "cam", confidence, at(captured), matched, "m1", track)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), IDENTIFICATION_EVENTS)


def test_event_lines(spark):
    (line,) = sinks.event_lines(events(spark, event("e1", 0.123456))).collect()
    assert json.loads(line.value) == {
        "event_id": "e1", "student_id": "s", "university_id": "u", "camera_id": "cam", "confidence": 0.1235,
        "frame_captured_at": "2026-01-01T00:00:00Z", "matched_at": None, "model_version": "m1", "track_id": 1,
    }


def test_unresolved_lines_hide_vectors_unless_asked(spark):
    row = ("d1", "cam", at(0), 3, "match", "why", 0.98765, [1.23, 2.0, 3.0, 4.0], 0.5, None, {"a": 1.23456}, "m1", [0.12345678, 0.5])
    df = spark.createDataFrame([row], UNRESOLVED_DETECTIONS)
    plain = json.loads(sinks.unresolved_lines(df).first().value)
    assert "embedding" not in plain and plain["margin"] is None
    assert (plain["detector_score"], plain["box"][0], plain["quality_metrics"]) == (0.9877, 1.2, {"a": 1.2346})
    full = json.loads(sinks.unresolved_lines(df, True).first().value)
    assert full["embedding"] == [0.123457, 0.5]
    none = df.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert "embedding" not in json.loads(sinks.unresolved_lines(none, True).first().value)


def test_replace_appends_what_is_missing_and_raise_does_not(spark):
    stored = events(spark, event("e1", 0.6), event("e2", 0.6))
    updates = events(spark, event("e1", 0.67, 3), event("e9", 0.5, 4))
    replaced = {r.event_id: (r.confidence, r.track_id) for r in upserts.replace_events(stored, updates, "track_id").collect()}
    assert replaced == {"e1": (0.67, 3), "e2": (0.6, 1), "e9": (0.5, 4)}
    raised = {r.event_id: (r.confidence, r.track_id) for r in upserts.raise_events(stored, updates).collect()}
    assert raised == {"e1": (0.67, 3), "e2": (0.6, 1)}
    assert all(r.matched_at for r in upserts.replace_events(stored, updates, "track_id").collect() if r.event_id != "e2")
    equal = upserts.raise_events(stored, events(spark, event("e1", 0.6, 9))).collect()
    assert {r.track_id for r in equal} == {1}


def test_inserts_ignore_known_ids(spark):
    stored = events(spark, event("e1", 0.6))
    out = upserts.insert_events(stored, events(spark, event("e1", 0.9), event("e2", 0.5))).collect()
    assert {(r.event_id, r.confidence) for r in out} == {("e1", 0.6), ("e2", 0.5)}
    assert all(r.matched_at is not None for r in out if r.event_id == "e2")


def test_batches_written_twice_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch_id, batch in ((0, events(spark, event("e1", 0.6))), (1, events(spark, event("e2", 0.6)))):
        for _ in range(2):
            sinks.log_batch(batch, batch_id, path)
    assert sinks.read_log(spark, path, IDENTIFICATION_EVENTS).count() == 2


def test_claims_are_disjoint_and_oldest_first(spark):
    stored = events(spark, *[event(f"e{i}", 0.5, captured=10 - i) for i in range(5)])
    students = spark.createDataFrame([("s", "u")], "student_id string, university_id string")
    consumed = spark.createDataFrame([], "event_id string, consumed_at timestamp")
    first = upserts.claim(stored, students, consumed, 2)
    assert [r.event_id for r in first.collect()] == ["e4", "e3"]
    consumed = consumed.unionByName(upserts.consumption_entries(first))
    assert [r.event_id for r in upserts.claim(stored, students, consumed, 2).collect()] == ["e2", "e1"]


def test_upsert_refuses_duplicate_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in upserts.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(Exception, match="duplicate key"):
        upserts.upsert(old, new.union(new), ["k"]).collect()


def test_status_history_is_null_safe(spark):
    old = spark.createDataFrame([(1, "present"), (2, None), (3, "late"), (4, None)], "id int, status string")
    new = spark.createDataFrame([(1, "absent"), (2, "late"), (3, "late"), (4, None)], "id int, status string")
    assert {r.id for r in integrity.status_history(old, new, "id").collect()} == {1, 2}
    assert {r.id for r in integrity.status_history(old, new, "id", legacy=True).collect()} == {1}


RECORDS = "attendance_id bigint, student_id string, timetable_id bigint, attendance_date date, status string"


@pytest.fixture(scope="module")
def school(spark):
    marks = {"A": "ppppla"[1:], "B": "paax", "C": "pppa", "D": "pppaa", "E": "pa"}
    names = {"p": "present", "l": "late", "a": "absent", "x": "excused"}
    from datetime import date

    rows, n = [], 0
    for student, text in marks.items():
        for day, mark in enumerate(text, 1):
            n += 1
            rows.append((n, student, 1, date(2026, 1, day), names[mark]))
    students = [(s, f"U{s}", s, 1, "active") for s in "ABCDEF"] + [("G", "UG", "G", 1, "withdrawn"), ("H", "UH", "H", 2, "withdrawn")]
    return {
        "records": spark.createDataFrame(rows, RECORDS),
        "timetable": spark.createDataFrame([(1, 10, 2026, 1, 1)], "timetable_id bigint, subject_id bigint, academic_year_id int, semester_id int, section_id int"),
        "subjects": spark.createDataFrame([(10, "Maths")], "subject_id bigint, subject_name string"),
        "students": spark.createDataFrame(students, "student_id string, university_id string, full_name string, section_id int, enrollment_status string"),
        "sections": spark.createDataFrame([(1, 5, "I-A"), (2, 5, "I-B")], "section_id int, department_id int, section_name string"),
    }


def test_subject_summary_and_alerts(school):
    summary = reports.subject_summary(school["records"], school["timetable"])
    got = {r.student_id: r.percentage for r in summary.collect()}
    assert got == {k: Decimal(v) for k, v in {"A": "80.00", "B": "25.00", "C": "75.00", "D": "60.00", "E": "50.00"}.items()}
    alerts = {r.student_id: r.alert_type for r in reports.defaulter_alerts(summary).collect()}
    assert alerts == {"B": "critical", "D": "below75", "E": "below60"}


def test_recovered_students_keep_their_alert(spark, school):
    summary = reports.subject_summary(school["records"], school["timetable"])
    old = reports.defaulter_alerts(summary).withColumn("student_id", F.lit("C")).limit(1)
    assert {r.student_id for r in reports.refresh_alerts(old, summary).collect()} == {"B", "C", "D", "E"}
    assert {r.student_id for r in reports.refresh_alerts(old, summary, "replace").collect()} == {"B", "D", "E"}


def test_two_years_of_one_key_fail_the_refresh(spark, school):
    more = school["timetable"].union(spark.createDataFrame([(2, 10, 2025, 1, 1)], school["timetable"].schema))
    records = school["records"].union(school["records"].limit(1).withColumn("timetable_id", F.lit(2).cast("bigint")))
    summary = reports.refresh_subject_summary(
        reports.subject_summary(records, more).limit(0).withColumn("last_updated", F.current_timestamp()), records, more
    )
    with pytest.raises(Exception, match="duplicate key"):
        summary.collect()


def test_daily_summary(school):
    out = reports.daily_summary(school["records"], school["students"], school["sections"], "2026-01-05").collect()
    assert [(r.section_id, r.total_students, r.present_count, r.absent_count, r.late_count, r.attendance_percentage) for r in out] == [
        (1, 6, 0, 2, 0, Decimal("0.00"))
    ]
    empty = reports.daily_summary(school["records"], school["students"], school["sections"], "2027-01-05").first()
    assert empty.total_students == 6 and empty.attendance_percentage is None


def test_students_without_records_have_no_percentage(school):
    view = reports.student_attendance(*[school[k] for k in ("records", "timetable", "subjects", "students")])
    rows = {r.student_id: r for r in view.collect()}
    assert (rows["F"].total, rows["F"].subject_name, rows["F"].percentage) == (0, None, None)
    assert {r.student_id for r in reports.defaulters(view).collect()} == {"B", "D", "E"}


def test_legacy_duration_rule(spark):
    df = spark.createDataFrame([(50,), (45,), (10,), (0,)], "m int")
    out = df.select(integrity.status_from_duration(F.col("m"), F.lit("?")).alias("s")).collect()
    assert [r.s for r in out] == ["Present", "Present", "Absent", "?"]


def test_many_files_are_laid_out_by_many_tasks(spark, tmp_path):
    """A file for each person and kind, from more than one task however few bytes there are."""
    rows = spark.createDataFrame([(f"u{i}", "x") for i in range(40)], "person string, content string")
    for suffix in ("jpg", "PNG"):
        files.lay_out(rows, str(tmp_path / "photos"), ["person"], suffix)
    listed = files.list_reference_files(spark, str(tmp_path / "photos")).collect()
    assert sorted(r.university_id for r in listed) == sorted(f"person=u{i}" for i in range(40) for _ in range(2))
    assert len({r.path.rsplit("/", 1)[1].split("-")[1] for r in listed}) > 1


def test_photo_files_lie_as_a_csv_writer_lays_them(spark, tmp_path):
    """Also for odd names; and nothing lies beside them, as each file of a local file system costs processes."""
    names = ["u1", "u1", None, "", "a/b", "c=d", "e%f g", "h:i", "é{j}[k]^", "l.m,n"]
    rows = spark.createDataFrame([(n, i % 2, ["x", None, "", 'a "b",c'][i % 4]) for i, n in enumerate(names)], "person string, deep int, content string")

    def laid(root):
        found = [p for p in root.rglob("*") if p.is_file() and p.name != "_SUCCESS" and not p.name.endswith(".crc")]
        return sorted((str(p.parent.relative_to(root)), p.suffix, sorted(p.read_text().splitlines())) for p in found)

    files.lay_out(rows, str(tmp_path / "ours"), ["person", "deep"], "jpg")
    dealt = rows.repartition(4, "person").write.option("extension", "jpg")
    dealt.partitionBy("person", "deep").csv(str(tmp_path / "theirs"))
    assert laid(tmp_path / "ours") == laid(tmp_path / "theirs")
    assert not [p for p in (tmp_path / "ours").rglob("*") if p.is_file() and p.suffix != ".jpg"]
    kept = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(name) for name in kept]
    assert files.list_reference_files(spark, f"file:{tmp_path}/ours").count() == 0
    assert [spark.conf.get(name) for name in kept] == before


def test_names_for_ids_wanted_many_times(spark):
    """Ids wanted by very many rows are told apart before they meet the students."""
    students = spark.createDataFrame([("U1", "Ann"), ("U2", "Bo"), (None, "Cy")], "university_id string, full_name string")
    wanted = spark.range(1000).selectExpr("if(id % 2 = 0, 'U1', null) as university_id")
    found = upserts.names_for(students, wanted)
    assert [tuple(r) for r in found.collect()] == [("U1", "Ann")]
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()

"""The given tables seen as the tables of the presence model.

A view is a relabelling: a source, and one SQL expression per column. Spark and the checking SQL
use the same text, so both sides start from the same rows. ``{us}`` is a timestamp's microseconds
and ``{ts}`` turns microseconds into a timestamp, which the two dialects spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

DIALECTS = {
    "spark": {"us": "unix_micros", "ts": "timestamp_micros"},
    "duckdb": {"us": "epoch_us", "ts": "make_timestamp"},
}
START = 1704067200000000
FRAME_US = 600_000_000

_FRAME = f"cast(floor(({{us}}(ts) - {START}) / {FRAME_US}e0) as bigint)"
_X1 = "((user_id * 53) % 8) * 60 + event_id % 20"
_Y1 = "((user_id * 29) % 4) * 90 + (event_id * 7) % 15"

VIEWS: dict[str, list[tuple[str, dict[str, str]]]] = {
    "records": [
        (
            "lineitem JOIN orders ON l_orderkey = o_orderkey",
            {
                "attendance_id": "l_orderkey * 8 + l_linenumber",
                "student_id": "concat('C', cast(o_custkey as string))",
                "timetable_id": "l_partkey",
                "attendance_date": "cast(l_shipdate as date)",
                "status": "case when l_returnflag = 'N' then 'present' when l_returnflag = 'A' then 'absent' "
                "when l_linestatus = 'F' then 'late' else 'excused' end",
            },
        )
    ],
    "legacy_records": [
        (
            "lineitem JOIN orders ON l_orderkey = o_orderkey",
            {
                "attendance_id": "l_orderkey * 8 + l_linenumber",
                "student_id": "concat('C', cast(o_custkey as string))",
                "timetable_id": "l_partkey",
                "attendance_date": "cast(l_shipdate as date)",
                "status": "case when l_returnflag = 'N' then 'Present' when l_returnflag = 'A' then 'Absent' "
                "when l_linestatus = 'F' then 'Late' else null end",
            },
        )
    ],
    "timetable": [
        (
            "part",
            {
                "timetable_id": "p_partkey",
                "subject_id": "cast(replace(p_brand, 'Brand#', '') as int)",
                "academic_year_id": "1",
                "semester_id": "p_size % 2",
                "section_id": "p_size % 25",
                "staff_id": "cast(p_size as bigint)",
                "classroom_id": "p_size % 5",
                "day_of_week": "p_size % 7 + 1",
                "period_id": "cast(p_partkey % 7 + 1 as int)",
                "is_active": "p_type <> 'ECONOMY'",
            },
        )
    ],
    "class_slots": [
        (
            "(SELECT p_size % 5 AS room, p_size % 7 + 1 AS weekday, cast(p_partkey % 7 + 1 as int) AS period, "
            "min(p_partkey) AS slot, max(p_type) AS kind FROM part GROUP BY 1, 2, 3) AS rooms",
            {
                "timetable_id": "slot",
                "classroom_id": "room",
                "day_of_week": "weekday",
                "period_id": "period",
                "is_active": "kind <> 'ECONOMY'",
            },
        )
    ],
    "subjects": [
        (
            "(SELECT DISTINCT p_brand FROM part) AS brands",
            {
                "subject_id": "cast(replace(p_brand, 'Brand#', '') as int)",
                "subject_name": "concat('Subject ', cast(cast(replace(p_brand, 'Brand#', '') as int) % 10 as string))",
            },
        )
    ],
    "students": [
        (
            "customer",
            {
                "student_id": "concat('C', cast(c_custkey as string))",
                "university_id": "concat('U', cast(c_custkey as string))",
                "full_name": "c_name",
                "section_id": "c_nationkey",
                "user_id": "c_custkey",
                "enrollment_status": "case when c_mktsegment = 'BUILDING' then 'withdrawn' else 'active' end",
            },
        ),
        (
            "supplier",
            {
                "student_id": "concat('S', cast(s_suppkey as string))",
                "university_id": "concat('V', cast(s_suppkey as string))",
                "full_name": "s_name",
                "section_id": "s_nationkey",
                "user_id": "s_suppkey + 1000000000000",
                "enrollment_status": "'active'",
            },
        ),
    ],
    "users": [
        (
            "customer",
            {"user_id": "c_custkey", "first_name": "c_name", "email": "concat(lower(c_name), '@example.org')"},
        ),
        (
            "supplier",
            {
                "user_id": "s_suppkey + 1000000000000",
                "first_name": "s_name",
                "email": "concat(lower(s_name), '@example.org')",
            },
        ),
    ],
    "sections": [
        ("nation", {"section_id": "n_nationkey", "department_id": "n_regionkey", "section_name": "n_name"})
    ],
    "departments": [("region", {"department_id": "r_regionkey", "department_name": "r_name"})],
    "staff": [
        (
            "supplier JOIN nation ON s_nationkey = n_nationkey",
            {
                "staff_id": "s_suppkey",
                "staff_code": "concat('T', cast(s_suppkey as string))",
                "user_id": "s_suppkey + 1000000000000",
                "department_id": "n_regionkey",
            },
        )
    ],
    "classrooms": [
        (
            "region",
            {
                "classroom_id": "r_regionkey",
                "room_number": "concat('R-', cast(r_regionkey as string))",
                "block_name": "r_name",
            },
        )
    ],
    "cameras": [
        (
            "(SELECT DISTINCT event_type FROM events) AS kinds",
            {
                "camera_id": "event_type",
                "camera_name": "upper(event_type)",
                "location_label": "concat('Gate ', event_type)",
                "enabled": "event_type <> 'error'",
                "classroom_id": "case when event_type = 'error' then null else length(event_type) % 5 end",
                "status": "case when event_type = 'error' then 'Offline' else 'Online' end",
                "roi_x2": "case when event_type = 'view' then null else 0.2e0 + length(event_type) / 20e0 end",
            },
        )
    ],
    "sightings": [
        (
            "events",
            {
                "sighting_id": "event_id",
                "camera_id": "event_type",
                "student_id": "cast(user_id as string)",
                "captured_at": "ts",
                "confidence": "value",
            },
        )
    ],
    "detections": [
        (
            "events",
            {
                "camera_id": "event_type",
                "sequence": _FRAME,
                "captured_at": f"{{ts}}({START} + {_FRAME} * {FRAME_US})",
                "frame_height": "480",
                "frame_width": "640",
                "det_idx": "event_id",
                "user_id": "user_id",
                "x1": f"cast({_X1} as double)",
                "y1": f"cast({_Y1} as double)",
                "x2": f"cast({_X1} + 80 + (event_id * 13) % 40 as double)",
                "y2": f"cast({_Y1} + 60 + (event_id * 31) % 90 as double)",
                "detector_score": "0.4e0 + ((event_id * 17) % 60) / 100e0",
                "blur_variance": "20e0 + (event_id * 23) % 100",
                "has_landmarks": "event_id % 5 <> 0",
                "left_x": f"cast({_X1} + 20 as double)",
                "left_y": f"cast({_Y1} + 30 as double)",
                "right_x": f"cast({_X1} + 50 as double)",
                "right_y": f"cast({_Y1} + 30 + (event_id * 3) % 61 - 30 as double)",
                "nose_x": f"cast({_X1} + 25 + event_id % 21 as double)",
                "nose_y": f"cast({_Y1} + 45 as double)",
                "model_version": "case when user_id % 10 = 3 then 'm2' else 'm1' end",
            },
        )
    ],
    "frames": [
        (
            f"(SELECT event_type, {_FRAME} AS seq, count(*) AS n, max(value) AS top FROM events "
            "GROUP BY 1, 2) AS shots",
            {
                "camera_id": "event_type",
                "sequence": "seq",
                "captured_at": f"{{ts}}({START} + seq * {FRAME_US})",
                "height": "case when seq % 1000 < 500 then 480 else 720 end",
                "width": "640",
                "changed_fraction": "top / 10000e0",
            },
        )
    ],
    "stage_samples": [("events", {"stage": "event_type", "ms": "value"})],
    "recognition_log": [
        (
            "events",
            {
                "camera_id": "event_type",
                "student_id": "user_id",
                "detection_time": "ts",
                "recognition_status": "case when event_type = 'error' then null when value >= 20 then 'Recognized' "
                "else 'Unknown' end",
            },
        )
    ],
    "camera_status": [
        ("events", {"camera_id": "event_type", "checked_at": "ts", "latency_ms": "value"})
    ],
    "gallery": [
        (
            "embeddings",
            {
                "embedding_id": "cast(vec_id as string)",
                "student_id": "cast(label as string)",
                "university_id": "concat('U', cast(label as string))",
                "embedding": "embedding",
                "model_version": "case when label >= 0 then 'm1' else 'm0' end",
            },
        )
    ],
}


def text_of(view: str, dialect: str) -> str:
    """The view as one SELECT in a dialect; aggregates inside sources see the same dialect."""
    words = DIALECTS[dialect]
    parts = []
    for source, columns in VIEWS[view]:
        listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
        parts.append(f"SELECT {listed} FROM {source}")
    text = " UNION ALL ".join(parts)
    for word, spelled in words.items():
        text = text.replace("{" + word + "}", spelled)
    return text


def with_views(*views: str) -> str:
    """The head of a checking query: the named views as common table expressions."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({text_of(v, 'duckdb')})" for v in views) + " "


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


class Given:
    """The given tables of one scale, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A given table; its times carry no zone and are taken as UTC."""
        read = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoned = {
            f.name: F.col(f.name).cast("timestamp")
            for f in read.schema.fields
            if isinstance(f.dataType, TimestampNTZType)
        }
        return read.withColumns(zoned) if zoned else read

    def spread_table(self, name: str) -> DataFrame:
        """The table over all cores where its files have fewer splits than that, as the small
        scales do; at size it is read as it lies."""
        read, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return read.repartition(cores) if read.rdd.getNumPartitions() < cores else read

    def view(self, name: str, spread: bool = False) -> DataFrame:
        """A view; ``spread`` is for work that is heavy per row."""
        text = text_of(name, "spark")
        read = self.spread_table if spread else self.table
        used = {t: read(t) for t in TABLES if t in text}
        for table in used:
            text = _stand_in(text, table)
        return self.spark.sql(text, **used)


def _stand_in(text: str, table: str) -> str:
    """Table names become placeholders that the session fills with DataFrames."""
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table} ", f"{word} {{{table}}} ")
        if text.endswith(f"{word} {table}"):
            text = text[: -len(table)] + f"{{{table}}}"
        text = text.replace(f"{word} {table})", f"{word} {{{table}}})")
    return text

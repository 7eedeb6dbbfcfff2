"""Physical plans: no cartesian joins, filters and columns pushed into the scans."""

import os
import re

import pytest

import __spark_entry__ as entry_points
from musterline.catalog.inputs import Given
from musterline.plans.reports import subject_absentees

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")

LAZY = [
    name
    for name in sorted(QUERIES)
    if name.split("_")[0] in {f"A{i:02d}" for i in range(1, 15)} | {"P10", "X04", "J08", "C01", "C02", "C04", "U01", "W02", "J01", "P08", "T03"}
]


def plan_of(spark, name, capsys):
    df = QUERIES[name](spark, FOLDER)
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_joins(spark, capsys, name):
    plan = plan_of(spark, name, capsys)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_summary_reads_only_its_columns(spark, capsys):
    plan = plan_of(spark, "A02_J06_F21_subject_summary", capsys)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = next(s for s in schemas if "l_orderkey" in s)
    assert {c.split(":")[0] for c in lineitem.split(",")} == {"l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"}


def test_absentee_filter_reaches_the_scan(spark, capsys, tmp_path):
    given = Given(spark, FOLDER)
    given.view("legacy_records").write.parquet(str(tmp_path / "records"))
    stored = spark.read.parquet(str(tmp_path / "records"))
    views = [given.view(v) for v in ("students", "users", "timetable", "subjects")]
    subject_absentees(stored, *views).explain("formatted")
    assert "EqualTo(status,Absent)" in capsys.readouterr().out


def test_day_filter_reaches_the_scan(spark, capsys):
    plan = plan_of(spark, "A03_J07_G09_daily_summary", capsys)
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", plan)


def test_top_k_is_limited_before_the_shuffle(spark, capsys):
    plan = plan_of(spark, "J01_W01_nearest_embeddings", capsys)
    assert plan.count("WindowGroupLimit") >= 2


def test_large_sides_are_not_broadcast_without_a_check(spark, capsys):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("A02_J06_F21_subject_summary", "A05_J08_student_attendance", "A10_J12_department_dashboard"):
            assert "BroadcastHashJoin" not in plan_of(spark, name, capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

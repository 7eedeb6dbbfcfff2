"""Streams give what batches give, however the input is split."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import at
from musterline.operators.debounce import DebounceStep, debounce
from musterline.operators.tracking import FrameStep, assign_tracks
from musterline.plans.identify import decide_faces, flat_faces
from musterline.settings import PipelineSettings, TrackingSettings
from musterline.streaming import jobs, stateful
from test_folds import DETECTED, clip, judged_rows

SIGHTINGS = "sighting_id bigint, camera_id string, student_id string, captured_at timestamp, confidence double"


def in_files(df, order, parts, path):
    """Writes the rows in order as files of increasing age, one per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("parts", [1, 4])
def test_debounce_stream_equals_batch(spark, tmp_path, parts):
    stateful.use_rocksdb(spark)
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([0.5, 2, 11, 33])
        rows.append((i, rng.choice("xy"), rng.choice("AB"), at(t), round(rng.random(), 3)))
    df = spark.createDataFrame(rows, SIGHTINGS)
    path = str(tmp_path / "in")
    in_files(df, "sighting_id", parts, path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.replayed(spark, stateful.stream_debounce(source, 30.0), "debounce-test")
    columns = ["sighting_id", "action", "event_id", "emitted_at"]
    assert set(map(tuple, out.select(columns).collect())) == set(
        map(tuple, debounce(df, 30.0).select(columns).collect())
    )


def test_a_key_is_folded_from_plain_rows():
    """In order, missing times last, with one read and one write of the state."""

    class Kept:
        text, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.text

        def update(self, text):
            self.calls.append("update")
            self.text = text

    columns = ["at", "confidence", "sighting_id", "identity_changed"]
    output = StructType.fromDDL("at bigint, confidence double, sighting_id bigint, identity_changed boolean, " + DebounceStep.adds)
    processor = stateful.FoldProcessor(DebounceStep(10.0), ["at", "sighting_id"], columns, output)
    processor.kept, row, second = Kept(), Row(*columns), 1_000_000
    rows = [row(None, 0.9, 4, True), row(20 * second, float("nan"), 3, False), row(0, 0.5, 1, False), row(second, 0.7, 2, False)]
    done = list(processor.handleInputRows(("a", "x"), iter(rows), None))
    assert [(r.sighting_id, r.action, r.emitted_by) for r in done] == [(1, "emit", 1), (2, "replace", 1), (3, "emit", 3), (4, "emit", 4)]
    assert done[2].confidence is None and Kept.calls == ["get", "update"]
    rest = list(processor.handleInputRows(("a", "x"), iter([row(5, 0.95, 5, True)]), None))
    assert [(r.action, r.emitted_at) for r in rest] == [("emit", 5)]


def test_track_stream_equals_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = clip(5, frames=60)
    df = spark.createDataFrame([(c, f, d, at(f), b) for c, f, d, b, _ in rows], DETECTED)
    path = str(tmp_path / "in")
    for low, high in ((0, 20), (20, 45), (45, 60)):
        df.filter(F.col("sequence").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.replayed(spark, stateful.stream_tracks(source, TrackingSettings()), "tracks-test").collect()
    names = {(r.camera_id, r.sequence, r.det_idx): (r.camera_id, r.born_sequence, r.born_det) for r in out}
    batch = {(r.camera_id, r.sequence, r.det_idx): (r.camera_id, r.track_id) for r in assign_tracks(df).collect()}
    assert len(names) == len(batch)
    pairs = {(names[k], batch[k]) for k in batch}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_decision_stream_equals_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = (
        DETECTED + ", quality struct<passed:boolean>, outcome string, best_student string, best_similarity double"
    )
    rows = [
        (c, f, d, t, b, (p,), None if not p else "matched" if w else "unresolved", w if p else None, s if p else None)
        for c, f, d, t, b, p, w, s in judged_rows(9)
    ]
    settings = TrackingSettings(reconfirm_interval_seconds=1.0, emit_debounce_seconds=12.0)
    judged = spark.createDataFrame(rows, schema)
    flat = flat_faces(judged)
    path = str(tmp_path / "in")
    for low, high in ((0, 70), (70, 71), (71, 200)):
        flat.filter(F.col("sequence").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.replayed(spark, stateful.stream_decisions(source, settings), "decisions-test")
    columns = ["camera_id", "sequence", "det_idx", "decision", "identity_changed", "emitted_at", "emitted_by"]
    batch = decide_faces(judged, PipelineSettings(tracking=settings))
    assert set(map(tuple, out.select(columns).collect())) == set(map(tuple, batch.select(columns).collect()))


def test_ticks_are_final_once_the_watermark_has_passed(spark, tmp_path):
    schema = "camera_id string, sequence bigint, captured_at timestamp, height int, width int"
    rows = [("cam", i, at(i / 10), 480, 640) for i in range(100)]
    path = str(tmp_path / "in")
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.replayed(spark, stateful.stream_latest_per_tick(source, 1.0, "2 seconds"), "ticks-test")
    got = {(r.sequence, r.dropped) for r in out.collect()}
    assert {(9, 9), (39, 9), (69, 9)} <= got and (99, 9) not in got


def test_late_rows_are_told_and_kept(spark, tmp_path):
    stateful.use_rocksdb(spark)
    schema = "camera_id string, sequence bigint, captured_at timestamp"
    parts = [[("a", 0, at(10)), ("a", 1, at(1)), ("b", 2, at(50))], [("a", 3, at(7.9)), ("a", 4, at(8)), ("a", 5, None), ("b", 6, at(47))], [("a", 7, at(9)), ("c", 8, at(0))]]
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.replayed(spark, stateful.stream_lateness(source, "camera_id", "captured_at", 2), "late-test").collect()
    assert sorted((r.sequence, r.late) for r in out) == [(n, n in (3, 6)) for n in range(9)]
    assert {r.sequence: r.captured_at for r in out}[5] is None and {r.sequence: r.captured_at for r in out}[3].microsecond == 900_000

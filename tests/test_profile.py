import pytest

from helpers import at
from musterline.operators.profile import advice, examined_frames, profile
from musterline.operators.sampling import cap_frames, latest_per_tick, motion_gate, sample_frames
from musterline.schemas import DETECTIONS, FRAMES
from musterline.settings import QualitySettings, SamplingSettings
from pyspark.sql import functions as F
from test_gate import FRONTAL

CLIPS = "camera_id string, native_fps double, duration_seconds double"


def frames(spark, n, fps=30.0):
    return spark.createDataFrame([("cam", i, at(i / fps), 480, 640, 1.0) for i in range(n)], FRAMES)


def faces(spark, sequences, height=120.0):
    rows = [("cam", s, at(s / 30), 480, 640, 0, (0.0, 0.0, 0.8 * height, height), 0.95, FRONTAL, 900.0, None, "m1") for s in sequences]
    return spark.createDataFrame(rows, DETECTIONS)


def clip(spark, seconds, fps=30.0):
    return spark.createDataFrame([("cam", fps, seconds)], CLIPS)


def test_stride_sampling(spark):
    kept = [r.sequence for r in sample_frames(frames(spark, 90), F.lit(30.0), 3.0).collect()]
    assert len(kept) == 9 and sorted(kept)[1] == 10


def test_counts(spark):
    n = range(0, 50, 10)
    row = profile(frames(spark, 50), faces(spark, n), clip(spark, 50 / 30)).first()
    assert (row.frames_sampled, row.faces_total, row.faces_passed) == (5, 5, 5)
    assert (row.frames_decoded, row.resolution) == (50, "640x480")


def test_spread_covers_the_clip(spark):
    wide = profile(frames(spark, 360), faces(spark, []), clip(spark, 12.0), max_frames=10).first()
    assert wide.coverage > 0.8 and wide.frames_sampled == 10 and wide.faces_total == 0
    narrow = profile(frames(spark, 360), faces(spark, []), clip(spark, 12.0), max_frames=10, spread=False).first()
    assert narrow.covered_seconds < 4 and narrow.frames_decoded == 101
    short = examined_frames(frames(spark, 90), clip(spark, 3.0), max_frames=20)
    assert short.count() == 9


PROFILED = (
    "camera_id string, frames_sampled bigint, frames_with_faces bigint, faces_total bigint, faces_passed bigint, "
    "face_height_px_p50 double, blur_variance_p50 double, yaw_ratio_p50 double, duration_seconds double, covered_seconds double"
)


def advise(spark, **changes):
    row = dict(
        camera_id="cam", frames_sampled=10, frames_with_faces=10, faces_total=10, faces_passed=10,
        face_height_px_p50=200.0, blur_variance_p50=300.0, yaw_ratio_p50=0.1, duration_seconds=10.0, covered_seconds=9.9,
    )
    row.update(changes)
    df = spark.createDataFrame([tuple(row.values())], PROFILED)
    return {r.rule: r.message for r in advice(df, QualitySettings()).collect()}


def test_advice(spark):
    assert set(advise(spark)) == {"usable"}
    assert set(advise(spark, frames_sampled=0)) == {"no_frames"}
    assert set(advise(spark, faces_total=0)) == {"no_faces"}
    small = advise(spark, face_height_px_p50=55.0)
    assert set(small) == {"faces_too_small"} and "min_face_height_px=44" in small["faces_too_small"]
    assert "=40." in advise(spark, face_height_px_p50=30.0)["faces_too_small"]
    assert set(advise(spark, face_height_px_p50=120.0)) == {"faces_barely_large_enough"}
    part = advise(spark, duration_seconds=38.0, covered_seconds=6.33)
    assert "6.3s of this 38.0s clip" in part["partly_examined"]
    many = advise(spark, faces_passed=0, blur_variance_p50=1.0, yaw_ratio_p50=0.9, frames_with_faces=4)
    assert set(many) == {"all_gated", "blurred", "in_profile", "faces_rare"}


def test_motion_gate_compares_with_the_previous_sampled_frame(spark):
    rows = [("cam", 0, 480, 0.0), ("cam", 10, 480, 0.0), ("cam", 20, 720, 0.0), ("cam", 30, 720, 0.5), ("cam", 40, 720, 0.001)]
    df = spark.createDataFrame(
        [(c, s, at(s), h, 640, m) for c, s, h, m in rows], FRAMES
    )
    moving = SamplingSettings(motion_gate_enabled=True)
    for width in (200_000, 15):
        assert sorted(r.sequence for r in motion_gate(df, moving, width).collect()) == [0, 20, 30]
    assert motion_gate(df, SamplingSettings()).count() == 5


def test_latest_frame_per_tick_and_cap(spark):
    ticks = latest_per_tick(frames(spark, 30, fps=10.0), 1.0).orderBy("tick_start").collect()
    assert [(r.sequence, r.dropped) for r in ticks] == [(9, 9), (19, 9), (29, 9)]
    assert sorted(r.sequence for r in cap_frames(frames(spark, 30), 4).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("bad", [dict(target_fps=0.0), dict(target_fps=31.0)])
def test_settings_reject_values_out_of_range(bad):
    with pytest.raises(ValueError):
        SamplingSettings(**bad)

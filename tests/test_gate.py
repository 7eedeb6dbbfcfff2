import pytest
from pyspark.sql import functions as F

from musterline.operators.gate import assess_quality, roi_filter
from musterline.schemas import DETECTIONS
from musterline.settings import QualitySettings
from helpers import at

FRONTAL = [(41.0, 46.0), (71.0, 46.0), (61.0, 56.0), (46.0, 76.0), (66.0, 76.0)]
PROFILE = [(40.0, 46.0), (70.0, 46.0), (43.0, 61.0), (45.0, 76.0), (65.0, 76.0)]


def face(height=120.0, score=0.9, blur=500.0, landmarks=FRONTAL, box=None):
    box = box or (0.0, 0.0, 0.8 * height, height)
    return ("cam", 0, at(0), 480, 640, 0, box, score, landmarks, blur, None, "m1")


def quality(spark, row, **settings):
    df = spark.createDataFrame([row], DETECTIONS)
    return assess_quality(df, QualitySettings(**settings)).first().quality


def test_good_face_passes(spark):
    result = quality(spark, face())
    assert result.passed and result.reasons == []


@pytest.mark.parametrize(
    "row, settings, key",
    [
        (face(height=40.0), {}, "face_height"),
        (face(blur=0.0), {}, "blur_variance"),
        (face(score=0.3), {}, "detector_score"),
        (face(landmarks=PROFILE), {}, "yaw_ratio"),
    ],
)
def test_each_rule(spark, row, settings, key):
    result = quality(spark, row, **settings)
    assert not result.passed and [r.split(" ")[0] for r in result.reasons] == [key]


def test_all_failing_reasons_in_order_and_all_metrics(spark):
    result = quality(spark, face(height=30.0, blur=0.0, score=0.1))
    assert result.reasons == [
        "detector_score 0.10 < 0.60",
        "face_height 30px < 100px",
        "blur_variance 0.0 < 45.0",
    ]
    assert set(result.metrics) == {
        "detector_score", "face_height_px", "face_width_px", "blur_variance", "yaw_ratio", "roll_degrees",
    }


def test_pose_needs_five_landmarks(spark):
    result = quality(spark, face(landmarks=PROFILE[:3]))
    assert result.passed and "yaw_ratio" not in result.metrics
    assert quality(spark, face(landmarks=None)).passed


def test_bounds_are_inclusive(spark):
    assert quality(spark, face(height=100.0, score=0.6, blur=45.0)).passed


def test_roi_keeps_touching_boxes_and_cameras_without_region(spark):
    faces = spark.createDataFrame(
        [face(box=(0.0, 0.0, 10.0, 10.0)), face(box=(200.0, 150.0, 320.0, 300.0))], DETECTIONS
    )
    schema = "camera_id string, roi array<double>"
    corner = spark.createDataFrame([("cam", [0.0, 0.0, 0.1, 0.1])], schema)
    assert [r.box.x1 for r in roi_filter(faces, corner).collect()] == [0.0]
    assert roi_filter(faces, spark.createDataFrame([("cam", None)], schema)).count() == 2
    assert roi_filter(faces, spark.createDataFrame([("other", [0.0, 0.0, 0.1, 0.1])], schema)).count() == 2


def test_reason_rounding_is_half_even_for_whole_numbers(spark):
    assert "face_height 40px < 100px" in quality(spark, face(height=40.5)).reasons

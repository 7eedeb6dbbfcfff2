"""Region-of-interest filter and quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.cluster import join_small
from musterline.functions.geometry import box_height, box_width, in_roi
from musterline.functions.pose import has_pose, roll_degrees, yaw_ratio
from musterline.functions.scalars import whole_text
from musterline.settings import QualitySettings


def roi_filter(detections: DataFrame, cameras: DataFrame) -> DataFrame:
    """Detections that touch their camera's region; cameras without a region keep all."""
    regions = cameras.select("camera_id", F.col("roi").alias("_roi"))
    joined = join_small(detections, regions, ["camera_id"], "left")
    keep = in_roi(F.col("box"), F.col("_roi"), F.col("frame_height"), F.col("frame_width"))
    return joined.filter(keep).drop("_roi")


def _measured(detections: DataFrame) -> DataFrame:
    """Height and pose as columns, so that rules, texts and metrics share one computation."""
    lm = F.col("landmarks")
    return detections.withColumns(
        {
            "_height": box_height(F.col("box")),
            "_yaw": F.when(has_pose(lm), yaw_ratio(lm)),
            "_roll": F.when(has_pose(lm), roll_degrees(lm)),
        }
    )


def _metrics() -> Column:
    always = {
        "detector_score": F.col("detector_score"),
        "face_height_px": F.col("_height"),
        "face_width_px": box_width(F.col("box")),
        "blur_variance": F.col("blur_variance"),
    }
    with_pose = {**always, "yaw_ratio": F.col("_yaw"), "roll_degrees": F.col("_roll")}

    def as_map(named: dict[str, Column]) -> Column:
        return F.create_map(*[part for name, value in named.items() for part in (F.lit(name), value)])

    return F.when(F.col("_yaw").isNotNull(), as_map(with_pose)).otherwise(as_map(always))


def _rules(settings: QualitySettings) -> list[tuple[Column, Column]]:
    """(failed, reason) of every rule, in a fixed order; pose rules need all five landmarks."""
    score, blur = F.col("detector_score"), F.col("blur_variance")
    height, yaw, roll = F.col("_height"), F.col("_yaw"), F.col("_roll")
    gate = settings.min_face_height_px
    return [
        (
            score < settings.min_detector_score,
            F.format_string(f"detector_score %.2f < {settings.min_detector_score:.2f}", score),
        ),
        (
            height < gate,
            F.concat(F.lit("face_height "), whole_text(height), F.lit(f"px < {gate}px")),
        ),
        (
            blur < settings.min_blur_variance,
            F.format_string(f"blur_variance %.1f < {settings.min_blur_variance:.1f}", blur),
        ),
        (
            yaw > settings.max_yaw_ratio,
            F.format_string(f"yaw_ratio %.2f > {settings.max_yaw_ratio:.2f}", yaw),
        ),
        (
            F.abs(roll) > settings.max_roll_degrees,
            F.concat(F.lit("roll "), whole_text(roll), F.lit(f"deg > {settings.max_roll_degrees:.0f}deg")),
        ),
    ]


def assess_quality(detections: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """Adds ``quality`` = (passed, reasons, metrics) to each detection.

    ``passed`` is decided by the comparisons alone; reason texts are only formed for failures.
    """
    rules = _rules(settings)
    failed = reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for broken, _ in rules])
    texts = F.array(*[F.when(broken, text).otherwise("") for broken, text in rules])
    none = F.array().cast("array<string>")
    measured = _measured(detections).withColumn("_passed", ~failed)
    quality = F.struct(
        F.col("_passed").alias("passed"),
        F.when(F.col("_passed"), none).otherwise(F.array_remove(texts, "")).alias("reasons"),
        _metrics().alias("metrics"),
    )
    return measured.withColumn("quality", quality).drop("_height", "_yaw", "_roll", "_passed")

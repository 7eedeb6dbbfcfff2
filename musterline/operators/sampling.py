"""Which frames are looked at: stride, motion gate, newest per tick, and a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterline.functions.scalars import stride
from musterline.operators.ordering import previous_value
from musterline.settings import SamplingSettings

FRAMES_PER_RANGE = 200_000


def sample_frames(
    frames: DataFrame, native_fps: Column, target_fps: Column | float
) -> DataFrame:
    """Every stride-th frame of a clip whose sequence starts at 0."""
    return frames.filter(F.pmod("sequence", stride(native_fps, target_fps)) == 0)


def motion_gate(
    frames: DataFrame, settings: SamplingSettings, frames_per_range: int = FRAMES_PER_RANGE
) -> DataFrame:
    """Drops still frames. The first frame and a change of frame size always pass.

    ``changed_fraction`` compares with the previous sampled frame, passed or not, so this runs
    after :func:`sample_frames`.
    """
    if not settings.motion_gate_enabled:
        return frames
    size = F.struct("height", "width")
    seen = previous_value(frames, ["camera_id"], ["sequence"], size, frames_per_range, "_previous")
    fresh = F.col("_previous").isNull() | (F.col("_previous") != size)
    moved = F.col("changed_fraction") >= settings.motion_gate_min_fraction
    return seen.filter(fresh | moved).drop("_previous")


def tick_length(fps: float) -> str:
    return f"{round(1_000_000 / fps)} microseconds"


def latest_per_tick(frames: DataFrame, fps: float) -> DataFrame:
    """The newest frame of each 1/fps tick and how many others the tick dropped.

    Works on a batch and, behind a watermark, on a stream.
    """
    newest = F.max_by(F.struct("sequence", "captured_at", "height", "width"), F.struct("captured_at", "sequence"))
    ticks = frames.groupBy("camera_id", F.window("captured_at", tick_length(fps)).alias("tick")).agg(
        newest.alias("_newest"), (F.count(F.lit(1)) - 1).alias("dropped")
    )
    return ticks.select(
        "camera_id", F.col("tick.start").alias("tick_start"), "_newest.*", "dropped"
    )


def cap_frames(frames: DataFrame, max_frames: int, order: str = "sequence") -> DataFrame:
    """The first frames of each camera. The rank limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("camera_id").orderBy(order))
    return frames.withColumn("_rank", rank).filter(F.col("_rank") <= max_frames).drop("_rank")

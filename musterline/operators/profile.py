"""What a clip looks like to the gate, and how long the stages take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterline.cluster import join_small
from musterline.functions.scalars import (
    count_where,
    offset_seconds,
    reason_key,
    span_text,
    spread_fps,
    stride,
    whole_text,
)
from musterline.operators.gate import assess_quality
from musterline.operators.ordering import running_total
from musterline.operators.sampling import motion_gate
from musterline.settings import QualitySettings, SamplingSettings

METRICS = ["face_height_px", "detector_score", "blur_variance", "yaw_ratio"]


def exact_percentiles(samples: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation, however many samples a key or a value has.

    Equal values are counted first; the counts are summed up along a distributed sort, and only
    the two values around each point are read.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, keys, [F.col(value)], F.col("_n"), "_to")
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    joined = join_small(placed, sizes, keys, "inner")

    def holds(position: Column) -> Column:
        return (F.col("_to") >= position) & (F.col("_to") - F.col("_n") < position)

    at = {name: F.lit(p) * (F.col("_rows") - 1) + 1 for name, p in points.items()}
    below = {name: holds(F.floor(x)) for name, x in at.items()}
    above = {name: holds(F.ceil(x)) for name, x in at.items()}
    near = joined.filter(reduce(lambda a, b: a | b, [*below.values(), *above.values()]))
    found = near.groupBy(*keys, "_rows").agg(
        *[F.max(F.when(hit, F.col(value))).alias(f"{name}_below") for name, hit in below.items()],
        *[F.max(F.when(hit, F.col(value))).alias(f"{name}_above") for name, hit in above.items()],
    )
    between = [
        (F.col(f"{n}_below") + (x - F.floor(x)) * (F.col(f"{n}_above") - F.col(f"{n}_below"))).alias(n)
        for n, x in at.items()
    ]
    return found.select(*keys, *between)


def latency_summary(samples: DataFrame) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum per stage."""
    plain = samples.groupBy("stage").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms")
    )
    points = exact_percentiles(samples, ["stage"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return plain.join(points, "stage")


def examined_frames(
    frames: DataFrame,
    clips: DataFrame,
    sampling: SamplingSettings = SamplingSettings(),
    max_frames: int = 20,
    spread: bool = True,
) -> DataFrame:
    """The frames an inspection looks at, plus the first one behind its budget (``place`` is
    ``max_frames + 1``), which shows how far the clip was decoded."""
    described = join_small(frames, clips, ["camera_id"], "inner")
    rate = spread_fps(sampling.target_fps, max_frames, F.col("duration_seconds")) if spread else F.lit(
        float(sampling.target_fps)
    )
    strided = described.filter(F.pmod("sequence", stride(F.col("native_fps"), rate)) == 0)
    seen = motion_gate(strided, sampling)
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy("sequence"))
    return seen.withColumn("place", place).filter(F.col("place") <= max_frames + 1)


def profile(
    frames: DataFrame,
    detections: DataFrame,
    clips: DataFrame,
    quality: QualitySettings = QualitySettings(),
    sampling: SamplingSettings = SamplingSettings(),
    max_frames: int = 20,
    spread: bool = True,
) -> DataFrame:
    """One row per clip. ``clips(camera_id, native_fps, duration_seconds)``.

    The frame budget bounds what one clip contributes, so exact medians are safe here.
    """
    seen = examined_frames(frames, clips, sampling, max_frames, spread)
    offsets = seen.filter(F.col("place") <= max_frames).select(
        "camera_id", "sequence", offset_seconds(F.col("sequence"), F.col("native_fps")).alias("offset")
    )
    faces = assess_quality(detections, quality).select(
        "camera_id",
        "sequence",
        F.col("quality.passed").alias("passed"),
        *[F.col("quality.metrics")[m].alias(m) for m in METRICS],
    )
    joined = offsets.join(faces, ["camera_id", "sequence"], "left")
    spreads = [
        f(m).alias(f"{m}_{name}")
        for m in METRICS
        for name, f in (("min", F.min), ("p50", lambda c: F.percentile(c, F.lit(0.5))), ("max", F.max))
    ]
    measured = joined.groupBy("camera_id").agg(
        F.countDistinct("sequence").alias("frames_sampled"),
        F.countDistinct(F.when(F.col("passed").isNotNull(), F.col("sequence"))).alias("frames_with_faces"),
        F.count("passed").alias("faces_total"),
        count_where(F.col("passed")).alias("faces_passed"),
        F.min("offset").alias("first_sample_at"),
        F.max("offset").alias("last_sample_at"),
        *spreads,
    )
    stopped = seen.groupBy("camera_id").agg(
        F.max(F.when(F.col("place") == max_frames + 1, F.col("sequence") + 1)).alias("_stopped")
    )
    decoded = frames.groupBy("camera_id").agg(F.count(F.lit(1)).alias("_frames"))
    sizes = frames.groupBy("camera_id").agg(
        F.min_by(F.struct("height", "width"), "sequence").alias("_size")
    )
    whole = clips.join(decoded, "camera_id").join(sizes, "camera_id").join(stopped, "camera_id", "left").join(
        measured, "camera_id", "left"
    )
    covered = F.col("last_sample_at") - F.col("first_sample_at")
    counts = ["frames_sampled", "frames_with_faces", "faces_total", "faces_passed"]
    return (
        whole.fillna(0, counts)
        .withColumn("frames_decoded", F.coalesce("_stopped", "_frames"))
        .withColumn("faces_gated", F.col("faces_total") - F.col("faces_passed"))
        .withColumn("covered_seconds", covered)
        .withColumn("coverage", covered / F.nullif(F.col("duration_seconds"), F.lit(0.0)))
        .withColumn("resolution", F.format_string("%dx%d", "_size.width", "_size.height"))
        .withColumn(
            "examined_span", span_text(F.col("first_sample_at"), F.col("last_sample_at"), F.col("duration_seconds"))
        )
        .drop("_stopped", "_frames", "_size")
    )


def summarize(profiled: DataFrame) -> DataFrame:
    """The profile as reported: metrics to three decimals, duration to two."""
    figures = [f"{m}_{part}" for m in METRICS for part in ("min", "p50", "max")]
    return profiled.withColumns(
        {**{c: F.round(c, 3) for c in figures}, "duration_seconds": F.round("duration_seconds", 2)}
    )


def gate_failures(assessed: DataFrame) -> DataFrame:
    """How often each gate rule fired per camera, most frequent first."""
    fired = assessed.select("camera_id", F.explode_outer("quality.reasons").alias("reason"))
    counted = fired.filter(F.col("reason").isNotNull()).groupBy("camera_id", reason_key(F.col("reason")).alias("rule")).agg(
        F.count(F.lit(1)).alias("failures")
    )
    return counted.orderBy("camera_id", F.desc("failures"), "rule")


def advice(profiled: DataFrame, quality: QualitySettings = QualitySettings()) -> DataFrame:
    """Next steps per clip as rows (rule, message); medians are taken unrounded."""
    c = F.col
    height, blur, yaw = c("face_height_px_p50"), c("blur_variance_p50"), c("yaw_ratio_p50")
    gate = quality.min_face_height_px
    suggestion = F.greatest(F.lit(40), (height * 0.8).cast("int")).cast("string")
    no_frames, no_faces = c("frames_sampled") == 0, c("faces_total") == 0
    short = (c("duration_seconds") > 0) & (c("covered_seconds") < c("duration_seconds") * 0.9)
    rules = [
        (
            "all_gated",
            c("faces_passed") == 0,
            F.lit("Every detected face failed the quality gate; see the gate failures."),
        ),
        (
            "faces_too_small",
            height < gate,
            F.concat(
                F.lit("The median face is "), whole_text(height), F.lit(f"px high, under the {gate}px gate. "
                "Move the camera closer or set min_face_height_px="), suggestion, F.lit("."),
            ),
        ),
        (
            "faces_barely_large_enough",
            (height >= gate) & (height < gate * 1.3),
            F.concat(
                F.lit("The median face is "), whole_text(height),
                F.lit(f"px high, close to the {gate}px gate; some will fail."),
            ),
        ),
        (
            "blurred",
            blur < quality.min_blur_variance,
            F.concat(
                F.lit("Median sharpness is "), whole_text(blur),
                F.lit(f", under the gate of {quality.min_blur_variance:.0f}. Use a faster shutter or more light."),
            ),
        ),
        (
            "in_profile",
            yaw > quality.max_yaw_ratio,
            F.format_string(
                f"Median yaw is %.2f, over the gate of {quality.max_yaw_ratio:.2f}: people are seen from the side.",
                yaw,
            ),
        ),
        (
            "partly_examined",
            short,
            F.format_string(
                "Examined %.1fs of this %.1fs clip; raise max_frames to see more of it.",
                c("covered_seconds"), c("duration_seconds"),
            ),
        ),
        (
            "faces_rare",
            c("frames_with_faces") < c("frames_sampled") * 0.5,
            F.format_string(
                "Faces in only %d of %d sampled frames; a higher target_fps may catch more.",
                c("frames_with_faces"), c("frames_sampled"),
            ),
        ),
    ]

    def note(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), text.alias("message"))

    def alone(name: str, text: str) -> Column:
        return F.array(note(name, F.lit(text)))

    found = F.array_compact(F.array(*[F.when(hit, note(name, text)) for name, hit, text in rules]))
    notes = (
        F.when(no_frames, alone("no_frames", "No frames were decoded; check the source."))
        .when(no_faces, alone("no_faces", "No sampled frame shows a face; look at one before changing thresholds."))
        .when(F.size(found) == 0, alone("usable", "The footage is usable as it is."))
        .otherwise(found)
    )
    return profiled.select("camera_id", F.posexplode(notes).alias("place", "_note")).select(
        "camera_id", "place", "_note.*"
    )

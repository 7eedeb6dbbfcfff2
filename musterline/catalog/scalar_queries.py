"""Column functions over the whole detection, frame, student and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from musterline.catalog.registry import cameras, detections, query, rounded
from musterline.functions import geometry as geo
from musterline.functions import pose, scalars, vectors



@query(
    "F01_box_measures",
    """SELECT det_idx, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area,
              (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y FROM detections""",
    ("detections",),
)
def box_measures(g):
    return detections(g).select(
        "det_idx",
        geo.box_width(F.col("box")).alias("width"),
        geo.box_height(F.col("box")).alias("height"),
        geo.box_area(F.col("box")).alias("area"),
        geo.center_x(F.col("box")).alias("center_x"),
        geo.center_y(F.col("box")).alias("center_y"),
    )


_REGION = """, placed AS (
    SELECT d.*, c.roi_x2, 0.0e0 AS rx1, 48.0e0 AS ry1, c.roi_x2 * 640 AS rx2, 0.7e0 * 480 AS ry2
    FROM detections d JOIN cameras c ON d.camera_id = c.camera_id),
  met AS (
    SELECT *, greatest(0, least(x2, rx2) - greatest(x1, rx1)) * greatest(0, least(y2, ry2) - greatest(y1, ry1)) AS shared,
           (x2 - x1) * (y2 - y1) + (rx2 - rx1) * (ry2 - ry1) AS sizes FROM placed)
"""


@query(
    "F02_overlap_with_region",
    _REGION + """SELECT det_idx, round(shared / (sizes - shared), 6) AS overlap FROM met WHERE roi_x2 IS NOT NULL""",
    ("detections", "cameras"),
)
def overlap_with_region(g):
    placed = detections(g).join(cameras(g).select("camera_id", "roi"), "camera_id").filter("roi is not null")
    region = geo.roi_box(F.col("roi"), F.col("frame_height"), F.col("frame_width"))
    return placed.select("det_idx", F.round(geo.iou(F.col("box"), region), 6).alias("overlap"))


@query(
    "F03_F25_clip_and_crop",
    """SELECT det_idx,
         greatest(0, least(x1, 399)) AS clip_x1, greatest(0, least(y1, 299)) AS clip_y1,
         greatest(0, least(x2, 399)) AS clip_x2, greatest(0, least(y2, 299)) AS clip_y2,
         cast(trunc(greatest(0, x1 - (x2 - x1) * 0.25e0)) AS INT) AS crop_x1,
         cast(trunc(greatest(0, y1 - (y2 - y1) * 0.25e0)) AS INT) AS crop_y1,
         cast(trunc(least(frame_width, x2 + (x2 - x1) * 0.25e0)) AS INT) AS crop_x2,
         cast(trunc(least(frame_height, y2 + (y2 - y1) * 0.25e0)) AS INT) AS crop_y2
       FROM detections""",
    ("detections",),
)
def clip_and_crop(g):
    clipped = geo.clip_box(F.col("box"), F.lit(400), F.lit(300))
    crop = geo.padded_crop(F.col("box"), F.col("frame_height"), F.col("frame_width"), 0.25)
    corners = ("x1", "y1", "x2", "y2")
    return detections(g).select(
        "det_idx",
        *[clipped[c].alias(f"clip_{c}") for c in corners],
        *[crop[c].alias(f"crop_{c}") for c in corners],
    )


@query(
    "F04_P01_region_filter",
    _REGION
    + """SELECT camera_id, det_idx FROM met WHERE roi_x2 IS NULL OR shared > 0
         OR ((x1 + x2) / 2 BETWEEN rx1 AND rx2 AND (y1 + y2) / 2 BETWEEN ry1 AND ry2)""",
    ("detections", "cameras"),
)
def region_filter(g):
    from musterline.operators.gate import roi_filter

    return roi_filter(detections(g), cameras(g)).select("camera_id", "det_idx")


@query(
    "F05_F06_vector_norms",
    """SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
              round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS unit_norm,
              len(embedding) AS dimension FROM embeddings""",
)
def vector_norms(g):
    checked = g.table("embeddings").withColumn("unit", vectors.l2_normalize(F.col("embedding")))
    return checked.select(
        "vec_id",
        F.round(vectors.l2_norm(vectors.require_unit(F.col("embedding"))), 5).alias("norm"),
        F.round(vectors.l2_norm(F.col("unit")), 5).alias("unit_norm"),
        F.size("unit").cast("bigint").alias("dimension"),
    )


@query(
    "F07_F08_neighbouring_similarity",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot_product,
              round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def neighbouring_similarity(g):
    a = g.table("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = g.table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("dot_product"),
        F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity"),
    )


@query(
    "F10_F11_head_pose",
    """, lengths AS (
         SELECT *, sqrt(pow(right_x - left_x, 2) + pow(right_y - left_y, 2)) AS eyes,
                sqrt(pow(nose_x - left_x, 2) + pow(nose_y - left_y, 2)) AS to_left,
                sqrt(pow(nose_x - right_x, 2) + pow(nose_y - right_y, 2)) AS to_right
         FROM detections WHERE has_landmarks)
       SELECT det_idx, round(CASE WHEN eyes < 1e-6 THEN 1 ELSE abs(to_left - to_right) / eyes END, 6) AS yaw_ratio,
              round(degrees(atan2(right_y - left_y, right_x - left_x)), 6) AS roll_degrees FROM lengths""",
    ("detections",),
)
def head_pose(g):
    lm = F.col("landmarks")
    return detections(g).filter(pose.has_pose(lm)).select(
        "det_idx",
        F.round(pose.yaw_ratio(lm), 6).alias("yaw_ratio"),
        F.round(pose.roll_degrees(lm), 6).alias("roll_degrees"),
    )


def uuid_text(name: str) -> str:
    """Checking SQL for the version 5 UUID of a text."""
    digest = f"sha1(unhex('{scalars.STUDENT_NAMESPACE.replace('-', '')}') || encode({name}))"
    nibble = f"strpos('0123456789abcdef', substr({digest}, 17, 1))"
    variant = f"substr('89ab89ab89ab89ab', {nibble}, 1)"
    return (
        f"concat(substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-5', substr({digest}, 14, 3), '-', "
        f"{variant}, substr({digest}, 18, 3), '-', substr({digest}, 21, 12))"
    )


@query(
    "F12_student_ids",
    f"SELECT university_id, {uuid_text('university_id')} AS student_id FROM students",
    ("students",),
)
def student_ids(g):
    return g.view("students").select(
        "university_id", scalars.student_id_for(F.col("university_id")).alias("student_id")
    )


@query(
    "F13_F16_clip_arithmetic",
    """, clips AS (SELECT *, cast(sequence % 61 AS DOUBLE) AS fps, cast(sequence % 97 AS DOUBLE) AS duration FROM frames)
       SELECT camera_id, sequence,
         greatest(1, cast(round_even(coalesce(nullif(fps, 0), 25) / 3, 0) AS BIGINT)) AS stride,
         round(coalesce(sequence / nullif(fps, 0), sequence), 6) AS offset_seconds,
         round(least(3.0e0, coalesce(20 / nullif(duration, 0), 3.0e0)), 6) AS spread_rate,
         epoch_us(TIMESTAMP '2026-01-01 00:00:00') + cast(round_even(sequence / coalesce(nullif(fps, 0), 25) * 1000000, 0) AS BIGINT) AS presented_us
       FROM clips""",
    ("frames",),
)
def clip_arithmetic(g):
    fps, duration = F.pmod("sequence", F.lit(61)), F.pmod("sequence", F.lit(97))
    shown = scalars.presentation_time(F.lit(None).cast("double"), F.col("sequence"), fps)
    return g.view("frames").select(
        "camera_id",
        "sequence",
        scalars.stride(fps, 3.0).alias("stride"),
        F.round(scalars.offset_seconds(F.col("sequence"), fps), 6).alias("offset_seconds"),
        F.round(scalars.spread_fps(3.0, 20, duration), 6).alias("spread_rate"),
        F.unix_micros(shown).alias("presented_us"),
    )


@query(
    "F16_decoder_positions",
    """, clips AS (SELECT camera_id, sequence, cast(sequence % 61 AS DOUBLE) AS fps,
           CASE WHEN sequence % 5 > 0 THEN cast(sequence AS DOUBLE) * 40.5e0 - 400 END AS position FROM frames)
       SELECT camera_id, sequence, epoch_us(TIMESTAMP '2026-01-01 00:00:00') + cast(round_even(
         CASE WHEN position > 0 THEN position * 1000 ELSE sequence / coalesce(nullif(fps, 0), 25) * 1000000 END, 0) AS BIGINT) AS presented_us
       FROM clips""",
    ("frames",),
)
def decoder_positions(g):
    """Frames with a position in the clip, without one, and before its start."""
    position = F.when(F.col("sequence") % 5 > 0, F.col("sequence").cast("double") * 40.5 - 400)
    shown = scalars.presentation_time(position, F.col("sequence"), F.pmod("sequence", F.lit(61)))
    return g.view("frames").select("camera_id", "sequence", F.unix_micros(shown).alias("presented_us"))


_GATE = """, measured AS (
    SELECT *, y2 - y1 AS h, sqrt(pow(right_x - left_x, 2) + pow(right_y - left_y, 2)) AS eyes,
           sqrt(pow(nose_x - left_x, 2) + pow(nose_y - left_y, 2)) AS to_left,
           sqrt(pow(nose_x - right_x, 2) + pow(nose_y - right_y, 2)) AS to_right,
           degrees(atan2(right_y - left_y, right_x - left_x)) AS roll FROM detections),
  gated AS (
    SELECT *, concat_ws(',',
        CASE WHEN detector_score < 0.6 THEN 'detector_score' END, CASE WHEN h < 100 THEN 'face_height' END,
        CASE WHEN blur_variance < 45 THEN 'blur_variance' END,
        CASE WHEN has_landmarks AND (CASE WHEN eyes < 1e-6 THEN 1 ELSE abs(to_left - to_right) / eyes END) > 0.45 THEN 'yaw_ratio' END,
        CASE WHEN has_landmarks AND abs(roll) > 35 THEN 'roll' END) AS rules FROM measured)
"""


@query(
    "P02_F17_F18_quality_gate",
    _GATE
    + """SELECT det_idx, rules = '' AS passed, rules, CASE WHEN has_landmarks THEN 6 ELSE 4 END AS metrics,
                CASE WHEN has_landmarks THEN round(roll, 6) END AS roll_degrees FROM gated""",
    ("detections",),
)
def quality_gate(g):
    from musterline.operators.gate import assess_quality

    keys = F.transform("quality.reasons", scalars.reason_key)
    return assess_quality(detections(g)).select(
        "det_idx",
        F.col("quality.passed").alias("passed"),
        F.concat_ws(",", keys).alias("rules"),
        F.size("quality.metrics").alias("metrics"),
        F.round(F.col("quality.metrics")["roll_degrees"], 6).alias("roll_degrees"),
    )


@query(
    "A18_gate_failures",
    _GATE + """SELECT camera_id, rule, count(*) AS failures FROM
              (SELECT camera_id, unnest(string_split(rules, ',')) AS rule FROM gated WHERE rules <> '') GROUP BY 1, 2""",
    ("detections",),
)
def gate_failure_counts(g):
    from musterline.operators.gate import assess_quality
    from musterline.operators.profile import gate_failures

    return gate_failures(assess_quality(detections(g)))


@query(
    "F19_W03_best_per_track",
    _GATE
    + """SELECT camera_id, track_id, sequence, det_idx, score AS quality_score FROM (
           SELECT camera_id, user_id AS track_id, sequence, det_idx, round(h * blur_variance, 6) AS score,
                  row_number() OVER (PARTITION BY camera_id, user_id ORDER BY h * blur_variance DESC, sequence, det_idx) AS place
           FROM gated WHERE rules = '') WHERE place = 1""",
    ("detections",),
)
def best_of_each_track(g):
    from musterline.operators.gate import assess_quality
    from musterline.operators.references import best_per_track

    tracked = assess_quality(detections(g)).withColumn("track_id", F.col("user_id"))
    tracked = tracked.withColumn("embedding", F.lit(None).cast("array<float>"))
    best = best_per_track(tracked).select("camera_id", "track_id", "sequence", "det_idx", "quality_score")
    return rounded(best, "quality_score")


@query(
    "F24_A08_detections_by_date",
    """SELECT cast(detection_time AS DATE) AS detection_date, count(*) AS total_detections,
              cast(sum(cast(recognition_status = 'Recognized' AS INT)) AS BIGINT) AS recognized,
              cast(sum(cast(recognition_status = 'Unknown' AS INT)) AS BIGINT) AS unknown_faces
       FROM recognition_log GROUP BY 1""",
    ("recognition_log",),
)
def detections_by_date(g):
    from musterline.plans.reports import detection_summary

    return detection_summary(g.view("recognition_log"))

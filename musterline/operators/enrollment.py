"""Reference photos to gallery rows: validation, a cap per student, ids and names."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterline.functions.scalars import STUDENT_NAMESPACE, count_where, name_uuid, student_id_for
from musterline.functions.vectors import require_unit
from musterline.operators.gate import assess_quality
from musterline.settings import EnrollmentSettings, QualitySettings


class Enrolled(NamedTuple):
    gallery: DataFrame
    skipped: DataFrame
    photos: DataFrame


def validate_photos(
    photos: DataFrame, quality: QualitySettings = QualitySettings(), enforce_quality: bool = True
) -> DataFrame:
    """Adds ``usable``, and ``reject_reason`` for photos that are not. The first failing rule wins:
    a photo with several faces is refused rather than guessed at."""
    faces = F.coalesce("face_count", F.lit(0))
    readable = F.coalesce("readable", F.lit(False))
    gate = F.col("quality.passed") if enforce_quality else F.lit(True)
    reason = (
        F.when(~readable, F.lit("unreadable image"))
        .when(faces == 0, F.lit("no face detected"))
        .when(faces > 1, F.concat(faces.cast("string"), F.lit(" faces detected, expected exactly one")))
        .when(~gate, F.concat_ws("; ", "quality.reasons"))
    )
    assessed = assess_quality(photos, quality).withColumn("usable", readable & (faces == 1) & gate)
    return assessed.withColumn("reject_reason", reason)


def enroll(
    photos: DataFrame,
    quality: QualitySettings = QualitySettings(),
    settings: EnrollmentSettings = EnrollmentSettings(),
) -> Enrolled:
    """The first usable photos of each student in path order, and what was refused before the
    cap was reached; photos behind the cap are not looked at.

    ``photos`` are reference detections with a ``university_id``; where they carry the ``place``
    that the file listing gives, that is the order instead.
    """
    judged = validate_photos(photos, quality, settings.enforce_quality)
    order = "place" if "place" in photos.columns else "path"
    in_order = Window.partitionBy("university_id").orderBy(order)
    usable = judged.filter("usable")
    ranked = usable.withColumn("_nth", F.row_number().over(in_order))
    kept = ranked.filter(F.col("_nth") <= settings.max_per_student)
    last = kept.filter(F.col("_nth") == settings.max_per_student)
    last = last.select("university_id", F.col(order).alias("_last"))

    refused = judged.filter("not usable").join(last, "university_id", "left")
    looked_at = F.col("_last").isNull() | (F.col(order) < F.col("_last"))
    skipped = refused.filter(looked_at).select("university_id", "path", "reject_reason")
    gallery = kept.select(
        name_uuid(STUDENT_NAMESPACE, F.concat_ws("|", "model_version", "path")).alias("embedding_id"),
        student_id_for(F.col("university_id")).alias("student_id"),
        "university_id",
        require_unit(F.col("embedding")).alias("embedding"),
        "model_version",
    )
    return Enrolled(gallery, skipped, judged)


def enrolled_students(gallery: DataFrame) -> DataFrame:
    return gallery.agg(F.countDistinct("student_id").alias("students"))


def not_enrolled(judged: DataFrame) -> DataFrame:
    """Students with photos of which none was usable."""
    counted = judged.groupBy("university_id").agg(
        F.count(F.lit(1)).alias("photos"), count_where(F.col("usable")).alias("_usable")
    )
    return counted.filter(F.col("_usable") == 0).drop("_usable")

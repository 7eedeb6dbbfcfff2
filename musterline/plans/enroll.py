"""Reference photos to the stored gallery: validate, name, upsert students, load vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage
from musterline.functions.scalars import student_id_for
from musterline.operators.enrollment import enroll
from musterline.operators.upserts import load_embeddings, mark_registered, names_for, resolve_names, upsert_students
from musterline.settings import EnrollmentSettings, QualitySettings

SHOWN_MISSING = 5


class Stored(NamedTuple):
    students: DataFrame
    gallery: DataFrame
    skipped: DataFrame


def load_enrollment(
    photos: DataFrame,
    roster: DataFrame,
    students: DataFrame,
    gallery: DataFrame,
    quality: QualitySettings = QualitySettings(),
    settings: EnrollmentSettings = EnrollmentSettings(),
) -> Stored:
    """Students and gallery after loading. Nothing is loaded while anybody has no name.

    A student known by university id keeps the stored id, and the new vectors are filed under it.
    """
    enrolled = enroll(photos, quality, settings)
    accepted = cut_lineage(enrolled.gallery)
    wanted = accepted.select("university_id").distinct()
    names, missing = resolve_names(wanted, roster, names_for(students, wanted))
    shown = [r.university_id for r in missing.limit(SHOWN_MISSING + 1).collect()]
    if shown:
        more = " ..." if len(shown) > SHOWN_MISSING else ""
        raise ValueError(f"no full_name for: {', '.join(shown[:SHOWN_MISSING])}{more}; add them to the roster")
    named = wanted.join(names, "university_id").withColumn("student_id", student_id_for(F.col("university_id")))
    everybody = upsert_students(students, named)
    ids = everybody.select("university_id", F.col("student_id").alias("_stored"))
    records = accepted.join(ids, "university_id").withColumn("student_id", F.col("_stored")).drop("_stored")
    return Stored(mark_registered(everybody, records), load_embeddings(gallery, records), enrolled.skipped)

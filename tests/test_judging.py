"""Gate and match of faces: in place where the gallery is small, by their ids where it is not or where ids repeat."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at
from musterline.catalog.registry import with_faces
from musterline.operators import matching
from musterline.plans.identify import judge_faces
from musterline.schemas import DETECTIONS
from musterline.settings import MatchingSettings, PipelineSettings, PrivacySettings

GALLERY = "embedding_id string, student_id string, university_id string, embedding array<float>, model_version string"
CAMERAS = "camera_id string, roi array<double>"


def vector(rng):
    return [float(x) for x in rng.standard_normal(8)]


@pytest.fixture
def tables(spark):
    """Faces of two cameras and of none; some fail the gate, some share their ids, one has a model nobody is enrolled with."""
    rng = np.random.default_rng(3)

    def face(camera, sequence, det_idx, score=0.9, version="m1"):
        return (camera, sequence, at(sequence), 480, 640, det_idx, (0.0, 0.0, 100.0, 120.0), score, None, 500.0, vector(rng), version)

    faces = [face(c, s, d, 0.9 if (s + d) % 4 else 0.1) for c in ("a", "b", None) for s in range(6) for d in range(3)]
    faces += [face("a", 1, 1), face("a", 1, 1), face("b", 2, 2, 0.1), face("b", 4, 0, 0.9), face("b", 9, 0, version="m9"), face("b", 9, 1, version=None)]
    enrolled = [(f"e{i}", f"s{i % 5}", f"u{i % 5}", vector(rng), "m1" if i % 4 else "m2") for i in range(30)]
    cameras = spark.createDataFrame([("a", None), ("b", [0.0, 0.0, 1.0, 1.0])], CAMERAS)
    return spark.createDataFrame(faces, DETECTIONS), spark.createDataFrame(enrolled, GALLERY), cameras


def told(judged):
    return Counter(repr(r.asDict(recursive=True)) for r in judged.select(*sorted(judged.columns)).collect())


@pytest.mark.parametrize("repeated", [True, False])
@pytest.mark.parametrize("how", ["max", "mean"])
def test_faces_are_judged_alike_in_place_and_by_their_ids(spark, tables, monkeypatch, repeated, how):
    faces, gallery, cameras = tables
    if not repeated:
        faces = faces.dropDuplicates(["camera_id", "sequence", "det_idx"])
    settings = PipelineSettings(matching=MatchingSettings(similarity_threshold=0.3, min_margin=0.1, aggregation=how))
    students = spark.createDataFrame([(f"s{i}", "active" if i else "withdrawn") for i in range(5)], "student_id string, enrollment_status string")
    in_place = judge_faces(faces, gallery, cameras, settings, students)
    monkeypatch.setattr(matching, "RESIDENT_BYTES", 0)
    by_id = judge_faces(faces, gallery, cameras, settings, students)
    assert told(in_place) == told(by_id)
    rows = in_place.collect()
    assert {r.outcome for r in rows} == {None, "matched", "unresolved", "no_candidates"}
    assert all((r.outcome is None) == (not r.quality.passed) for r in rows if not repeated)
    # Two rows with one id meet both answers.
    assert len(rows) == (faces.count() + 3 * 3 - 3 if repeated else faces.count())


def test_vectors_are_written_only_if_they_are_to_be_kept(spark, tables):
    faces, gallery, cameras = tables
    faces = faces.dropDuplicates(["camera_id", "sequence", "det_idx"])
    for keep in (False, True):
        judged = judge_faces(faces, gallery, cameras, PipelineSettings(privacy=PrivacySettings(keep)))
        assert judged.schema["embedding"].dataType == faces.schema["embedding"].dataType
        assert judged.filter(F.col("embedding").isNotNull()).count() == (judged.count() if keep else 0)


def test_faces_do_not_move_to_few_vectors(spark, capsys):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id bigint, embedding array<float>")
        faces = spark.range(50).select(F.col("id").alias("user_id"), F.col("id").alias("det_idx"))
        mixed = with_faces(faces, vectors)
        capsys.readouterr()
        mixed.explain()
        plan = capsys.readouterr().out
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
        assert mixed.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

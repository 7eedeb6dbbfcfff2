import numpy as np
import pyarrow as pa
import pytest

from musterline.catalog.inputs import Given
from musterline.catalog.matching_queries import RADIUS, hashed_search, hashed_search_recall
from musterline.operators import matching
from musterline.operators.matching import (
    HASH_BITS,
    active_gallery,
    code_distances,
    match,
    radius_for,
    recall_against,
    search,
    sign_codes,
)
from musterline.settings import MatchingSettings

GALLERY = "embedding_id string, student_id string, university_id string, embedding array<float>, model_version string"
PROBES = "probe_id string, embedding array<float>, model_version string"


def unit(*v):
    v = np.asarray(v, dtype=float)
    return [float(x) for x in v / np.linalg.norm(v)]


def decided(spark, gallery, probe, **settings):
    rows = [(f"e{i}", sid, sid, unit(*v), m) for i, (sid, v, m) in enumerate(gallery)]
    df = spark.createDataFrame(rows, GALLERY)
    probes = spark.createDataFrame([("p", unit(*probe), "m1")], PROBES)
    return match(probes, df, MatchingSettings(**settings)).first()


def test_matches_the_enrolled_student(spark):
    row = decided(spark, [("U45", (1, 0, 0), "m1")], (0.98, 0.02, 0))
    assert row.outcome == "matched" and row.best_similarity > 0.9
    assert row.runner_up_student is None and row.margin == row.best_similarity


def test_below_threshold_still_reports_the_best(spark):
    row = decided(spark, [("A", (1, 0, 0), "m1")], (1, 1, 0), similarity_threshold=0.8)
    assert row.outcome == "unresolved" and "below threshold" in row.reason and row.best_student == "A"


def test_small_margin_is_ambiguous(spark):
    gallery = [("A", (1, 0, 0), "m1"), ("B", (0.999, 0.045, 0), "m1")]
    row = decided(spark, gallery, (1, 0.02, 0), similarity_threshold=0.5)
    assert row.outcome == "unresolved" and "margin" in row.reason
    assert "A" in row.reason and "B" in row.reason


def test_runner_up_is_another_student(spark):
    gallery = [("A", (1, 0, 0), "m1"), ("A", (0, 1, 0), "m1"), ("B", (0.5, 0.5, 0.2), "m1")]
    row = decided(spark, gallery, (0.95, 0.05, 0), similarity_threshold=0.5)
    assert (row.outcome, row.best_student, row.runner_up_student) == ("matched", "A", "B")


@pytest.mark.parametrize("gallery", [[], [("A", (1, 0, 0), "m2")]])
def test_no_candidates(spark, gallery):
    row = decided(spark, gallery, (1, 0, 0))
    assert row.outcome == "no_candidates" and row.best_student is None and row.margin is None


def test_equality_with_threshold_and_margin_matches(spark):
    gallery = [("A", (1, 0), "m1"), ("B", (0, 1), "m1")]
    row = decided(spark, gallery, (0, 1), similarity_threshold=1.0, min_margin=1.0)
    assert row.outcome == "matched" and row.best_student == "B"


def test_limit_applies_before_aggregation(spark):
    gallery = [("A", (1, 0.001 * i, 0), "m1") for i in range(10)] + [("B", (1, 0.02, 0), "m1")]
    row = decided(spark, gallery, (1, 0, 0), candidate_limit=10)
    assert row.outcome == "matched" and row.runner_up_student is None


def test_mean_over_returned_candidates_only(spark):
    gallery = [("A", (1, 0), "m1"), ("A", (0.6, 0.8), "m1"), ("A", (0, 1), "m1")]
    row = decided(spark, gallery, (1, 0), aggregation="mean", candidate_limit=2)
    assert row.best_similarity == pytest.approx(0.8, abs=1e-6)


def test_inactive_students_use_up_no_places(spark):
    gallery = spark.createDataFrame([("e1", "A", "A", [1.0, 0.0], "m1"), ("e2", "B", "B", [0.6, 0.8], "m1")], GALLERY)
    students = spark.createDataFrame(
        [("A", "opted_out"), ("B", "active")], "student_id string, enrollment_status string"
    )
    probes = spark.createDataFrame([("p", [1.0, 0.0], "m1")], PROBES)
    found = search(probes, active_gallery(gallery, students), 1).collect()
    assert [r.student_id for r in found] == ["B"]
    assert [r.student_id for r in search(probes, active_gallery(gallery, students, False), 1).collect()] == ["A"]


def test_zero_vector_fails(spark):
    gallery = spark.createDataFrame([("e1", "A", "A", [0.0, 0.0], "m1")], GALLERY)
    probes = spark.createDataFrame([("p", [1.0, 0.0], "m1")], PROBES)
    with pytest.raises(Exception, match="zero vector"):
        search(probes, gallery, 1).collect()


def test_probes_stay_where_they_are_for_a_small_gallery(spark, capsys):
    gallery = spark.createDataFrame([("e1", "A", "A", [1.0, 0.0], "m1")], GALLERY)
    probes = spark.createDataFrame([("p", [1.0, 0.0], "m1"), ("q", [1.0, 0.0], None)], PROBES)
    found = search(probes, gallery, 1)
    assert [r.probe_id for r in found.collect()] == ["p"]
    found.explain("formatted")
    plan = capsys.readouterr().out
    tree = plan.split("(1)")[0]
    assert tree.index("Exchange") < tree.index("MapInArrow") and "Exchange" not in tree[tree.index("MapInArrow") :]


@pytest.mark.parametrize("resident_bytes", [0, 1 << 26])
def test_blocks_with_many_copies_agree_with_brute_force(spark, resident_bytes):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((180, 8)).astype(np.float32)
    vectors[:60] = vectors[0]
    ids = [f"e{i:03d}" for i in range(180)]
    rows = [(ids[i], f"s{i % 7}", f"s{i % 7}", vectors[i].tolist(), "m1") for i in range(180)]
    gallery = spark.createDataFrame(rows, GALLERY)
    probes = gallery.selectExpr("embedding_id as probe_id", "embedding", "model_version")
    found = search(probes, gallery, 5, exclude_same_id=True, block_rows=25, resident_bytes=resident_bytes)
    got = {(r.probe_id, r.candidate_rank): r.embedding_id for r in found.collect()}

    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    scores = np.round(units @ units.T, 12)
    for i, name in enumerate(ids):
        order = sorted((j for j in range(180) if j != i), key=lambda j: (-scores[i, j], ids[j]))[:5]
        assert [got[(name, k + 1)] for k in range(5)] == [ids[j] for j in order]


def test_hashed_search_finds_close_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(f"e{i}", f"s{i}", f"s{i}", unit(*v), "m1") for i, v in enumerate(base)]
    probes = [(f"p{i}", unit(*(v + 0.05 * rng.standard_normal(16))), "m1") for i, v in enumerate(base)]
    found = search(spark.createDataFrame(probes, PROBES), spark.createDataFrame(rows, GALLERY), 1, "lsh").collect()
    hits = sum(r.probe_id[1:] == r.embedding_id[1:] for r in found)
    assert hits >= 38


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("radius", [None, RADIUS])
def test_hashed_search_on_the_given_vectors(spark, folder, radius):
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    name = "cast(vec_id as string)"
    gallery = vectors.selectExpr(f"{name} embedding_id", f"{name} student_id", "embedding", "'m1' model_version")
    probes = vectors.selectExpr(f"{name} probe_id", "embedding", "'m1' model_version")
    exact = search(probes, gallery, 10, exclude_same_id=True)
    hashed = search(probes, gallery, 10, "lsh", exclude_same_id=True, hash_radius=radius)
    assert recall_against(hashed, exact).first().recall >= 0.9
    units = np.array(vectors.toArrow().column("embedding").to_pylist())
    codes = sign_codes(units, HASH_BITS)
    if radius is None:
        radius = radius_for(probes, gallery, 10, exclude_same_id=True)
    assert (code_distances(codes, codes) <= radius).mean() <= (0.22 if folder == "sf0.01" else 0.2)


@pytest.fixture
def some_vectors(spark, tmp_path):
    """30 vectors whose ids are not divisible by 100."""
    rng = np.random.default_rng(9)
    rows = [(101 + i, [float(x) for x in v], i % 4) for i, v in enumerate(rng.standard_normal((30, 64)))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return Given(spark, str(tmp_path))


def test_hashed_search_asks_for_every_row(some_vectors):
    assert {r.probe_id for r in hashed_search(some_vectors).collect()} == {str(101 + i) for i in range(30)}


def test_recall_of_hashed_search_is_that_of_every_row(some_vectors):
    row = hashed_search_recall(some_vectors).first()
    assert row.exact_candidates == 300 and 0 < row.found <= 300


def test_radius_of_clustered_vectors_compares_little(spark):
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.standard_normal((60, 64)), 12, axis=0) + 0.3 * rng.standard_normal((720, 64))
    rows = [(f"e{i}", f"s{i}", f"s{i}", unit(*v), "m1") for i, v in enumerate(vectors)]
    gallery = spark.createDataFrame(rows, GALLERY)
    probes = gallery.selectExpr("embedding_id as probe_id", "embedding", "model_version")
    radius = radius_for(probes, gallery, 10, exclude_same_id=True)
    codes = sign_codes(vectors, HASH_BITS)
    assert (code_distances(codes, codes) <= radius).mean() < 0.03


@pytest.mark.parametrize("resident_bytes", [0, 1 << 26])
def test_hashed_search_equals_brute_force_within_the_radius(spark, resident_bytes):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((150, 16))
    rows = [(f"e{i:03d}", "s", "s", unit(*v), "m1") for i, v in enumerate(vectors)]
    gallery = spark.createDataFrame(rows, GALLERY)
    probes = gallery.selectExpr("embedding_id as probe_id", "embedding", "model_version")
    found = search(probes, gallery, 3, "lsh", True, 20, hash_radius=100, resident_bytes=resident_bytes).collect()
    planes = np.random.default_rng(7).standard_normal((256, 16))
    units = np.array([r[3] for r in rows], np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    sides, scores, want = units @ planes.T >= 0, np.round(units @ units.T, 12), set()
    for i in range(150):
        near = [j for j in range(150) if j != i and (sides[i] != sides[j]).sum() <= 100]
        near.sort(key=lambda j: (-scores[i, j], j))
        want |= {(f"e{i:03d}", f"e{j:03d}", n + 1) for n, j in enumerate(near[:3])}
    assert {(r.probe_id, r.embedding_id, r.candidate_rank) for r in found} == want


def test_hashed_search_of_nothing(spark):
    gallery = spark.createDataFrame([], GALLERY)
    assert search(spark.createDataFrame([("p", [1.0, 0.0], "m1")], PROBES), gallery, 3, "lsh").count() == 0


def test_a_large_gallery_is_compared_in_small_tiles(monkeypatch):
    """What is held at a time does not grow with the gallery, and the answer is that of one product."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((3_000, 8))
    ids = [f"e{i:04}" for i in range(3_000)]
    rows = pa.table({"embedding_id": ids, "student_id": [f"s{i % 7}" for i in range(3_000)], "university_id": [None if i % 5 == 0 else f"u{i % 7}" for i in range(3_000)], "embedding": [v.tolist() for v in vectors]})
    probes = pa.table({"probe_id": ids[:40], "embedding": [v.tolist() for v in vectors[:40]]})
    monkeypatch.setattr(matching, "SCORES_AT_ONCE", 10_000)
    held, plain = [], matching.Enrolled._scores
    monkeypatch.setattr(matching.Enrolled, "_scores", lambda self, some: held.append(len(some)) or plain(self, some))
    got = matching.Enrolled(rows).nearest(probes, 5, True).to_pylist()
    assert max(held) * 3_000 <= 10_000 and sum(held) == 40
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit[:40] @ unit.T, 12)
    expected = [(ids[p], ids[e]) for p in range(40) for e in [i for i in np.argsort(-scores[p], kind="stable") if i != p][:5]]
    assert [(r["probe_id"], r["embedding_id"]) for r in got] == expected
    assert all(r["university_id"] == (None if int(r["embedding_id"][1:]) % 5 == 0 else f"u{int(r['embedding_id'][1:]) % 7}") for r in got)


@pytest.mark.parametrize("how", ["max", "mean"])
def test_a_resident_gallery_answers_with_two_students_a_probe(spark, monkeypatch, how):
    """As the candidates of all probes, scored and ranked as rows, tell it; repeated ids are put together first."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((300, 4))
    vectors[40:80] = vectors[:40]  # equal similarities
    people = [None if i % 11 == 0 else f"s{i % 37}" for i in range(300)]
    gallery = spark.createDataFrame(
        [(f"e{i:03}", people[i], None if i % 5 == 0 else f"u{i % 9}", v.tolist(), "m1" if i % 4 else "m2") for i, v in enumerate(vectors)], GALLERY
    )
    probes = [(f"p{i}" if i else None, rng.standard_normal(4).tolist(), ("m1", "m2", "m3", None)[i % 7 % 4]) for i in range(60)]
    probes += [(name, rng.standard_normal(4).tolist(), model) for name, _, model in probes[:8]] + [("e003", vectors[3].tolist(), "m1")]
    probes = spark.createDataFrame(probes, PROBES)
    settings = MatchingSettings(similarity_threshold=0.3, min_margin=0.01, aggregation=how)
    found = search(probes, gallery, settings.candidate_limit, exclude_same_id=True)
    plain = matching.decide(probes, matching.aggregate_candidates(found, how), settings)
    gathered, first_two = [], matching._first_two
    monkeypatch.setattr(matching, "_first_two", lambda scores: gathered.append(scores) or first_two(scores))
    got = match(probes, gallery, settings, exclude_same_id=True)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    assert [r.probe_id for r in gathered[0].select("probe_id").distinct().orderBy("probe_id").collect()] == ["p1", "p4", "p5", "p7"]


def test_floors_are_reached_by_enough_scores():
    rng = np.random.default_rng(9)
    for count, width in ((1, 1), (3, 3), (5, 40), (5, 1013), (10, 2000)):
        scores = np.round(rng.standard_normal((50, width)), 1)
        scores[::7, ::3] = -np.inf
        reached = (scores >= matching.floors_of(scores, count)[:, None]).sum(axis=1)
        assert (reached >= np.minimum(count, np.isfinite(scores).sum(axis=1))).all()

import numpy as np
import pyarrow as pa
import pytest

from musterline.cluster import ROWS_A_FILE, cut_lineage
from musterline.operators import blocks, grouping
from musterline.operators.blocks import deal_to_cells
from musterline.operators.grouping import connected_components, fragment_links, fragmentation, single_linkage
from musterline.operators.ordering import numbered, previous_value
from musterline.operators.profile import exact_percentiles
from musterline.operators.references import best_per_track, order_people, people_manifest, select_references, write_people
from pyspark.sql import functions as F
from test_matching import unit

FRAGMENTS = "fragment_id bigint, embedding array<float>, model_version string"


def clusters(spark, vectors, threshold=0.5, **options):
    rows = [(i, None if v is None else unit(*v), "m1") for i, v in enumerate(vectors)]
    out = single_linkage(spark.createDataFrame(rows, FRAGMENTS), threshold, **options).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.cluster_id, set()).add(r.fragment_id)
    return sorted(map(sorted, groups.values()))


def test_chaining_through_a_middle_view(spark):
    assert clusters(spark, [(1, 0, 0), (0.7, 0.3, 0), (0.3, 0.95, 0)]) == [[0, 1, 2]]


def test_separation_and_missing_vectors(spark):
    assert clusters(spark, [(1, 0, 0), (1, 0, 0), (0, 1, 0), None]) == [[0, 1], [2]]


def test_equality_with_the_threshold_links(spark):
    assert clusters(spark, [(1, 0), (3, 4)], threshold=0.6) == [[0, 1]]


@pytest.mark.parametrize("options", [{}, {"resident_bytes": 0}, {"resident_bytes": 0, "block_rows": 17}])
def test_many_copies_agree_with_brute_force(spark, options):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((150, 6))
    vectors[50:100] = vectors[50]
    units = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = np.round(units @ units.T, 12) >= 0.8
    label = list(range(150))
    changed = True
    while changed:
        changed = False
        for i in range(150):
            low = min(label[j] for j in np.flatnonzero(near[i]))
            if low < label[i]:
                label[i], changed = low, True
    expected = {}
    for i, c in enumerate(label):
        expected.setdefault(c, []).append(i)
    assert clusters(spark, vectors, 0.8, **options) == sorted(expected.values())

    df = spark.createDataFrame([(i, unit(*v), "m1") for i, v in enumerate(vectors)], FRAGMENTS)
    links = {r.fragment_id: r.links for r in fragment_links(df, 0.8, **options).collect()}
    assert links == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1)) if n > 1}


def compared(spark, vectors, threshold, block_rows):
    """How many comparisons the cells lead to, and whether all pairs at the threshold are among them."""
    df = spark.createDataFrame([(i, unit(*v), "m1") for i, v in enumerate(vectors)], FRAGMENTS)
    visiting, residing = deal_to_cells(df, "fragment_id", float(np.arccos(threshold)), block_rows, 64)
    pieces, met = {}, np.zeros((len(vectors), len(vectors)), int)
    for side, rows in enumerate((visiting.collect(), residing.collect())):
        for r in rows:
            pieces.setdefault((r._from, r._to), ([], []))[side].append(r.fragment_id)
    for left, right in pieces.values():
        met[np.ix_(left, right)] += 1
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert met.max() == 1 and met[np.round(units @ units.T, 12) >= threshold].all()
    return met.sum()


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.95])
def test_cells_miss_no_pair(spark, threshold):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 5))
    vectors[:80] = vectors[0] + 0.05 * rng.standard_normal((80, 5))
    compared(spark, vectors, threshold, 25)


def test_comparisons_of_people_grow_less_than_with_the_square(spark):
    rng = np.random.default_rng(9)

    def people(count):
        return np.repeat(rng.standard_normal((count, 64)), 10, axis=0) + 0.15 * rng.standard_normal((count * 10, 64))

    small, large = (compared(spark, people(n), 0.8, 40) for n in (15, 60))
    assert large < 0.3 * 600**2 and large < 9 * small  # four times the vectors: sixteen times all pairs


def test_few_fragments_are_compared_where_they_lie(spark, capsys):
    df = spark.createDataFrame([(i, unit(1, i), "m1") for i in range(9)], FRAGMENTS)
    fragment_links(df, 0.8).explain("formatted")
    tree = capsys.readouterr().out.split("(1)")[0]
    assert "MapInArrow" in tree and "CoGroup" not in tree.replace("cogroup", "CoGroup")


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)]
    out = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    found = {r.node: r.component for r in out}
    assert len(found) == len(out) == 301
    assert all(c == (0 if n < 1000 else 1000) for n, c in found.items())


def test_fragmentation(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "fragment_id bigint, cluster_id bigint")
    row = fragmentation(df).first()
    assert (row.fragmentation, row.split_warning) == (1.5, False)
    assert fragmentation(df.limit(0)).first().fragmentation is None


MEMBERS = "source string, cluster_id bigint, fragment_id bigint, offset_seconds double, quality_score double"


def references(spark, members, n=3, gap=1.0):
    df = spark.createDataFrame([("s", 1, i, t, q) for i, (t, q) in enumerate(members)], MEMBERS)
    out = select_references(df, ["source", "cluster_id"], n, gap).collect()
    return [r.offset_seconds for r in sorted(out, key=lambda r: r.place)]


def test_references_are_sharp_and_spread(spark):
    assert references(spark, [(1.0, 10.0), (1.2, 9.0), (5.0, 8.0), (9.0, 4.0)]) == [1.0, 5.0, 9.0]


def test_references_fill_up_ignoring_the_gap(spark):
    assert references(spark, [(1.0, 10.0), (1.2, 9.0), (1.4, 8.0), (5.0, 1.0)]) == [1.0, 5.0, 1.2]
    assert references(spark, [(1.0, 1.0), (2.0, 2.0)]) == [2.0, 1.0]


def test_people_are_numbered_and_written(spark, tmp_path):
    rows = [("s", 7, 1, 0.5, 3.0), ("s", 7, 2, 4.0, 2.0), ("s", 9, 3, 1.0, 9.0), ("t", 1, 4, 0.0, 1.0)]
    members = spark.createDataFrame(rows, MEMBERS)
    manifest = people_manifest(order_people(members), select_references(members, ["source", "cluster_id"]))
    (tmp_path / "keep.txt").write_text("untouched")
    for _ in range(2):
        write_people(manifest, str(tmp_path))
    lines = {r.value for r in spark.read.schema("value string, source string").text(f"{tmp_path}/people").collect()}
    assert '{"directory":"person_01","fragments":2,"photos_kept":2,"times_seconds":[0.5,4.0]}' in lines
    assert len(lines) == 3 and (tmp_path / "keep.txt").exists()


def test_best_view_prefers_the_earliest_of_equals(spark):
    schema = (
        "camera_id string, track_id bigint, sequence bigint, det_idx bigint, captured_at timestamp, "
        "box struct<x1:double,y1:double,x2:double,y2:double>, blur_variance double, embedding array<float>, "
        "model_version string, quality struct<passed:boolean>"
    )
    rows = [
        ("c", 1, 3, 0, None, (0.0, 0.0, 1.0, 10.0), 5.0, None, "m", (True,)),
        ("c", 1, 2, 0, None, (0.0, 0.0, 1.0, 10.0), 5.0, None, "m", (True,)),
        ("c", 1, 1, 0, None, (0.0, 0.0, 1.0, 90.0), 9.0, None, "m", (False,)),
    ]
    assert best_per_track(spark.createDataFrame(rows, schema)).first().sequence == 2


def test_numbering_and_carrying_over_ranges(spark):
    rows = [("a" if i % 3 else "b", i, None if i % 4 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(7)
    got = {(r.k, r.i): r.n for r in numbered(df, ["k"], [F.desc("i")], "n").collect()}
    for k in "ab":
        mine = sorted((i for key, i, _ in rows if key == k), reverse=True)
        assert [got[(k, i)] for i in mine] == list(range(1, len(mine) + 1))
    seen = {(r.k, r.i): r.p for r in previous_value(df, ["k"], ["i"], F.col("v"), 10, "p").collect()}
    last = {"a": None, "b": None}
    for k, i, v in rows:
        assert seen[(k, i)] == last[k]
        last[k] = v if v is not None else last[k]


def test_percentiles_interpolate(spark):
    rng = np.random.default_rng(1)
    values = rng.exponential(10, 501)
    df = spark.createDataFrame([("x", float(v)) for v in values] + [("y", 2.0)], "stage string, ms double")
    got = {r.stage: (r.p50, r.p95) for r in exact_percentiles(df, ["stage"], "ms", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["x"] == pytest.approx(tuple(np.percentile(values, [50, 95])))
    assert got["y"] == (2.0, 2.0)


def test_reaches_equals_rounded_products(monkeypatch):
    rng = np.random.default_rng(3)
    a = np.repeat(rng.standard_normal((40, 16)), 3, axis=0)
    a[::3] += 0.2 * rng.standard_normal((40, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    want = np.round(a @ a.T, 12)
    for most in (0, grouping.MOST_RETAKEN):
        monkeypatch.setattr(grouping, "MOST_RETAKEN", most)
        for threshold in (0.3, want[5, 70], want[5, 70] + 1e-12, 1.0, -1.0):
            assert (grouping.reaches(a, a, threshold) == (want >= threshold)).all()


def test_cells_where_order_does_not_matter_meet_once(spark):
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((300, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(vectors)], "fragment_id bigint, model_version string, embedding array<double>")

    def met(left, right):
        a, b = left.column("fragment_id").to_pylist(), right.column("other_id").to_pylist()
        pairs = [(x, y) for x in a for y in b]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    found = blocks.compare_cells(rows, "fragment_id", "other_id", 0.6, met, "a bigint, b bigint", 30, 20, mirrored=True)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    seen, near = {frozenset(p) for p in pairs}, np.argwhere(vectors @ vectors.T >= 0.6)
    assert all(frozenset(p) in seen for p in near.tolist())
    twice = blocks.compare_cells(rows, "fragment_id", "other_id", 0.6, met, "a bigint, b bigint", 30, 20)
    assert len(pairs) < 0.7 * twice.count()


def test_few_edges_are_put_together_in_few_files(spark):
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 600, 3)] + [(1, 7), (7, 31)], "a bigint, b bigint")
        out = connected_components(edges)
        assert len({f.rsplit("/", 1)[-1] for f in out.inputFiles()}) <= spark.sparkContext.defaultParallelism
        found = {r.node: r.component for r in out.collect()}
        assert len(found) == 400 and found[6] == found[30] == found[31] == 0 and found[34] == 33
        whole = cut_lineage(spark.range(900).repartition(40), 900)
        assert len(whole.inputFiles()) <= spark.sparkContext.defaultParallelism and whole.distinct().count() == 900
        assert len(cut_lineage(spark.range(900).repartition(40), 40 * ROWS_A_FILE).inputFiles()) == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

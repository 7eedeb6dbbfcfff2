"""The queries' inputs: every vector is used, and tables may be files or folders of files."""

import pyarrow.parquet as pq
import pytest

from musterline.catalog.inputs import Given
from musterline.catalog.registry import QUERIES, detections, with_faces

SMALL = "/root/testdata/sf0.001"


def test_every_vector_becomes_a_face(spark):
    given = Given(spark, SMALL)
    seen = detections(given)
    faces = with_faces(seen, given.table("embeddings"))
    assert faces.count() == seen.count()
    vectors = given.table("embeddings").count()
    assert seen.selectExpr(f"det_idx % {vectors}").distinct().count() == vectors


@pytest.mark.parametrize(
    "name", ["G04_G08_debounce_stream", "G05_event_stream_with_upgrades", "P05_G10_latest_per_tick_stream"]
)
def test_streams_read_folders_as_they_read_files(spark, tmp_path, name):
    events = pq.read_table(f"{SMALL}/events.parquet")
    (tmp_path / "events.parquet").mkdir()
    for i in range(3):
        part = events.slice(i * 400, 400)
        pq.write_table(part, tmp_path / "events.parquet" / f"part-{i}.parquet")
    parts, whole = (QUERIES[name](Given(spark, folder)) for folder in (str(tmp_path), SMALL))
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))

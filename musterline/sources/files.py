"""Reference photos, rosters and galleries on storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline import schemas
from musterline.cluster import cut_lineage, task_count
from musterline.functions.vectors import require_unit

# The image file types that count as reference photos.
PHOTO_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]

# Names of folders as Spark writes them: what it escapes, and what stands for null and the empty text.
ESCAPED = {chr(i): f"%{i:02X}" for i in [*range(1, 32), *map(ord, "\"#%'*/:=?\\{[]^"), 127]}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

GALLERY_COLUMNS = ["embedding_id", "student_id", "university_id", "embedding", "model_version"]


def list_reference_files(spark: SparkSession, root: str) -> DataFrame:
    """(university_id, path, place) for ``<root>/<id>/<photo>`` and ``<root>/<id>.<suffix>``.

    Only paths are read, never contents. A student's directory comes before a flat file of the
    same name. A root that is a file fails the job.
    """
    with many_small_files(spark):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        paths = cut_lineage(listed.select("path"))
    return reference_paths(paths, root)


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Plans what is read inside for files of hardly any bytes: thousands to a task, and a folder is no task of its own."""
    wanted = {
        "spark.sql.files.openCostInBytes": "4096",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(task_count(spark)),
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lay_out(rows: DataFrame, root: str, folders: list[str], suffix: str) -> None:
    """Adds a file for each ``folders[0]`` below ``root``, in folders by the values of ``folders``.

    Files are few bytes but many: a named number of tasks writes them, and each task puts its own in place,
    so that neither one task nor the driver handles them all. Names and contents are those of Spark's CSV writer,
    which starts processes for every file and folder on a local file system; it writes only where Arrow cannot.
    A task that is repeated writes the same files again.
    """
    dealt = rows.repartition(task_count(rows.sparkSession), folders[0])
    try:
        _store(root)
    except (pa.ArrowException, OSError, ValueError):
        placed = dealt.write.mode("append").option("extension", suffix)
        placed = placed.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        placed.partitionBy(*folders).csv(root)
        return
    job = uuid.uuid4()
    # Of a lone null, to_csv makes no line; so it is given a first value, which is cut off again.
    line = F.to_csv(F.struct(F.lit("-"), *[c for c in rows.columns if c not in folders])).substr(F.lit(3), F.lit(1 << 30)).alias("_line")
    named = dealt.select(*[F.col(c).cast("string").alias(c) for c in folders], line).sortWithinPartitions(*folders)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        name = f"part-{TaskContext.get().partitionId():05d}-{job}.c000.{suffix}"
        rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
        for values, some in groupby(rows, key=lambda row: row[:-1]):
            parts = [f"{c}={v.translate(escaped) if v else NO_VALUE}" for c, v in zip(folders, values)]
            place = "/".join([base, *parts])
            store.create_dir(place)
            with store.open_output_stream(f"{place}/{name}") as out:
                for *_, text in some:
                    if text:  # a lone null has none
                        out.write(f"{text}\n".encode())
        yield from ()

    escaped = str.maketrans(ESCAPED)
    named.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path)


def reference_paths(listed: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "")
    relative = F.expr("substring(_plain, {})".format(len(base) + 2))
    named = listed.withColumn("_plain", plain).withColumn("_relative", relative)
    is_root = F.col("_plain") == base
    checked = F.when(is_root, F.raise_error(F.lit(f"not a directory: {root}")).cast("string")).otherwise(
        F.col("_relative")
    )
    parts = F.split("_relative", "/")
    flat = F.size("_parts") == 1
    name = F.element_at("_parts", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    split = named.withColumn("_relative", checked).withColumn("_parts", parts)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return split.filter((F.size("_parts") <= 2) & suffix.isin(PHOTO_SUFFIXES)).select(
        F.when(flat, stem).otherwise(F.col("_parts")[0]).alias("university_id"),
        "path",
        F.struct(flat.alias("flat"), name.alias("name")).alias("place"),
    )


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Names by university id, both trimmed; the last line of an id in the file wins.

    Line order is (file, split offset, position inside the split), so large files still read in
    parallel.
    """
    lines = spark.read.schema(schemas.ROSTER).option("header", "true").csv(path)
    line = F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )
    placed = lines.select(
        F.trim("university_id").alias("university_id"), F.trim("full_name").alias("full_name"), line.alias("_line")
    )
    return placed.groupBy("university_id").agg(F.max_by("full_name", "_line").alias("full_name"))


def write_gallery(gallery: DataFrame, path: str, mode: str = "error") -> None:
    gallery.select(*GALLERY_COLUMNS).write.mode(mode).parquet(path)


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    """An embedding bundle; vectors that are not normalized fail the job."""
    schema = (
        "embedding_id string, student_id string, university_id string, embedding array<float>, "
        "model_version string"
    )
    stored = spark.read.schema(schema).parquet(path)
    return stored.withColumn("embedding", require_unit(F.col("embedding")))

"""From tracks to people: best view of a track, order of people, and their reference photos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage
from musterline.functions.geometry import box_height
from musterline.functions.scalars import quality_score
from musterline.operators.ordering import numbered


def best_per_track(assessed: DataFrame) -> DataFrame:
    """The sharpest, largest gate-passing view of each track; the earliest of equals."""
    score = quality_score(box_height(F.col("box")), F.col("blur_variance"))
    passing = assessed.filter("quality.passed").withColumn("quality_score", score)
    view = F.struct(
        "sequence", "det_idx", "captured_at", "quality_score", "embedding", "model_version"
    )
    order = F.struct((-F.col("quality_score")).alias("s"), "sequence", "det_idx")
    best = passing.groupBy("camera_id", "track_id").agg(F.min_by(view, order).alias("_view"))
    return best.select("camera_id", "track_id", "_view.*")


def order_people(members: DataFrame) -> DataFrame:
    """``person`` 1, 2, ... per source: most fragments first, then the best view.

    ``members(source, cluster_id, fragment_id, offset_seconds, quality_score)``.
    """
    people = members.groupBy("source", "cluster_id").agg(
        F.count(F.lit(1)).alias("fragments"), F.max("quality_score").alias("best_quality")
    )
    order = [F.desc("fragments"), F.desc("best_quality"), F.asc("cluster_id")]
    return numbered(people, ["source"], order, "person")


def select_references(
    members: DataFrame, keys: list[str], max_per_person: int = 3, min_gap_seconds: float = 1.0
) -> DataFrame:
    """Up to ``max_per_person`` members each, sharpest first and spread in time.

    One round per reference: everybody's best remaining member is taken, then members closer to
    it than the gap drop out. What the gap leaves open is filled by quality alone.
    """
    columns = ["fragment_id", "offset_seconds", "quality_score"]
    order = F.struct((-F.col("quality_score")).alias("q"), "fragment_id")
    best = F.min_by(F.struct(*columns), order).alias("_best")
    remaining, rounds = members.select(*keys, *columns), []
    for place in range(1, max_per_person + 1):
        picks = remaining.groupBy(*keys).agg(best).select(*keys, "_best.*", F.lit(place).alias("place"))
        rounds.append(cut_lineage(picks))
        taken = rounds[-1].select(*keys, F.col("offset_seconds").alias("_taken"))
        far = F.abs(F.col("offset_seconds") - F.col("_taken")) >= min_gap_seconds
        remaining = remaining.join(taken, keys).filter(far).drop("_taken")
    spread = reduce(DataFrame.unionByName, rounds)

    by_quality = Window.partitionBy(*keys).orderBy(F.desc("quality_score"), "fragment_id")
    ranked = members.select(*keys, *columns, F.row_number().over(by_quality).alias("_rank"))
    sharpest = ranked.filter(F.col("_rank") <= 2 * max_per_person)
    spares = sharpest.join(spread.select(*keys, "fragment_id"), keys + ["fragment_id"], "left_anti")
    counted = spread.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_taken"))
    filled = spares.join(counted, keys).withColumn(
        "place", F.col("_taken") + F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    )
    fill = filled.filter(F.col("place") <= max_per_person).select(*keys, *columns, "place")
    return spread.unionByName(fill)


def people_manifest(people: DataFrame, references: DataFrame) -> DataFrame:
    """One JSON line per person: its directory, fragment count and the times of its photos.

    The track ids of a person stay rows of the members table: one person may own a large share
    of all tracks, which must not become one array.
    """
    times = F.transform(
        F.array_sort(F.collect_list(F.struct("place", F.round("offset_seconds", 2).alias("t")))),
        lambda r: r["t"],
    )
    photos = references.groupBy("source", "cluster_id").agg(
        times.alias("times_seconds"), F.count(F.lit(1)).alias("photos_kept")
    )
    described = people.join(photos, ["source", "cluster_id"]).withColumn(
        "directory", F.format_string("person_%02d", "person")
    )
    line = F.to_json(F.struct("directory", "fragments", "photos_kept", "times_seconds"))
    return described.select("source", "person", "cluster_id", "directory", "photos_kept", line.alias("line"))


def person_tracks(people: DataFrame, members: DataFrame) -> DataFrame:
    """(source, person, directory, track_id), one row for every track of every person."""
    named = people.select("source", "cluster_id", "person", F.format_string("person_%02d", "person").alias("directory"))
    return members.join(named, ["source", "cluster_id"]).select("source", "person", "directory", "track_id")


def write_people(
    manifest: DataFrame, root: str, tracks: DataFrame | None = None, head: DataFrame | None = None
) -> None:
    """Replaces the people of an earlier run below ``root`` and nothing else there: a line per person, and
    beside them, where given, the tracks of each person and a line per source about the run."""

    def replace(rows: DataFrame, folder: str) -> None:
        lines = rows.select("source", "line").write.mode("overwrite").partitionBy("source")
        lines.option("partitionOverwriteMode", "static").text(f"{root}/{folder}")

    replace(manifest, "people")
    for rows, folder in ((tracks, "tracks"), (head, "head")):
        if rows is not None:
            told = [c for c in rows.columns if c != "source"] if folder == "tracks" else rows.columns
            replace(rows.withColumn("line", F.to_json(F.struct(*told))), folder)

"""Clips to people: track, gate, best view per track, single linkage, references."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage
from musterline.functions.scalars import offset_seconds
from musterline.operators.gate import assess_quality
from musterline.operators.grouping import fragmentation, single_linkage
from musterline.operators.ordering import numbered
from musterline.operators.references import (
    best_per_track,
    order_people,
    people_manifest,
    person_tracks,
    select_references,
)
from musterline.operators.tracking import assign_tracks
from musterline.settings import QualitySettings, TrackingSettings


class Extracted(NamedTuple):
    members: DataFrame
    people: DataFrame
    references: DataFrame
    manifest: DataFrame
    summary: DataFrame  # the head of the manifest, a row per source
    tracks: DataFrame


def extract_people(
    detections: DataFrame,
    frames: DataFrame,
    clips: DataFrame,
    quality: QualitySettings = QualitySettings(),
    similarity_threshold: float = 0.5,
    max_per_person: int = 3,
) -> Extracted:
    """Enrollment candidates of every clip, one person per group of similar track fragments.

    ``detections`` belong to the sampled ``frames``; ``clips(camera_id, native_fps)``. Every frame
    ages the tracks here. Fragments of different clips are never grouped.
    """
    tracked = assign_tracks(detections, TrackingSettings(), frames)
    best = best_per_track(assess_quality(tracked, quality)).join(clips.select("camera_id", "native_fps"), "camera_id")
    fragments = best.select(
        F.col("camera_id").alias("source"),
        "track_id",
        offset_seconds(F.col("sequence"), F.col("native_fps")).alias("offset_seconds"),
        "quality_score",
        "embedding",
        F.concat_ws("|", "camera_id", "model_version").alias("model_version"),
    )
    order = [F.col("source"), F.col("track_id")]
    named = cut_lineage(numbered(fragments, [], order, "fragment_id"))
    clusters = single_linkage(named, similarity_threshold)
    members = cut_lineage(named.drop("embedding", "model_version").join(clusters, "fragment_id"))
    people = order_people(members)
    references = select_references(members, ["source", "cluster_id"], max_per_person)
    return Extracted(
        members,
        people,
        references,
        people_manifest(people, references),
        members.groupBy("source").agg(
            F.lit(similarity_threshold).alias("similarity_threshold"),
            F.count(F.lit(1)).alias("tracks_found"),
            F.countDistinct("cluster_id").alias("people_found"),
        ),
        person_tracks(people, members),
    )


def overall_fragmentation(extracted: Extracted) -> DataFrame:
    return fragmentation(extracted.members)

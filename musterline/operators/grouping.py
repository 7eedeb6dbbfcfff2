"""Track fragments of one person: similarity links and single-linkage groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, discard
from musterline.operators.blocks import RESIDENT_BYTES, TILE_ROWS, compare_cells, compare_resident, resident, tiles, unit_matrix

LINK_BLOCK_ROWS = 8_000
COPIES_MERGE_BELOW = 0.999
SIMILARITY_DECIMALS = 12
MOST_RETAKEN = 1 << 15


def _links(threshold: float):
    """Per left fragment: how many other right fragments reach the threshold, and the best one."""

    def compute(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("other_id")
        ids, others = (
            np.array(t.column(c).to_pylist(), dtype=np.int64)
            for t, c in ((left, "fragment_id"), (right, "other_id"))
        )
        a, b = unit_matrix(left, "embedding"), unit_matrix(right, "embedding")
        counts, best, best_score = [], [], []
        for start in tiles(len(ids) if len(others) else 0):
            rows = ids[start : start + TILE_ROWS]
            scores = np.round(a[start : start + TILE_ROWS] @ b.T, SIMILARITY_DECIMALS)
            scores[rows[:, None] == others[None, :]] = -2.0
            near = scores >= threshold
            top = scores.argmax(axis=1)
            counts.extend(near.sum(axis=1).tolist())
            best.extend(others[top].tolist())
            best_score.extend(scores[np.arange(len(rows)), top].tolist())
        kept = ids[: len(counts)]
        return pa.table(
            {
                "fragment_id": pa.array(kept, pa.int64()),
                "links": pa.array(counts, pa.int64()),
                "other_id": pa.array(best, pa.int64()),
                "similarity": pa.array(best_score, pa.float64()),
            }
        )

    return compute


def _compared(
    left: DataFrame, held: pa.Table | None, threshold: float, compute, schema: str, block_rows: int, mirrored: bool = False
) -> DataFrame:
    """``compute`` on all fragments and all that can be similar: at hand in every task if they are few, else by cells."""
    if held is None:
        return compare_cells(left, "fragment_id", "other_id", threshold, compute, schema, block_rows, mirrored=mirrored)
    others = held.rename_columns(["other_id", *held.column_names[1:]])
    return compare_resident(left, others, "model_version", "fragment_id", compute, schema)


def fragment_links(
    fragments: DataFrame, threshold: float = 0.5, block_rows: int = LINK_BLOCK_ROWS, resident_bytes: int = RESIDENT_BYTES
) -> DataFrame:
    """For each fragment the number of others at or above the threshold and the nearest of them.

    The pairs themselves are counted inside the tasks and never become rows, so a large group of
    near-copies costs no more than any other. Fragments of different models never meet. Above ``resident_bytes``
    of vectors, a fragment is compared only with the blocks that can hold a neighbour of it.
    """
    usable = fragments.filter(F.col("embedding").isNotNull()).select("fragment_id", "model_version", "embedding")
    held = resident(usable, ["fragment_id"], resident_bytes)
    schema = "fragment_id bigint, links bigint, other_id bigint, similarity double"
    parts = _compared(usable, held, threshold, _links(threshold), schema, block_rows)
    linked = parts.filter(F.col("links") > 0)
    nearest = F.max(F.struct("similarity", (-F.col("other_id")).alias("minus_id")))
    return (
        linked.groupBy("fragment_id")
        .agg(F.sum("links").alias("links"), nearest.alias("_nearest"))
        .select(
            "fragment_id",
            "links",
            (-F.col("_nearest.minus_id")).alias("nearest_id"),
            F.col("_nearest.similarity").alias("similarity"),
        )
    )


def reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rounded similarities of two sets of unit rows reach the threshold.

    Products of half the width decide where they are further from it than they can be wrong; the rest are taken again.
    """
    slack = (a.shape[1] + 4) * float(np.finfo(np.float32).eps)
    low, b_low, near = a.astype(np.float32), b.astype(np.float32), np.empty((len(a), len(b)), dtype=bool)
    for start in tiles(len(a)):
        rows = slice(start, start + TILE_ROWS)
        scores = low[rows] @ b_low.T
        near[rows] = scores >= threshold - slack
        open_ = np.flatnonzero(near[rows])
        open_ = open_[scores.ravel()[open_] <= threshold + slack]
        if len(open_) > MOST_RETAKEN:
            near[rows] = np.round(a[rows] @ b.T, SIMILARITY_DECIMALS) >= threshold
        else:
            i, j = np.divmod(open_, len(b))
            scores = np.einsum("ij,ij->i", a[rows][i], b[j])
            near[rows].ravel()[open_] = np.round(scores, SIMILARITY_DECIMALS) >= threshold
    return near


def _stars(threshold: float):
    """Edges that connect one pair of blocks exactly as all its similar pairs would.

    Breadth-first search over the similarity matrix; every fragment found is tied to the smallest
    of its component, so there is at most one edge per fragment.
    """

    def compute(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.array(left.column("fragment_id").to_pylist(), dtype=np.int64)
        others = np.array(right.column("other_id").to_pylist(), dtype=np.int64)
        hubs, tied = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(ids) and len(others):
            a, b = unit_matrix(left, "embedding"), unit_matrix(right, "embedding")
            near = reaches(a, b, threshold)
            linked = np.flatnonzero(near.any(axis=1))
            # Bits, eight to a byte, so that a fragment's links are read in one short run from either side.
            adjacency = (np.packbits(near, axis=1), np.ascontiguousarray(np.packbits(near, axis=0).T))
            del near
            names = (ids, others)
            unseen = tuple(np.packbits(np.ones(len(side), dtype=bool)) for side in names)
            for root in linked.tolist():
                bit = 128 >> (root & 7)
                if not unseen[0][root >> 3] & bit:
                    continue
                unseen[0][root >> 3] ^= bit
                waiting, component = [(0, root)], [ids[root : root + 1]]
                while waiting:
                    side, node = waiting.pop()
                    found = adjacency[side][node] & unseen[1 - side]
                    if found.any():
                        unseen[1 - side][:] ^= found
                        reached = np.flatnonzero(np.unpackbits(found))
                        component.append(names[1 - side][reached])
                        waiting.extend((1 - side, n) for n in reached.tolist())
                members = np.unique(np.concatenate(component))
                hubs.append(np.full(len(members) - 1, members[0]))
                tied.append(members[1:])
        return pa.table({"a": np.concatenate(hubs), "b": np.concatenate(tied)})

    return compute


def _written(edges: DataFrame, most_rows: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their count and hash sum, which the write itself takes in passing.
    Equal sets of edges give equal sums."""
    seen = Observation()
    total = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    table = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), most_rows)
    return table, (seen.get["n"], seen.get["total"])


def connected_components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(node, component), the component being its smallest node, for all nodes with an edge.

    Alternating star contraction (Kiveris et al., 2014): each round ties larger neighbours, then
    smaller ones, to the smallest node in sight. Minima are combined map-side. A round is one job
    that writes its table; the table of the round before is deleted once it is superseded. No round has more edges
    than the one before; ``most_edges`` is a bound for the first, if one is known.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    stars, seen = _written(edges.filter("a <> b").select(hi, lo).distinct(), most_edges)
    while seen[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least_of = both.groupBy("u").agg(F.min("v").alias("_m"))
        least_of = least_of.select("u", F.least("u", "_m").alias("m"))
        large = both.filter("v > u").join(least_of, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(smallest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = tied.union(smallest.select("hi", F.col("m").alias("lo"))).distinct()
        before = stars
        stars, now = _written(small, seen[0])
        discard(before)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def single_linkage(
    fragments: DataFrame, threshold: float = 0.5, block_rows: int = LINK_BLOCK_ROWS, resident_bytes: int = RESIDENT_BYTES
) -> DataFrame:
    """(fragment_id, cluster_id): a cluster is named after its smallest fragment id.

    Every task or piece gives a spanning forest of the links it sees, never the pairs. Where vectors are compared by
    cells, exact copies of a vector are one node in the graph. Fragments without a vector are left out;
    one without any link is a cluster of its own.
    """
    usable = fragments.filter(F.col("embedding").isNotNull()).select("fragment_id", "model_version", "embedding")
    held = resident(usable, ["fragment_id"], resident_bytes)
    if held is None and threshold < COPIES_MERGE_BELOW:
        same = ["model_version", "embedding"]
        nodes = usable.groupBy(*same).agg(F.min("fragment_id").alias("node"))
        member = usable.join(nodes, same).select("fragment_id", "node")
        distinct_vectors = nodes.withColumnRenamed("node", "fragment_id")
    else:
        member = usable.select("fragment_id", F.col("fragment_id").alias("node"))
        distinct_vectors = usable
    edges = _compared(distinct_vectors.select("fragment_id", "model_version", "embedding"), held, threshold, _stars(threshold), "a bigint, b bigint", block_rows, True)
    components = connected_components(edges)
    return member.join(components, "node", "left").select(
        "fragment_id", F.coalesce("component", "node").alias("cluster_id")
    )


def fragmentation(clusters: DataFrame) -> DataFrame:
    """Tracks per person; null when there are no people. Above 1.5 the tracker splits people up."""
    people = F.countDistinct("cluster_id")
    counted = clusters.agg(F.count(F.lit(1)).alias("tracks_found"), people.alias("people_found"))
    ratio = F.col("tracks_found") / F.nullif(F.col("people_found"), F.lit(0))
    return counted.withColumn("fragmentation", ratio).withColumn("split_warning", ratio > 1.5)

"""SimHash near-duplicates: fingerprints, and components linked by multi-index hashing.

A fingerprint is cut into three segments. Two fingerprints that differ in at most four bits differ in at
most one bit of some segment. So every fingerprint is filed under the value of each of its segments, and
looks under that value and under the values of the Hamming ball of radius one around it. Of two
fingerprints that differ in a segment's bit, the one that has a 0 there looks for the other. All that
meet under a value are compared over all 64 bits.

Only distinct fingerprints take part. What meets under one value is compared inside a task that emits a
spanning forest of the links, never the pairs. A value with more than ``SLICE`` fingerprints is dealt to
slices, every slice against every slice, so no task has to hold a hot value.

Defined results: a null or wordless text has fingerprint 0, linked like any other. Every row gets a row,
repeated ones too. ``component_id`` is the smallest doc_id reachable, its own included; null ids count for
nothing, and a component without any other id has null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, join_small, task_count
from musterline.llm import near_copies
from musterline.llm.tables import row_key
from musterline.operators.grouping import connected_components

SHINGLE_WORDS = 4
SEED = 42
HASHES_AT_ONCE = 1 << 16
MOST_BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # shift and width; MOST_BITS // 3 is the radius, 1
SLICE = 2_000
FEW_PAIRS = 64


def fingerprint_of(text: bytes) -> int:
    """The 64 bits of one text: a bit is set if it is set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    reach = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[reach - 1 :])
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in spans), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprints(documents: DataFrame, names: list[Column] | None = None) -> DataFrame:
    """(doc_id, fingerprint bigint), the 64 bits read as a signed number; or bigint columns ``names`` in place of doc_id."""
    texts = documents.select(*(names or [F.col("doc_id").cast("bigint")]), F.col("text").cast("binary"))
    kept = texts.columns[:-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t or b"") for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in kept), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "fingerprint"])

    return texts.mapInArrow(measure, ", ".join(f"{c} bigint" for c in [*kept, "fingerprint"]))


def _value(number: int, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1))
    return part + F.lit(number << 22)


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its segment values (looks = 0), and where it looks (looks = 1)."""
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        for number, (shift, width) in enumerate(SEGMENTS):
            values = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            places = [values] + [(values | np.uint64(1 << j)) for j in range(width)]
            fits = [np.ones(len(values), bool)] + [(values >> np.uint64(j)) & np.uint64(1) == 0 for j in range(width)]
            key = np.concatenate([p[f] for p, f in zip(places, fits)]).astype(np.int64) + (number << 22)
            whose = np.concatenate([prints[f] for f in fits]).view(np.int64)
            looks = np.repeat(np.array([0] + [1] * width, np.int8), [int(f.sum()) for f in fits])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(whose), pa.array(looks)], names=["key", "fingerprint", "looks"]
            )


def forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of at most ``MOST_BITS`` that join all that such links join, fewer than there are prints."""
    left, edges = np.unique(prints), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= MOST_BITS
            if near.any():
                found = left[near]
                edges.append((np.full(len(found), node), found))
                queue.extend(found)
                left = left[~near]
    return edges


def meet(key: np.ndarray, prints: np.ndarray, looks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forest links of whole groups of one key each; rows are sorted by key, then looks."""
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    filed = np.add.reduceat((looks == 0).astype(np.int64), starts)
    pairs = filed * sizes
    open_ = (filed > 0) & (sizes > 1)
    few = open_ & (pairs <= FEW_PAIRS)
    counts = pairs[few]
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    group = np.repeat(np.flatnonzero(few), counts)
    a, b = starts[group] + inside // sizes[group], starts[group] + inside % sizes[group]
    link = (a < b) & (np.bitwise_count(prints[a] ^ prints[b]) <= MOST_BITS) & (prints[a] != prints[b])
    edges = [(prints[a[link]], prints[b[link]])]
    for g in np.flatnonzero(open_ & ~few):
        edges.extend(forest(prints[starts[g] : starts[g] + sizes[g]]))
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None

    def out(part):
        a, b = meet(*part)
        columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "_i", "_j", "fingerprint", "looks")]
        part = (np.stack(columns[:3], axis=1), columns[3].view(np.uint64), columns[4])
        if held is not None:
            part = tuple(np.concatenate([x, y]) for x, y in zip(held, part))
        if not len(part[0]):
            continue
        last = np.flatnonzero((part[0] != part[0][-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield out(tuple(x[:cut] for x in part))
        held = tuple(x[cut:] for x in part)
    if held is not None and len(held[0]):
        yield out(held)


def links(prints: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(a, b): links between the distinct ``fingerprint`` values that connect all that are linked."""
    values = F.explode(F.array(*[_value(k, *s) for k, s in enumerate(SEGMENTS)])).alias("key")
    counts = prints.select(values).groupBy("key").count().filter(F.col("count") > slice_rows)
    hot = counts.select("key", F.ceil(F.col("count") / slice_rows).cast("int").alias("_slices"))
    filed = join_small(prints.mapInArrow(_ball, "key bigint, fingerprint bigint, looks tinyint"), hot, ["key"], "left")
    all_slices = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)
    own = F.pmod(F.xxhash64("fingerprint"), F.coalesce("_slices", F.lit(1))).cast("int")

    def place(i, j, looks):
        return F.struct(i.alias("_i"), j.alias("_j"), F.lit(looks).cast("tinyint").alias("looks"))

    as_filed = F.transform(all_slices, lambda s: place(F.col("_own"), s, 0))
    as_looking = F.transform(all_slices, lambda s: place(s, F.col("_own"), 1))
    split = F.col("_slices").isNotNull()
    places = F.when((F.col("looks") == 0) & split, F.concat(as_filed, as_looking))
    places = places.when(F.col("looks") == 0, as_filed).otherwise(as_looking)
    dealt = filed.withColumn("_own", own).select("key", "fingerprint", F.explode(places).alias("_at"))
    dealt = dealt.select("key", "_at.*", "fingerprint")
    where = ["key", "_i", "_j"]
    met = dealt.repartition(task_count(prints.sparkSession), *where).sortWithinPartitions(*where, "looks")
    return met.mapInArrow(_matches, "a bigint, b bigint")


def _tied(documents: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of every row, and (fingerprint, component, component_id) of every fingerprint."""
    prints = cut_lineage(with_fingerprints(documents))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(links(distinct.select("fingerprint"), slice_rows))
    tied = distinct.join(nodes, distinct["fingerprint"] == nodes["node"], "left")
    tied = tied.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    tied = cut_lineage(tied)
    named = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, tied.join(named, "component").select("fingerprint", "component", "component_id")


def components(documents: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id) for every row."""
    prints, tied = _tied(documents, slice_rows)
    return prints.join(tied, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _grouped(documents: DataFrame, slice_rows: int) -> DataFrame:
    """(_k1, _k2, doc_id, n, component) of every distinct row: what links of fingerprints and of near copies connect
    is one component; ``n`` counts the rows of the key."""
    key = near_copies.KEY
    many = documents.count()
    prints = cut_lineage(with_fingerprints(documents, row_key("doc_id", "text")).distinct(), many)
    distinct = cut_lineage(prints.select("fingerprint").distinct(), many)
    nodes = connected_components(links(distinct, slice_rows)).withColumnRenamed("component", "print_component")
    linked = distinct.join(nodes, distinct["fingerprint"] == nodes["node"], "left")
    linked = linked.select("fingerprint", F.coalesce("print_component", "fingerprint").alias("print_component"))
    near = cut_lineage(near_copies.tied(documents, slice_rows), many)
    # Components of near copies that share one of fingerprints are tied to the smallest of them.
    sides = prints.join(linked, "fingerprint").select(*key, "print_component").join(near.select(*key, "component"), key)
    sides = cut_lineage(sides.select("print_component", "component").distinct(), many)
    hubs = sides.groupBy("print_component").agg(F.min("component").alias("a"))
    edges = sides.join(hubs, "print_component").select("a", F.col("component").alias("b")).filter("a <> b")
    merged = connected_components(edges, many).withColumnRenamed("component", "merged")
    found = near.join(merged, near["component"] == merged["node"], "left")
    return found.select(*key, "doc_id", "n", F.coalesce("merged", "component").alias("component"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each(documents: DataFrame, slice_rows: int = near_copies.SLICE, fingerprints: bool = False) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, with its columns as they were.

    A group is what near copies connect (``near_copies``: five-word shingles, Jaccard similarity 0.8 or more); with
    ``fingerprints``, links of fingerprints (at most ``MOST_BITS`` differing bits) connect as well. Null ids come last; of equal ids that with the smallest
    row key stays, and of rows equal in id and text the first by their JSON form. Survivors are chosen by their keys
    alone, by partial aggregation: a group that holds much of the table is never gathered, and texts are not shuffled
    unless very many rows go.
    """
    columns = documents.columns
    many = documents.count()
    tied = cut_lineage((_grouped if fingerprints else near_copies.tied)(documents, slice_rows), many)
    key = near_copies.KEY
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *key)
    first = tied.groupBy("component").agg(F.min(order).alias("_o")).select(*[F.col(f"_o.{k}") for k in key], F.lit(True).alias("_first"))
    named = tied.join(first, key, "left").select(*key, F.col("_first").isNotNull().alias("_first"), "n")
    # Most rows stay: only keys that go, or that stand for several rows, are looked up.
    special = cut_lineage(named.filter("not _first or n > 1").drop("n"), many)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    keyed = documents.select(*row_key("doc_id", "text"), row)
    marked = join_small(keyed, special, key, "left", near_copies.FEW_NODES)
    repeated = marked.filter("_first").groupBy(*key).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    kept = marked.filter("_first is null").select("_row").union(repeated)
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])

"""Repeated byte strings by a hash-compared suffix sort.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts elsewhere, in the same text or
another. Deciding that means sorting the suffixes of the corpus by their first ``LENGTH`` bytes and looking
at neighbours. The sort is split and thinned first, without loss:

* Every window of ``LENGTH`` bytes has an anchor, its smallest ``GRAM``-byte hash (the leftmost of equals).
  Equal windows have equal anchors at equal places. Consecutive windows with one anchor form a segment; only
  segments whose anchor occurs again can hold repeated windows.
* Equal segments are copies. Their windows are all repeated, and one of them stands for all in the sort.
* What is left is dealt by anchor, so equal windows meet in one task. Under an anchor with more than
  ``SEGMENTS`` different segments, windows are counted by a hash of their bytes; two of each repeated one go
  on, alone and dealt by that hash, and what the sort finds of them holds for all windows of the hash.

In a task, suffixes are put in order by their first eight bytes, and ties by a mergesort whose comparison
finds the longest common extension by binary search over prefix polynomial hashes (modulo 2**64, with random
values for bytes). Neighbours that agree in ``LENGTH`` bytes by hash are compared byte by byte; should a
hash ever collide, the chunk is sorted again by its bytes.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` are kept whole. Equal rows are
repeats of each other and both lose their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, task_count
from musterline.llm.tables import row_key

LENGTH = 200
GRAM = 40
SEGMENTS = 4_096
WINDOWS_AT_ONCE = 1 << 22
CHUNK_BYTES = 1 << 21
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(20011).integers(1, 1 << 63, 256, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 24) - 1)
KEY = ["_k1", "_k2"]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None:
        known = np.ones(1, dtype=np.uint64)
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    _powers[base] = known
    return known[:n]


class Prefixes:
    """Prefix polynomial hashes of bytes, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(INVERSE, len(data) + 1)

    def spans(self, starts: np.ndarray, length) -> np.ndarray:
        """Hashes of spans, independent of their place."""
        return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]

    def all_spans(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return (self.sums[length:] - self.sums[:count]) * self.inverse[:count]


def mixed(hashes: np.ndarray) -> np.ndarray:
    out = hashes ^ (hashes >> np.uint64(31))
    out = out * MIX
    return out ^ (out >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, in time independent of ``width``."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    onwards = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], onwards[width - 1 : width - 1 + count])


def segments_of(text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor hash, segment hash, first window, last window, anchor's place) of a whole text."""
    windows = len(text) - LENGTH + 1
    for at in range(0, max(windows, 0), WINDOWS_AT_ONCE):
        part = np.frombuffer(text, dtype=np.uint8)[at : at + WINDOWS_AT_ONCE + LENGTH - 1]
        grams = mixed(Prefixes(part).all_spans(GRAM))
        placed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(placed, LENGTH - GRAM + 1)
        firsts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        lasts = np.concatenate([firsts[1:], [len(least)]]) - 1
        anchors = (least[firsts] & PLACE).astype(np.int64)
        hashes = grams[anchors].view(np.int64).tolist()
        for anchor, first, last, place in zip(hashes, firsts.tolist(), lasts.tolist(), anchors.tolist()):
            first, last, place = first + at, last + at, place + at
            shape = (place - first) << 8 | (last - first)
            whole = xxhash.xxh3_64_intdigest(text[first : last + LENGTH], shape)
            yield anchor, whole - (1 << 64) if whole >> 63 else whole, first, last, place


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(c, pa.int64()) for c in ("_k1", "_k2", "anchor", "segment")]
        + [(c, pa.int32()) for c in ("first", "last", "place")]
    )
    for batch in batches:
        k1, k2, texts = (batch.column(c).to_pylist() for c in ("_k1", "_k2", "text"))
        rows = []
        for a, b, text in zip(k1, k2, texts):
            rows.extend((a, b, *s) for s in segments_of(text))
            if len(rows) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


class Suffixes:
    """Suffixes of one chunk of bytes, each at least ``length`` bytes long, sorted by that many bytes."""

    def __init__(self, data: bytes, starts: np.ndarray, length: int = LENGTH):
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.hashes = Prefixes(self.data)
        self.starts, self.length = starts.astype(np.int64), length

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common extension of positions, at most ``length``, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.spans(a, middle) == self.hashes.spans(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_same: bool) -> np.ndarray:
        """Whether the suffix at a comes before that at b (or is the same, if asked)."""
        extent = self.common(a, b)
        inside = np.minimum(extent, self.length - 1)
        less = self.data[a + inside] < self.data[b + inside]
        return np.where(extent >= self.length, or_same, less)

    def ordered(self) -> np.ndarray:
        """The positions in order."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        heads = np.zeros(len(self.starts), np.uint64)
        for i in range(min(8, self.length)):
            heads = heads << np.uint64(8) | padded[self.starts + i].astype(np.uint64)
        by_head = np.argsort(heads, kind="stable")
        order, heads = self.starts[by_head], heads[by_head]
        cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(order) else np.zeros(0, int)
        sizes = np.diff(np.concatenate([cuts, [len(order)]]))
        self.run = np.repeat(np.arange(len(cuts)), sizes)
        tied = sizes > 1
        cuts, sizes, width = cuts[tied], sizes[tied], 1
        while len(cuts):
            self._merge(order, cuts, sizes, width)
            width *= 2
            more = sizes > width
            cuts, sizes = cuts[more], sizes[more]
        return order

    def _merge(self, order: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, width: int) -> None:
        """Merges neighbouring parts of ``width`` in all runs at once; each element finds its rank in
        the other part by binary search."""
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start, size = np.repeat(cuts, sizes), np.repeat(sizes, sizes)
        pair = inside // (2 * width) * (2 * width)
        on_left = inside - pair < width
        low = np.where(on_left, np.minimum(pair + width, size), pair)
        high = np.where(on_left, np.minimum(pair + 2 * width, size), np.minimum(pair + width, size))
        other, own = low.copy(), order[start + inside]
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            probe = order[start[active] + middle]
            left = on_left[active]
            ahead = np.empty(len(active), bool)
            ahead[left] = self.before(probe[left], own[active][left], False)
            ahead[~left] = self.before(probe[~left], own[active][~left], True)
            low[active] = np.where(ahead, middle + 1, low[active])
            high[active] = np.where(ahead, high[active], middle)
            active = active[low[active] < high[active]]
        rank = (inside - pair) - np.where(on_left, 0, width) + (low - other)
        order[start + pair + rank] = own

    def repeated(self) -> np.ndarray:
        """The positions whose first ``length`` bytes also start elsewhere among the suffixes."""
        order = self.ordered()
        if len(order) < 2:
            return order[:0]
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(self.run[1:] == self.run[:-1])
        near = near[self.hashes.spans(a[near], self.length) == self.hashes.spans(b[near], self.length)]
        views = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        for at in range(0, len(near), 1 << 15):
            part = near[at : at + (1 << 15)]
            if not np.array_equal(views[a[part]], views[b[part]]):
                return self._by_bytes(views)
        return np.unique(np.concatenate([a[near], b[near]]))

    def _by_bytes(self, views: np.ndarray) -> np.ndarray:
        strings = np.ascontiguousarray(views[self.starts]).view(f"V{self.length}").ravel()
        _, inverse, counts = np.unique(strings, return_inverse=True, return_counts=True)
        return np.sort(self.starts[counts[inverse] > 1])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes to be sorted: those of whole segments, or of single windows under a hot anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("segment", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        rows = []
        for text, segments in zip(batch.column("text").to_pylist(), batch.column("segments").to_pylist()):
            rows.extend((s["anchor"], s["part"], s["segment"], text[s["first"] : s["last"] + LENGTH]) for s in segments)
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, at, window) of every window of the segments, ``window`` a hash of its bytes and of its
    anchor's place in it."""
    names = ["anchor", "segment", "at", "window"]

    def batch_of(parts):
        hashes, *others = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*others, hashes.view(np.int64))], names=names)

    for batch in batches:
        parts, size = [], 0
        for text, segments in zip(batch.column("text").to_pylist(), batch.column("segments").to_pylist()):
            for s in segments:
                hashes = [xxhash.xxh3_64_intdigest(text[i : i + LENGTH], s["place"] - i) for i in range(s["first"], s["last"] + 1)]
                count = len(hashes)
                where = np.full(count, s["anchor"]), np.full(count, s["segment"]), np.arange(count, dtype=np.int16)
                parts.append((np.array(hashes, np.uint64), *where))
                size += count
                if size > 100_000:
                    yield batch_of(parts)
                    parts, size = [], 0
        if parts:
            yield batch_of(parts)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows (from, to) of each segment; rows come sorted by anchor and part."""
    held: list[tuple] = []
    group, size = None, 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("anchor", "part", "segment", "bytes"))
        for anchor, part, segment, data in zip(*columns):
            if group != (anchor, part):
                if size >= CHUNK_BYTES:
                    yield _repeated_windows(held)
                    held, size = [], 0
                group = (anchor, part)
            held.append((anchor, segment, data))
            size += len(data)
    if held:
        yield _repeated_windows(held)


def _repeated_windows(held: list[tuple]) -> pa.RecordBatch:
    data = b"".join(h[2] for h in held)
    ends = np.cumsum([len(h[2]) for h in held])
    begins = ends - [len(h[2]) for h in held]
    starts = np.concatenate([b + np.arange(len(h[2]) - LENGTH + 1) for b, h in zip(begins, held)])
    found = Suffixes(data, starts).repeated()
    whose = np.searchsorted(ends, found, side="right")
    opens = np.concatenate([[True], (np.diff(found) != 1) | (np.diff(whose) != 0)]) if len(found) else np.zeros(0, bool)
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(found)]]) - 1 if len(found) else first
    owner = whose[first]
    anchors, segments = (np.array([h[i] for h in held], dtype=np.int64)[owner] for i in (0, 1))
    columns = [anchors, segments, found[first] - begins[owner], found[last] - begins[owner]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)], names=["anchor", "segment", "from", "to"]
    )


def _gathered(rows: DataFrame, segments: DataFrame, more: str) -> DataFrame:
    """The texts of ``segments``, each with the segments to be taken from it."""
    own = F.collect_list(F.struct("anchor", "segment", "first", "last", more)).alias("segments")
    return rows.join(segments.groupBy(*KEY).agg(own), KEY).select("text", "segments")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """The rows as (_k1, _k2, doc_id, text binary) with ``spans``: covered bytes as (start, end), unmerged,
    null where nothing is covered."""
    rows = documents.select(*row_key("doc_id", "text"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    fields = "_k1 bigint, _k2 bigint, anchor bigint, segment bigint, first int, last int, place int"
    found = cut_lineage(rows.select(*KEY, "text").mapInArrow(_segments, fields))
    again = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("segment") != F.max("segment")).alias("mixed")
    )
    # A table of its own, as only a join of two plain shuffles has its hot anchors split.
    again = cut_lineage(again.filter("n > 1").select("anchor", "mixed"))
    open_ = cut_lineage(found.join(again, "anchor"))
    one = [F.first(c).alias(c) for c in (*KEY, "first", "last", "place", "mixed")]
    kinds = cut_lineage(open_.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), *one))
    copied = kinds.filter("n > 1").select(
        "anchor", "segment", F.lit(0).alias("from"), (F.col("last") - F.col("first")).alias("to")
    )
    to_sort = kinds.filter("mixed").select("anchor", "segment", *KEY, "first", "last", "place")
    hot = to_sort.groupBy("anchor").count().filter(F.col("count") > SEGMENTS)
    hot = cut_lineage(hot.select("anchor", F.ceil(F.col("count") * (LENGTH - GRAM + 1) / SEGMENTS).cast("int").alias("parts")))
    to_sort, of_hot = to_sort.join(hot, "anchor", "left_anti"), cut_lineage(to_sort.join(hot.select("anchor"), "anchor"))

    # Under a hot anchor equal windows are counted, and two of each are sorted and compared for all.
    windows = _gathered(rows, of_hot, "place").mapInArrow(_windows, "anchor bigint, segment bigint, at smallint, window bigint")
    windows = cut_lineage(windows)
    one = F.struct("segment", "at")
    again = windows.groupBy("anchor", "window").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    again = cut_lineage(again.filter("low <> high"))
    two = again.select("anchor", "window", F.explode(F.array("low", "high")).alias("w")).select("anchor", "window", "w.*")
    part = F.pmod(F.xxhash64("window"), F.col("parts")).cast("int")
    two = two.join(of_hot, ["anchor", "segment"]).join(hot, "anchor").select(
        "anchor", F.col("window").alias("segment"), *KEY, (F.col("first") + F.col("at")).alias("first"), part.alias("part")
    )
    two = two.withColumn("last", F.col("first"))
    to_sort = to_sort.drop("place").withColumn("part", F.lit(0)).unionByName(two)
    slices = _gathered(rows, to_sort, "part").mapInArrow(_slices, "anchor bigint, part int, segment bigint, bytes binary")
    slices = slices.repartition(task_count(documents.sparkSession), "anchor", "part").sortWithinPartitions("anchor", "part")
    matched = cut_lineage(slices.mapInArrow(_sorted, "anchor bigint, segment bigint, from int, to int"))
    same = cut_lineage(matched.join(hot, "anchor", "left_semi").select("anchor", F.col("segment").alias("window")).distinct())
    # Windows of one segment are less than LENGTH apart, so what they cover is one span.
    marked = windows.join(same, ["anchor", "window"]).groupBy("anchor", "segment").agg(
        F.min("at").cast("int").alias("from"), F.max("at").cast("int").alias("to")
    )
    marks = copied.unionByName(matched.join(hot, "anchor", "left_anti")).unionByName(marked)
    covered = open_.join(marks, ["anchor", "segment"]).select(
        *KEY,
        F.struct(
            (F.col("first") + F.col("from")).alias("start"), (F.col("first") + F.col("to") + LENGTH).alias("end")
        ).alias("span"),
    )
    spans = covered.groupBy(*KEY).agg(F.collect_list("span").alias("spans"))
    return rows.join(spans, KEY, "left")


def without_repeats(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, text (binary), kept (binary, the bytes left), removed (maximal runs as start, end)."""

    @F.pandas_udf("kept binary, removed array<struct<start: int, end: int>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        kept, removed = [], []
        for text, own in zip(texts, spans):
            if text is None or own is None:
                kept.append(None)
                removed.append(None)
                continue
            runs: list[list[int]] = []
            for start, end in sorted((int(s["start"]), int(s["end"])) for s in own):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([start, end])
            edges = [0, *[x for r in runs for x in r], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append([{"start": a, "end": b} for a, b in runs])
        return pd.DataFrame({"kept": pd.Series(kept, dtype=object), "removed": pd.Series(removed, dtype=object)})

    rows = repeated_spans(documents)
    rows = rows.withColumn("_cut", cut(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")))
    nothing = F.array().cast("array<struct<start: int, end: int>>")
    return rows.select(
        "doc_id",
        "text",
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.col("_cut.kept")).alias("kept"),
        F.coalesce("_cut.removed", nothing).alias("removed"),
    )

"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

A SimHash of 64 bits cannot find these: at 0.8 two of them differ in about ten bits. So the sets themselves
are compared, after a prefix filter that loses nothing: with all shingles in one fixed order, two sets of that
similarity share a shingle among the first fifth of each (and one, at the first such shingle, with enough left
behind it). The order is that of the hashes, with shingles common in a sample of the texts last, so that
common passages bring few texts together.

Only distinct sets take part, told apart by 128 bits. Under each shingle, sets with the largest share of shared shingles first
(an original before its edited copies), every set sees the first one there and the one before it, and is compared with the
``STARS`` sets that it sees so most often; what these comparisons connect need not be compared again. Then all sets
under a shingle that are still apart are paired, a shingle with more than ``SLICE`` of them dealt to slices. A pair is
dropped unseen if parities of hash counts, a bit or two to a shingle, differ in more places than two similar sets of
these sizes can have different shingles; only what is left, pairs similar or nearly so, fetches the sets and compares
them. Sets of different sizes have parities of different lengths; the longer ones are folded.

Defined results: a null or wordless text has the empty set, and empty sets are equal; a text of fewer than five
words is one shingle of its own length. Shingles stand for words by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, discard, join_small, task_count
from musterline.llm.tables import row_key
from musterline.operators.grouping import connected_components

SHINGLE_WORDS = 5
PARTS, OF = 4, 5  # similarity 0.8
SEED = 43
SAMPLE_ROWS = 2_000
SAMPLE_SHARE = 100  # or one text in so many, if that is more
SAMPLE_COMMON = 3
MOST_COMMON = 200_000
SLICE = 2_000
LEAST_BITS = 1_024
FEW_NODES = 100_000
STARS = 3
PAIRS_AT_ONCE = 1 << 17
BYTES_AT_ONCE = 8 << 20
KEY = ["_k1", "_k2"]


def shingles_of(text: bytes) -> np.ndarray:
    """The hashes of the distinct shingles of a text, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    reach = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip([0, *ends], ends[reach - 1 :])
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in spans), dtype=np.uint64))


def names_of(shingles: np.ndarray) -> tuple[int, int]:
    """The 128 bits that stand for a set, as two signed numbers."""
    whole = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def prefix_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles, in the fixed order, among which a similar set must have one too."""
    reach = len(shingles) - -(-PARTS * len(shingles) // OF) + 1
    if not len(common):
        return shingles[:reach]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    late = common[at] == shingles
    return np.concatenate([shingles[~late], shingles[late]])[:reach]


def parities_of(shingles: np.ndarray) -> bytes:
    """A power of two of bits, one to two for every shingle."""
    bits = max(LEAST_BITS, 1 << len(shingles).bit_length())
    counts = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1 == 1).tobytes()


def differing(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """In how many places the parities of pairs differ, the longer ones folded to the length of the shorter."""
    out = np.zeros(len(first), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(first, second)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0):
        rows, least = np.flatnonzero((sizes == (m, n)).all(axis=1)), min(m, n)
        x, y = (
            np.bitwise_xor.reduce(np.frombuffer(b"".join(side[r] for r in rows), np.uint64).reshape(len(rows), -1, least // 8), axis=1)
            for side in (first, second)
        )
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return OF * shared >= PARTS * (len(both) - shared)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(*row_key("doc_id", "text"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles of several texts of a sample, sorted; any such choice gives the same result."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles_of(text).view(np.int64))], names=["shingle"])

    every = max(1, min(texts.count() // SAMPLE_ROWS, SAMPLE_SHARE))
    sample = texts.filter(F.pmod("_k1", F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(shingles, "shingle bigint").groupBy("shingle").count()
    most = counts.filter(F.col("count") >= SAMPLE_COMMON).orderBy(F.desc("count")).limit(MOST_COMMON)
    return np.sort(most.select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def _prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(_k1, _k2, doc_id, name, name2, size, bits, prefix) of every row."""
    held = texts.sparkSession.sparkContext.broadcast(common)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t) for t in batch.column("text").to_pylist()]
            names = [names_of(s) for s in sets]
            columns = [batch.column(c) for c in (*KEY, "doc_id")]
            columns += [pa.array([n[i] for n in names], pa.int64()) for i in (0, 1)]
            columns += [pa.array([len(s) for s in sets], pa.int32()), pa.array([parities_of(s) for s in sets], pa.binary())]
            columns.append(pa.array([prefix_of(s, held.value).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "doc_id", "name", "name2", "size", "bits", "prefix"])

    own = texts.schema["doc_id"].dataType.simpleString()
    fields = f"_k1 bigint, _k2 bigint, doc_id {own}, name bigint, name2 bigint, size int, bits binary, prefix array<bigint>"
    return texts.select(*KEY, "doc_id", "text").mapInArrow(measure, fields)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles_of(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose shingle has another row, each with the first row of the shingle (0) and the one before it (1).
    Rows come sorted by shingle."""
    names = ["shingle", "node", "size", "at"]
    held, first, follows = None, None, False  # the last row, the first of its shingle, whether one stands before it

    def rows_of(keep, *columns):
        kept = [pa.array(c[keep]) for c in columns]
        return pa.RecordBatch.from_arrays(kept, names=[*names, *(f"{c}_{n}" for n in (0, 1) for c in names[1:])])

    before = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        else:
            first = before = [x[:1] for x in now]
        opens = np.concatenate([[not follows], now[0][1:] != now[0][:-1]])
        start = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
        began = [np.where(start < 0, x, y[start]) for x, y in zip(first, now)]
        previous = [np.where(opens, y, np.concatenate([x, y[:-1]])) for x, y in zip(before, now)]
        repeated = ~opens | np.concatenate([~opens[1:], [False]])
        repeated[-1] = False  # decided with the next row
        yield rows_of(repeated, *now, *began[1:], *previous[1:])
        held, first, before = ([x[-1:] for x in c] for c in (now, began, previous))
        follows = not opens[-1]
    if follows:
        yield rows_of(np.array([True]), *held, *first[1:], *before[1:])


class Side:
    """Some sets under one shingle."""

    def __init__(self, table: pa.Table):
        self.node, self.size, self.at, self.component = (
            table.column(c).to_numpy().astype(np.int64) for c in ("node", "size", "at", "component")
        )
        bits = table.column("bits").to_pylist()
        self.length, self.row, self.parities = np.array([len(b) for b in bits], np.int64), np.zeros(len(bits), np.int64), {}
        for length in np.unique(self.length).tolist():
            rows = np.flatnonzero(self.length == length)
            self.row[rows] = np.arange(len(rows))
            self.parities[length, length] = np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), -1)

    def folded(self, length: int, least: int) -> np.ndarray:
        """The parities of ``length`` bytes, folded to ``least``."""
        if (length, least) not in self.parities:
            whole = self.parities[length, length]
            self.parities[length, least] = np.bitwise_xor.reduce(whole.reshape(len(whole), -1, least // 8), axis=1)
        return self.parities[length, least]

    def apart(self, i: np.ndarray, other: Side, j: np.ndarray) -> np.ndarray:
        """In how many places the parities of pairs differ; ``BYTES_AT_ONCE`` of them are held at a time."""
        out = np.zeros(len(i), np.int64)
        lengths, other_lengths = self.length[i], other.length[j]
        for m in np.unique(lengths).tolist():
            for n in np.unique(other_lengths[lengths == m]).tolist():
                least, pairs = min(m, n), np.flatnonzero((lengths == m) & (other_lengths == n))
                x, y, at_once = self.folded(m, least), other.folded(n, least), max(1, BYTES_AT_ONCE // least)
                for start in range(0, len(pairs), at_once):
                    p = pairs[start : start + at_once]
                    out[p] = np.bitwise_count(x[self.row[i[p]]] ^ y[other.row[j[p]]]).sum(axis=1, dtype=np.int64)
        return out

    def possible(self, other: Side) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of sets in different components that can be similar, by sizes, positions and parities; of a side
        with itself each pair once. About ``PAIRS_AT_ONCE`` pairs are held at a time."""
        found = [(self.node[:0], other.node[:0])]
        at_once = max(1, PAIRS_AT_ONCE // max(len(other.node), 1))
        for start in range(0, len(self.node), at_once):
            rows = slice(start, start + at_once)
            size, other_size = self.size[rows, None], other.size[None, :]
            behind = np.minimum((self.size - self.at)[rows, None], (other.size - other.at)[None, :])
            fits = np.minimum(size, other_size) * OF >= np.maximum(size, other_size) * PARTS
            fits &= behind * (PARTS + OF) >= (size + other_size) * PARTS
            fits &= self.component[rows, None] != other.component[None, :]
            if other is self:
                fits &= np.arange(len(self.node))[rows, None] < np.arange(len(self.node))[None, :]
            i, j = np.nonzero(fits)
            i += start
            keep = self.apart(i, other, j) * (PARTS + OF) <= (self.size[i] + other.size[j]) * (OF - PARTS)
            found.append((self.node[i[keep]], other.node[j[keep]]))
        return tuple(np.concatenate(nodes) for nodes in zip(*found))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The possible pairs under each (shingle, slice). Rows come sorted; those of role 0, a slice at most, are held
    and compared with each other and with the rows of role 1, the other slices, as these come."""
    where, held, left = None, [], None

    def pairs(*sides):
        a, b = sides[0].possible(sides[1])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def whole():
        return Side(pa.Table.from_batches(held))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shingle", "slice", "role")], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for first, last in zip(cuts, [*cuts[1:], len(keys)]):
            part, place = batch.slice(first, last - first), tuple(keys[first, :2])
            if place != where:
                if held and left is None:
                    left = whole()
                    yield pairs(left, left)
                where, held, left = place, [], None
            if keys[first, 2] == 0:
                held.append(part)
            elif held:
                if left is None:
                    left = whole()
                    yield pairs(left, left)
                yield pairs(left, Side(pa.Table.from_batches([part])))
    if held and left is None:
        left = whole()
        yield pairs(left, left)


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, most_pairs: int | None = None) -> DataFrame:
    """The pairs (a, b) that are similar, as a written table."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = differing(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b")))
            sizes = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size_a", "size_b"))
            yield batch.select(["a", "b"]).filter(pa.array(apart * (PARTS + OF) <= sizes * (OF - PARTS)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("_a", "_b"))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(n) for c, n in (("node", side), ("size", f"size_{side}"), ("bits", f"bits_{side}"))]), side)
    pairs = cut_lineage(pairs.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(possible, "a bigint, b bigint"), most_pairs)
    many = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = cut_lineage(nodes.select("node", "k.*").join(wanted, "node", "left_semi"), 2 * many)
    sets = join_small(texts, keys, KEY, "inner", FEW_NODES).select("node", "text").mapInArrow(_sets, "node bigint, shingles binary")
    sets = cut_lineage(sets)
    # Rows repeated whole give their set, and so their pairs, more than once: hence the distinct.
    met = pairs
    for side in ("a", "b"):
        met = met.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"_{side}")), side)
    found = cut_lineage(met.select("a", "b", "_a", "_b").mapInArrow(check, "a bigint, b bigint").distinct(), many)
    for table in (pairs, keys, sets):
        discard(table)
    return found


def _likely(met: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of two sets that can be similar if this is the first shingle they share."""
    behind = F.least(F.col(f"size{a}") - F.col(f"at{a}"), F.col(f"size{b}") - F.col(f"at{b}"))
    enough = behind * (PARTS + OF) >= (F.col(f"size{a}") + F.col(f"size{b}")) * PARTS
    small, large = F.least(f"size{a}", f"size{b}"), F.greatest(f"size{a}", f"size{b}")
    return met.filter((small * OF >= large * PARTS) & enough & (F.col(f"node{a}") != F.col(f"node{b}")))


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    """The distinct pairs of ``met``, the smaller node first."""
    ends = F.col(f"node{a}"), F.col(f"node{b}")
    return met.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()


def _stars(shown: DataFrame) -> DataFrame:
    """(a, b): every set with those that it sees first or just before it under most shingles."""
    seen = [_likely(shown, "", f"_{n}").select("node", F.col(f"node_{n}").alias("node_b")) for n in (0, 1)]
    counts = seen[0].union(seen[1]).groupBy("node", "node_b").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "node_b"))
    most = counts.withColumn("place", place).filter(F.col("place") <= STARS)
    return _pairs(most.withColumnRenamed("node", "node_a"), "_a", "_b")


def links(texts: DataFrame, nodes: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(a, b): similar sets, enough of them to connect all that are. ``nodes`` has (node, size, bits, prefix, k)."""
    count = task_count(texts.sparkSession)
    postings = nodes.select("node", "size", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "node", "size", "at")
    postings = postings.repartition(count, "shingle").sortWithinPartitions("shingle", "size", "node")
    fields = "shingle bigint, node bigint, size int, at int, node_0 bigint, size_0 int, at_0 int, node_1 bigint, size_1 int, at_1 int"
    open_ = cut_lineage(postings.mapInArrow(_shared, fields).select("shingle", "node", "size", "at"))
    weights = open_.groupBy("node").agg((F.count(F.lit(1)) / F.first("size")).alias("weight"))
    ranked = open_.join(weights, "node").repartition(count, "shingle")
    ranked = ranked.sortWithinPartitions("shingle", F.desc("weight"), "size", "node").drop("weight")
    many = nodes.count()
    first = _verified(_stars(ranked.mapInArrow(_shared, fields)), texts, nodes, STARS * many)

    tied = cut_lineage(connected_components(first, STARS * many), many)
    apart = join_small(open_, tied, ["node"], "left", FEW_NODES)
    apart = apart.withColumn("component", F.coalesce("component", "node"))
    hot = apart.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), (F.min("component") == F.max("component")).alias("whole")
    )
    hot = hot.filter(F.col("n") > slice_rows).select("shingle", "whole", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    hot = cut_lineage(hot, open_.count() // slice_rows)
    apart = join_small(apart, hot, ["shingle"], "left").filter("whole is null or not whole")
    apart = apart.withColumn("slices", F.coalesce("slices", F.lit(1))).join(nodes.select("node", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    # A set goes to its own slice to be held, and to the slices before it to be compared with those held there.
    places = F.transform(F.sequence(F.lit(0), own), lambda i: F.struct(i.alias("slice"), (i < own).cast("int").alias("role")))
    columns = ("node", "size", "at", "component", "bits")
    dealt = apart.select("shingle", F.explode(places).alias("_p"), *columns).select("shingle", "_p.*", *columns)
    dealt = dealt.repartition(count, "shingle", "slice").sortWithinPartitions("shingle", "slice", "role")
    second = _verified(dealt.mapInArrow(_met, "a bigint, b bigint").filter("a <> b").distinct(), texts, nodes)
    for table in (open_, tied, hot):
        discard(table)
    return first.union(second)


def tied(documents: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(_k1, _k2, doc_id, n, component) of every distinct row: what chains of similar texts connect is one component;
    ``n`` counts the rows of the key."""
    texts = _texts(documents)
    rows = cut_lineage(_prefixes(texts, _common(texts)))
    named = ["name", "name2"]
    once = rows.groupBy(*named).agg(*[F.first(c).alias(c) for c in ("size", "bits", "prefix")], F.min(F.struct(*KEY)).alias("k"))
    nodes = cut_lineage(once.withColumn("node", F.monotonically_increasing_id()))
    members = rows.select(*KEY, "doc_id", *named).join(nodes.select(*named, "node"), named)
    members = cut_lineage(members.groupBy(*KEY, "doc_id", "node").agg(F.count(F.lit(1)).alias("n")), texts.count())
    discard(rows)
    found = connected_components(links(texts, nodes, slice_rows))
    named = members.join(found, "node", "left")
    return named.select(*KEY, "doc_id", "n", F.coalesce("component", "node").alias("component"))

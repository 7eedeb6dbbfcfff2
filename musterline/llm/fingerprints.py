"""Document fingerprints from prefix polynomial hashes.

The hash of a text is the sum of (code point + 1) times a power of a base, modulo a prime. With the
sums of all prefixes at hand, any two spans are compared in constant time, and the longest common
extension of two positions is found by binary search. Two primes near 2**31 are used side by side
for spans, four (prime, base) pairs for whole texts.

A fingerprint is a string of three parts: length, whole-text hash, and a sketch. The sketch keeps,
for each of 64 bins, the smallest hash among the text's spans of ``SPAN`` code points in that bin.
The likeness of two fingerprints is the estimated share of common spans (Dice): near 0.5 for two
texts of one length that agree in half of it.

Defined results: a null text counts as empty. The fingerprint of the empty text has length 0 and an
empty sketch; two equal fingerprints have likeness 1, and an empty one has likeness 0 to any other.
A text shorter than a span is one span. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterline.cluster import task_count

# Fixed values: (prime, base) of the hash lanes; the first two also serve spans.
LANES = ((2147483647, 911382323), (2147483629, 972663749), (2147483647, 318453173), (2147483629, 761382911))
SPAN = 12
BINS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime; kept and doubled as longer texts come."""
    known = _powers.get((prime, base))
    if known is None:
        known = np.ones(1, dtype=np.uint64)
    while len(known) < n:
        step = pow(base, len(known), prime)
        known = np.concatenate([known, known * np.uint64(step) % np.uint64(prime)])
    _powers[prime, base] = known
    return known[:n]


class Prefixes:
    """The prefix arrays of one text; spans are (start, length) in code points."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = len(self.codes)
        values = self.codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        totals = []
        for lane, (prime, base) in enumerate(LANES):
            terms = values * powers(prime, base, self.n) % np.uint64(prime)
            if lane < 2:
                sums = np.zeros(self.n + 1, dtype=np.uint64)
                np.cumsum(terms, out=sums[1:])
                sums %= np.uint64(prime)
                self.sums.append(sums)
                totals.append(int(sums[-1]))
            else:
                totals.append(int(terms.sum()) % prime)
        self.whole = "".join(f"{t:08x}" for t in totals)

    def span(self, lane: int, start: int, length: int) -> int:
        prime = LANES[lane][0]
        return (int(self.sums[lane][start + length]) - int(self.sums[lane][start])) % prime

    def same(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        """Whether two spans are equal, by hash."""
        for lane, (prime, base) in enumerate(LANES[:2]):
            mine = self.span(lane, start, length) * pow(base, other_start, prime) % prime
            theirs = other.span(lane, other_start, length) * pow(base, start, prime) % prime
            if mine != theirs:
                return False
        return True

    def common_extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """How many code points agree to the right of two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start + low, other, other_start + low, middle - low):
                low = middle
            else:
                high = middle - 1
        return low

    def common_extension_left(self, end: int, other: Prefixes, other_end: int) -> int:
        """How many code points agree to the left of two positions."""
        low, high = 0, min(end, other_end)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(end - middle, other, other_end - middle, middle - low):
                low = middle
            else:
                high = middle - 1
        return low

    def span_hashes(self, length: int) -> np.ndarray:
        """Position-free hashes of all spans of a length; of the whole text where it is shorter."""
        length = min(length, self.n)
        if length == 0:
            return np.zeros(0, dtype=np.uint64)
        count = self.n - length + 1
        both = np.zeros(count, dtype=np.uint64)
        for lane, (prime, base) in enumerate(LANES[:2]):
            p = np.uint64(prime)
            spans = (self.sums[lane][length:] + p - self.sums[lane][:count]) % p
            inverse = powers(prime, pow(base, -1, prime), count)
            both = (both << np.uint64(31)) | (spans * inverse % p)
        return both


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest mixed hash of each bin in 16 bits, 0 where a bin has none."""
    mixed = hashes * MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    bins = (mixed >> np.uint64(58)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bins, mixed & np.uint64((1 << 58) - 1))
    filled = least != np.iinfo(np.uint64).max
    short = (least * MIX) >> np.uint64(48)
    return np.where(filled, np.maximum(short, np.uint64(1)), np.uint64(0)).astype(np.uint16)


def fingerprint_of(prefixes: Prefixes) -> str:
    bins = sketch(prefixes.span_hashes(SPAN))
    return f"{prefixes.n:x}-{prefixes.whole}-{bins.astype('>u2').tobytes().hex()}"


def likeness(first: str, second: str) -> float:
    """The estimated share of spans that two fingerprinted texts have in common, 0 to 1."""
    if first == second:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), dtype=">u2") for f in (first, second))
    either = int(((a != 0) | (b != 0)).sum())
    both = int(((a == b) & (a != 0)).sum())
    shared = both / either if either else 0.0
    return 2 * shared / (1 + shared)


def in_descending_order(documents: DataFrame) -> DataFrame:
    """(_bucket, _copy, doc_id, text) in sorted tasks, every row followed by its next one.

    The next row is that of the next smaller doc_id (null last; equal ids by text hash, then text);
    the last row is followed by the first. Rows are dealt by ranges of doc_id; the first row of each range
    is also given to the range before. What the driver holds is two numbers per range.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = task_count(spark)
    ids = rows.select("doc_id").filter(F.col("doc_id").isNotNull())
    dealt = ids.repartitionByRange(ranges, F.desc("doc_id")).groupBy(F.spark_partition_id().alias("p"))
    cuts = sorted((r.least for r in dealt.agg(F.min("doc_id").alias("least")).collect()), reverse=True)
    bucket = F.lit(len(cuts))
    if cuts:
        steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
        bounds = F.array(*[F.lit(int(c)) for c in cuts])

        def further(position, step):
            onwards = (position + step <= len(cuts)) & (F.get(bounds, position + step - 1) > F.col("doc_id"))
            return F.when(onwards, position + step).otherwise(position)

        found = F.reduce(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
        bucket = F.when(F.col("doc_id").isNull(), bucket).otherwise(found)
    tie = F.xxhash64("text")
    first = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("tie")))
    placed = rows.select(bucket.alias("_bucket"), "doc_id", tie.alias("tie"))
    tops = sorted((r._bucket, r.top) for r in placed.groupBy("_bucket").agg(first.alias("top")).collect())
    before = [
        (b, int(top[1]), tops[i - 1][0]) for i, (b, top) in enumerate(tops)
    ]
    ids_of = {b: (int(top[0]) if b < len(cuts) else None) for b, top in tops}
    handed = spark.createDataFrame(
        [(ids_of[b], t, target) for b, t, target in before], "_top bigint, _tie bigint, _target int"
    )
    marked = rows.join(
        F.broadcast(handed), F.col("doc_id").eqNullSafe(F.col("_top")) & (tie == F.col("_tie")), "left"
    )
    own = F.struct(bucket.alias("_bucket"), F.lit(False).alias("_copy"))
    also = F.when(F.col("_target").isNotNull(), F.struct(F.col("_target").alias("_bucket"), F.lit(True).alias("_copy")))
    places = marked.select(F.explode(F.array_compact(F.array(own, also))).alias("_at"), "doc_id", "text")
    dealt_rows = places.select("_at.*", "doc_id", "text").repartitionById(len(cuts) + 1, F.col("_bucket"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc()]
    return dealt_rows.sortWithinPartitions("_bucket", "_copy", *order)


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, prefix_with_next bigint, suffix_with_next bigint"
)


def fingerprints_with_edits(documents: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and likenesses.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the
    next document. ``prefix_with_next`` and ``suffix_with_next`` are the exact lengths of the longest
    common extensions with the next document from both ends.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_bucket", "_copy", "doc_id", "text")]
            done = []
            for bucket, copy, doc_id, text in zip(*columns):
                at_hand = None
                if held is not None and held[0] == bucket and not held[1]:
                    prefixes = Prefixes(text)
                    at_hand = (prefixes, fingerprint_of(prefixes))
                    done.append(compared(held, text, *at_hand))
                if not copy and at_hand is None:
                    prefixes = Prefixes(text)
                    at_hand = (prefixes, fingerprint_of(prefixes))
                held = (bucket, copy, doc_id, text, *(at_hand or (None, None)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], f.type) for i, f in enumerate(ARROW)], schema=ARROW
            )

    return in_descending_order(documents).mapInArrow(measure, SCHEMA)


ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("prefix_with_next", pa.int64()), ("suffix_with_next", pa.int64())]
)


def compared(held: tuple, next_text: str, next_prefixes: Prefixes, next_fingerprint: str) -> tuple:
    _, _, doc_id, text, prefixes, own = held
    half = prefixes.n // 2
    edited = text[: prefixes.n - half] + next_text[:half]
    changed = fingerprint_of(Prefixes(edited)) if edited != text else own
    return (
        doc_id,
        prefixes.n,
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        own,
        changed,
        likeness(own, changed),
        likeness(own, next_fingerprint),
        prefixes.common_extension(0, next_prefixes, 0),
        prefixes.common_extension_left(prefixes.n, next_prefixes, next_prefixes.n),
    )

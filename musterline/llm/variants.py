"""Spelling variant grouping by PartEnum signatures.

A word is the set of its letters, each with a number if it stands several times: a binary vector. One edit
changes at most two of its places. The places are dealt to ``PARTS`` parts; of two vectors that differ in at most
two places, at least ``PARTS`` - 2 parts are equal. So a word gets one signature for every choice of two parts to
leave out, the hash of the others, and near words have one in common.

One edit also leaves either half of a word as it is: for two words the shorter of which has g letters, the first
g // 2 or the last g - g // 2. So a signature is filed with the length g and a half, once with the word as the
shorter or an equal one, once as the longer one. Words are joined on that key, and only pairs of distance one leave
the join. A key holds words, not occurrences, so frequent words weigh nothing.

Each word points to the near word that is most frequent, if that is frequent enough; pointers are followed by
doubling.

Defined results: a null text has no words, a null doc_id counts as an empty one when runs are altered. Only A-Z are
lower-cased. Repeated documents count each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, discard

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
PARTS = 4
LEFT_OUT = 2  # places in which the letters of near words can differ
WORDS_AT_ONCE = 5_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values + MIX) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def runs(documents: DataFrame, altered: int | None = None) -> DataFrame:
    """(word) for every maximal run of letters that can be a word.

    With ``altered``, one run of so many (by the crc32 of doc_id and run) loses one of its letters.
    """
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    rows = documents.select("doc_id", F.explode(found).alias("run"))
    rows = rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if altered is None:
        return rows.select("word")
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    rows = rows.select("word", F.crc32(named.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    word = F.when(F.col("h") % altered == 0, less).otherwise(F.col("word"))
    return rows.select(word.alias("word"))


def vocabulary(documents: DataFrame, altered: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LETTERS`` letters that stand at least ``LEAST_COUNT`` times."""
    words = runs(documents, altered).filter(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def part_sums(words: list[str], parts: int = PARTS) -> np.ndarray:
    """For every word and part, the sum of the hashes of the word's vector in that part."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    whose = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((codes, whose))
    codes = codes[order]
    opens = np.concatenate([[True], (codes[1:] != codes[:-1]) | (whose[1:] != whose[:-1])])
    starts = np.maximum.accumulate(np.where(opens, np.arange(len(codes)), 0))
    place = mixed((codes << np.uint64(20)) + (np.arange(len(codes)) - starts).astype(np.uint64))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (whose, (place % np.uint64(parts)).astype(np.int64)), mixed(place))
    return sums


def half_hashes(words: list[str], longer: bool) -> np.ndarray:
    """The hashes of the first and the last half, with the length of the shorter word and which half it is."""
    out = np.zeros((len(words), 2), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, word in enumerate(words):
        g = len(word) - longer
        out[i] = digest(word[: g // 2].encode(), 2 * g), digest(word[len(word) - (g - g // 2) :].encode(), 2 * g + 1)
    return out


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, longer): a row per choice of parts, half and role of the word."""
    pairs = list(combinations(range(PARTS), LEFT_OUT))
    for batch in batches:
        words = batch.column("word").to_pylist()
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            sums = part_sums(some)
            whole = sums.sum(axis=1, dtype=np.uint64)
            kept = np.stack([mixed(whole - sums[:, a] - sums[:, b] + np.uint64(k)) for k, (a, b) in enumerate(pairs)])
            keys, roles = [], []
            for longer in (False, True):
                halves = half_hashes(some, longer)
                for half in (0, 1):
                    keys.append(mixed(kept ^ halves[:, half]))
                    roles.append(np.full(kept.shape, longer))
            take = np.tile(np.arange(len(some)), len(pairs) * 4)
            columns = [np.concatenate([k.ravel() for k in keys]).view(np.int64), np.concatenate([r.ravel() for r in roles])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(some, pa.string()).take(pa.array(take)), pa.array(columns[1])],
                names=["key", "word", "longer"],
            )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a before b: the distinct ``word`` values that differ by one letter put in, taken out or replaced."""
    filed = words.select("word").mapInArrow(signatures, "key bigint, word string, longer boolean")
    left = filed.select("key", F.col("word").alias("a"), F.col("longer").alias("_la"))
    right = filed.select("key", F.col("word").alias("b"), F.col("longer").alias("_lb"))
    met = (F.col("a") < F.col("b")) & ~(F.col("_la") & F.col("_lb")) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & met).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): every word that has a form, and where its forms end."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on"))
        before, now = now, cut_lineage(stepped)
        moved = not now.filter("_on").isEmpty()
        discard(before)
        if not moved:
            return now.drop("_on")


def grouped(documents: DataFrame, altered: int | None = None, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    ``form`` is the near word that stands most often (of equal ones the first in code-point order), if it stands at
    least ``times`` as often as the word; ``root`` is where the forms of forms end, or the word itself.
    """
    words = cut_lineage(vocabulary(documents, altered))
    pairs = near_pairs(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    near = pairs.select(ends.alias("_e")).select("_e.*").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("_best")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("_best.n") >= F.col("n") * times
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("_best.near")).alias("form"),
        F.when(enough, -F.col("_best.n")).alias("form_n"),
    )
    found = cut_lineage(found)
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))

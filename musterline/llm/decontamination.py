"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are sequences of words. Each window of ten words holds five six-word grams; the smallest of their
hashes is the window's fingerprint. Two equal windows have equal fingerprints, so joining the fingerprints
of documents and items misses no shared span of ten words. A match gives a diagonal: a document, an item
and the shift between their word positions. Along each diagonal the words themselves are compared, which
extends the match as far as it goes and leaves no false hit. An item with fewer than ten words is one window
of its own length.

Defined results: a null text has no words, an item without words or without an id matches nothing, and a
document without words is clean. Repeated rows get a row each; items with the same id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterline.cluster import cut_lineage, small_table
from musterline.llm.tables import row_key

WINDOW = 10
GRAM = 6
BROADCAST_ROWS = 100_000  # of at most some 40 bytes each
ITEM = ["_i1", "_i2"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased and all other letters as they are."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    small = F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.coalesce(F.array_remove(F.split(small, BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def _grams(hashes: str, size: int) -> Column:
    """The hash of every gram of ``size`` words, from the hashes of the words."""
    count = F.greatest(F.size(hashes) - size + 1, F.lit(0))

    def gram(first, i):
        return F.xxhash64(F.lit(size), first, *[F.get(F.col(hashes), i + j) for j in range(1, size)])

    return F.transform(F.slice(hashes, F.lit(1), count), gram)


def _minima(grams: str, reach: int) -> Column:
    """The smallest hash of every ``reach`` grams in a row."""
    count = F.greatest(F.size(grams) - reach + 1, F.lit(0))

    def least(first, i):
        return F.least(first, *[F.get(F.col(grams), i + j) for j in range(1, reach)])

    return F.transform(F.slice(grams, F.lit(1), count), least)


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(_i1, _i2, item_id, words) of the distinct items that can match."""
    items = benchmark.filter(F.col("item_id").isNotNull())
    items = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return items.select(*[k.alias(i) for k, i in zip(row_key("item_id", "words"), ITEM)], "item_id", "words")


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(_i1, _i2, size, hash, at): the grams an item is found by, with their word positions.

    ``size`` is the item's window length: ten, or all its words where there are fewer. Rows have a fixed
    width, whatever the item's length, so that a bound on their number bounds their bytes.
    """
    items = _hashed(items).withColumn("_g", _grams("_h", GRAM))
    reach = WINDOW - GRAM + 1
    items = items.withColumn("_m", _minima("_g", reach))
    chosen = F.filter(
        F.transform("_g", lambda g, i: F.struct(g.alias("hash"), i.alias("at"))),
        lambda s: F.array_contains(F.col("_m"), s["hash"]),
    )
    whole = F.lit(None).cast("bigint")
    for size in range(1, WINDOW):
        parts = [F.get(F.col("_h"), F.lit(j)) for j in range(size)]
        whole = F.when(F.size("words") == size, F.xxhash64(F.lit(size), *parts)).otherwise(whole)
    alone = F.array(F.struct(whole.alias("hash"), F.lit(0).alias("at")))
    found_by = F.explode(F.when(F.size("words") < WINDOW, alone).otherwise(chosen)).alias("_f")
    size = F.least(F.size("words"), F.lit(WINDOW)).alias("size")
    return items.select(*ITEM, size, found_by).select(*ITEM, "size", "_f.*")


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A broadcast join while ``right`` has a checked, small number of rows, a shuffle join beyond."""
    copy = small_table(right, BROADCAST_ROWS)
    return left.join(right if copy is None else F.broadcast(copy), on, how)


def hits(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (_k1, _k2, doc_id, n_words), and per key the hit words and items where there are any."""
    items = cut_lineage(benchmark_items(benchmark))
    prints = cut_lineage(item_fingerprints(items))
    short = [r.size for r in prints.select("size").distinct().collect() if r.size < WINDOW]  # nine at most
    rows = documents.select(*row_key("doc_id", "text"), "doc_id", words_of(F.col("text")).alias("words"))
    rows = _hashed(rows).withColumn("_g", _grams("_h", GRAM))
    looked_up = [_minima("_g", WINDOW - GRAM + 1)] + [_grams("_h", size) for size in sorted(short)]
    prepared = rows.select(
        "_k1", "_k2", "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.array_distinct(F.concat(*looked_up)).alias("_found_by"),
    )
    prepared = cut_lineage(prepared)
    seen = prepared.select("_k1", "_k2", F.explode("_found_by").alias("hash"))
    candidates = _join(seen, prints.select("hash").distinct(), ["hash"], "left_semi").select("_k1", "_k2").distinct()

    texts = documents.select(*row_key("doc_id", "text"), "text").join(candidates, ["_k1", "_k2"], "left_semi")
    texts = texts.dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", words_of(F.col("text")).alias("words"))
    texts = cut_lineage(texts)
    hashed = _hashed(texts)
    grams = [
        _at(hashed.withColumn("_g", _grams("_h", size)), size) for size in sorted({*short, GRAM})
    ]
    places = grams[0]
    for more in grams[1:]:
        places = places.unionByName(more)
    found = _join(places, prints.select("hash", *ITEM, "size", "at"), ["hash"], "inner")
    shift = (F.col("_at") - F.col("at")).alias("shift")
    diagonals = cut_lineage(found.select("_k1", "_k2", *ITEM, "size", shift).distinct())
    along = diagonals.join(items.withColumnRenamed("words", "item_words"), ITEM).join(texts, ["_k1", "_k2"])
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(
        F.size("item_words") - F.col("size"), F.size("words") - F.col("size") - F.col("shift")
    )

    def same(i):
        size = F.col("size")
        return F.slice("words", i + F.col("shift") + 1, size) == F.slice("item_words", i + 1, size)

    starts = F.when(last >= first, F.filter(F.sequence(first, last), same)).otherwise(F.array().cast("array<int>"))
    matched = along.select("_k1", "_k2", "item_id", "size", "shift", starts.alias("starts")).filter(F.size("starts") > 0)
    covered = F.flatten(
        F.transform("starts", lambda s: F.sequence(s + F.col("shift"), s + F.col("shift") + F.col("size") - 1))
    )
    spans = matched.select("_k1", "_k2", "item_id", F.array_distinct(covered).alias("covered"))
    by_key = spans.groupBy("_k1", "_k2").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("hit_words"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return prepared.select("_k1", "_k2", "doc_id", "n_words"), by_key


def _at(rows: DataFrame, size: int) -> DataFrame:
    # Outer, as otherwise a filter on the size of the array moves down and rebuilds the array per element.
    return rows.select("_k1", "_k2", F.posexplode_outer("_g").alias("_at", "hash"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, hit_words (positions), items (ids as sorted strings)."""
    rows, found = hits(documents, benchmark)
    joined = rows.join(found, ["_k1", "_k2"], "left")
    nothing = F.array().cast("array<int>"), F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("hit_words", nothing[0]).alias("hit_words"),
        F.coalesce("items", nothing[1]).alias("items"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, with their columns as they were."""
    _, found = hits(documents, benchmark)
    columns = documents.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    keyed = documents.select(*row_key("doc_id", "text"), row)
    kept = keyed.join(found.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti")
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])

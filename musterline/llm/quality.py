"""Quality classifier: a generalised additive model with pairwise interactions.

Every measure of a text is cut into quantile bins. Boosting goes round the measures in turn: each
step fits a tree of at most ``LEAVES`` leaves to the current gradients of one measure's bins and adds a
small share of it to that measure's table. Then the pairs of measures that explain most of what is left
get tables of their own, fed by four-leaf trees with one cut on either axis. A score is the sum of
one table entry per measure and per pair, put through the logistic function.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hash of doc_id;
all else reads every row. Labels, language, source and id are never measures.

Defined results: a null text counts as empty and gets a score like any other. Documents with
contradicting labels, or a label that is not 0 or 1, are not learned from. Without labels of both kinds
every score is the share of label 1 (0.5 without any). Repeated labels count once; repeated documents
are scored each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 20_000
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 8
BINS = 32
PAIR_BINS = 8
LEAVES = 4
RATE = 0.1
SMOOTHING = 1.0
LEAST_ROWS = 5.0

MEASURES = [
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "blanks", "breaks",
    "beyond_ascii", "distinct_words", "commonest_word", "distinct_lines", "deflated", "entropy",
    "words_with_symbol", "longest_run", "short_words", "line_length",
]

# Classes of the ASCII characters.
LOWER, UPPER, DIGIT, BLANK, BREAK, POINT, SYMBOL, BEYOND = range(8)
_KINDS = np.full(129, SYMBOL, dtype=np.uint8)
_KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LOWER
_KINDS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = UPPER
_KINDS[[ord(c) for c in "0123456789"]] = DIGIT
_KINDS[[ord(c) for c in " \t"]] = BLANK
_KINDS[[ord(c) for c in "\n\r"]] = BREAK
_KINDS[[ord(c) for c in ".,;:?!'\"()-"]] = POINT
_KINDS[128] = BEYOND


def measures_of(text: str) -> np.ndarray:
    """The measures of one whole text; all are 0 for the empty one."""
    n = len(text)
    if n == 0:
        return np.zeros(len(MEASURES))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _KINDS[np.minimum(codes, 128)]
    share = np.bincount(kinds, minlength=8) / n
    words = text.split()
    lines = text.split("\n")
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    many = max(len(words), 1)
    _, counts = np.unique(np.minimum(codes, 1 << 10), return_counts=True)
    odds = counts / n
    changes = np.flatnonzero(np.diff(codes)) + 1
    longest = np.diff(np.concatenate([[0], changes, [n]])).max()
    marked = np.flatnonzero(kinds == SYMBOL)
    after = np.minimum(marked + 1, n - 1)
    ends = np.isin(kinds[after], (BLANK, BREAK)) | (marked == n - 1)
    return np.array([
        np.log1p(n),
        np.log1p(len(words)),
        sum(map(len, words)) / many,
        share[UPPER],
        share[DIGIT],
        share[SYMBOL],
        share[POINT],
        share[BLANK],
        share[BREAK],
        share[BEYOND],
        len(seen) / many,
        max(seen.values(), default=0) / many,
        len(set(lines)) / len(lines),
        len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / n,
        float(-(odds * np.log(odds)).sum()),
        ends.sum() / many,
        np.log1p(longest),
        sum(1 for w in words if len(w) <= 3) / many,
        np.log1p(n / len(lines)),
    ])


def measured(texts: pd.Series) -> np.ndarray:
    return np.array([measures_of(t or "") for t in texts]).reshape(len(texts), len(MEASURES))


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` has (first, second, table) over the coarse bins."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def scores(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        for m, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, values[:, m], side="right")]
        for a, b, table in self.pairs:
            left = np.searchsorted(self.coarse[a], values[:, a], side="right")
            right = np.searchsorted(self.coarse[b], values[:, b], side="right")
            total += table[left, right]
        return 1 / (1 + np.exp(-total))


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins; gain 0 if no cut helps."""
    g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    all_g, all_h = gradient.sum(), weight.sum()
    if len(g) == 0:
        return 0.0, 0
    gain = g**2 / (h + SMOOTHING) + (all_g - g) ** 2 / (all_h - h + SMOOTHING) - all_g**2 / (all_h + SMOOTHING)
    place = int(gain.argmax())
    return float(max(gain[place], 0.0)), place + 1


def shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The values a tree of at most ``LEAVES`` leaves gives to the bins, best cut first."""
    parts = [(0, len(gradient))]
    while len(parts) < LEAVES:
        cuts = [best_cut(gradient[a:b], weight[a:b]) for a, b in parts]
        k = max(range(len(parts)), key=lambda i: cuts[i][0])
        if cuts[k][0] <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + cuts[k][1]), (a + cuts[k][1], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + SMOOTHING)
    return out


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf tree with one cut on either axis: its gain, and its values."""

    def corners(x):
        c = x.cumsum(0).cumsum(1)
        whole, left, top = c[-1, -1], c[:-1, -1:], c[-1:, :-1]
        inner = c[:-1, :-1]
        return inner, left - inner, top - inner, whole - left - top + inner

    if min(gradient.shape) < 2:
        return 0.0, np.zeros_like(gradient)
    gs, hs = corners(gradient), corners(weight)
    total = sum(g**2 / (h + SMOOTHING) for g, h in zip(gs, hs))
    i, j = np.unravel_index(total.argmax(), total.shape)
    values = np.zeros_like(gradient)
    leaf = [g[i, j] / (h[i, j] + SMOOTHING) for g, h in zip(gs, hs)]
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = leaf[0], leaf[1]
    values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf[2], leaf[3]
    return float(total[i, j] - gradient.sum() ** 2 / (weight.sum() + SMOOTHING)), values


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """Boosts the tables on the given rows; the same rows always give the same model."""
    positive = float(labels.mean()) if len(labels) else 0.5
    width = values.shape[1]
    edges = [quantile_edges(values[:, m], BINS) for m in range(width)]
    coarse = [quantile_edges(values[:, m], PAIR_BINS) for m in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if positive in (0.0, 1.0) or len(labels) < 2 * LEAST_ROWS:
        held = np.clip(positive, 1e-6, 1 - 1e-6)
        return Model(float(np.log(held / (1 - held))), edges, coarse, tables, [])
    base = float(np.log(positive / (1 - positive)))
    bins = [np.searchsorted(e, values[:, m], side="right") for m, e in enumerate(edges)]
    broad = [np.searchsorted(e, values[:, m], side="right") for m, e in enumerate(coarse)]
    total = np.full(len(labels), base)

    def slopes():
        odds = 1 / (1 + np.exp(-total))
        return labels - odds, odds * (1 - odds)

    for _ in range(ROUNDS):
        for m in range(width):
            gradient, weight = slopes()
            size = len(tables[m])
            step = RATE * shallow_tree(
                np.bincount(bins[m], gradient, size), np.bincount(bins[m], weight, size)
            )
            tables[m] += step
            total += step[bins[m]]

    def grid(a, b, x):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(broad[a] * shape[1] + broad[b], x, shape[0] * shape[1]).reshape(shape)

    gradient, weight = slopes()
    gains = [
        (quadrants(grid(a, b, gradient), grid(a, b, weight))[0], a, b) for a in range(width) for b in range(a)
    ]
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    added = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            gradient, weight = slopes()
            step = RATE * quadrants(grid(a, b, gradient), grid(a, b, weight))[1]
            added[a, b] += step
            total += step[broad[a], broad[b]]
    return Model(base, edges, coarse, tables, [(a, b, t) for (a, b), t in added.items()])


def held_out():
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits a model on at most ``max_rows`` labelled rows; that bound is what reaches the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
    known = known.filter("low = quality and quality in (0, 1)").select("doc_id", "quality")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    spark = documents.sparkSession
    small = spark.createDataFrame(sample.collect(), "doc_id bigint, quality int")
    size = len(MEASURES)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(measured(texts)))

    read = documents.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    rows = read.select("doc_id", "quality", measure("text").alias("m")).orderBy(F.xxhash64("doc_id"), "doc_id", "m")
    rows = rows.limit(max_rows).collect()
    values = np.array([r.m for r in rows]).reshape(len(rows), size)
    return fit(values, np.array([float(r.quality) for r in rows]))


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with one more column, the score of the whole text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(measured(texts)))

    return documents.withColumn(column, scored(F.coalesce(documents["text"], F.lit(""))))


def judged(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = learn(documents, labels, max_rows)
    rows = score(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that score at least 0.5, with their columns as they were."""
    model = learn(documents, labels, max_rows)
    name = "_score"
    while name in documents.columns:
        name = "_" + name
    return score(documents, model, name).filter(F.col(name) >= 0.5).drop(name)

"""Toxicity: subword bags averaged into a linear softmax, trained jointly.

A word is the mean of the vectors of its character n-grams and of itself, looked up by hash in one table, so an
unseen spelling or inflection shares most of its vectors with known ones. A passage of ``PASSAGE_WORDS`` words is
the mean of its distinct words, filled up with zero vectors to ``LEAST_WORDS`` so that a junk line of one repeated
word stays near nothing, and a linear softmax over the two classes reads it. Table and softmax are trained together
by Adam in numpy, each vector being drawn towards zero by a fixed length a step, so that only n-grams that many texts
support keep one. A text is as toxic as its worst passage, so one bad sentence is not averaged away in a long text:
in training, a text's gradient goes to its passages by how toxic they seem so far.
A line fitted on a fifth of the training texts, which the table does not learn from, turns the worst passage's
margin into a probability at the true share of toxic texts.

For scoring, table and softmax fold into one number per n-gram, which is what the tasks are given.

Learned from at most ``max_rows`` labelled texts of either class, those with the smallest hash of doc_id, and at most
``max_passages`` passages of at most ``PASSAGE_BYTES`` bytes of them; all else reads every row and whole texts.
Labels, language, source and id are never features.

Defined results: a null text counts as empty; a text without words gets the score of a passage without any n-gram.
Documents with contradicting labels, or a label that is not 0 or 1, are not learned from. Without labels of
both kinds every score is the share of label 1 (0.5 without any). Repeated labels count once; repeated documents
are scored each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 3_000
MAX_PASSAGES = 32_000
PASSAGE_WORDS = 64
PASSAGE_BYTES = 4_096
LEAST_WORDS = 16
SHORTEST, LONGEST = 3, 6
BUCKETS = 1 << 17
WIDTH = 4
LEAST_TEXTS = 3  # n-grams of fewer training texts stay at zero
EPOCHS = 12
BATCHES = 12
RATE = 0.5
SHRINK = 0.3  # of the step, taken off every vector used: what only one text supports stays at zero
FLOOR = 0.003  # keeps steps of seldom n-grams small
KEPT_WORDS = 300_000
CALIBRATION = 5  # every fifth text of the sample fits the line only
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def buckets_of(word: str) -> list[int]:
    """The table rows of a word: itself and its n-grams, ends marked."""
    marked = f"<{word}>"
    n = len(marked)
    grams = [marked[a : a + k] for k in range(SHORTEST, LONGEST + 1) for a in range(n - k + 1)]
    return [crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (marked, *grams)]


def passages_of(words: list[str]) -> list[list[str]]:
    """The distinct words of runs of ``PASSAGE_WORDS`` words; a last run of less than half joins the one before."""
    cuts = list(range(0, max(len(words) - PASSAGE_WORDS // 2, 1), PASSAGE_WORDS))
    return [list(dict.fromkeys(words[a:b])) for a, b in zip(cuts, [*cuts[1:], len(words)])] if words else []


@dataclass
class Model:
    """A number per table row (None: every score is ``share``), the bias, and the line of the calibration."""

    numbers: np.ndarray | None
    bias: float
    slope: float
    offset: float
    share: float
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = float(self.numbers[buckets_of(word)].mean())
        return found

    def margin(self, text: str) -> float:
        """The softmax margin of the worst passage."""
        passages = passages_of(words_of(text))
        means = (sum(map(self.weight, p)) / max(len(p), LEAST_WORDS) for p in passages)
        return self.bias + max(means, default=0.0)

    def scores(self, texts) -> np.ndarray:
        if self.numbers is None:
            return np.full(len(texts), self.share)
        margins = np.array([self.margin(t) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def _means(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) / sizes[:, None].astype(np.float32)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Batch:
    """Passages of some texts as index arrays: passage to words, word to table rows, and both backwards."""

    def __init__(self, passages: list[np.ndarray], texts: np.ndarray, labels: np.ndarray, rows_of: list[np.ndarray]):
        tokens = np.concatenate(passages)
        words, self.tokens = np.unique(tokens, return_inverse=True)
        counts = np.array([len(p) for p in passages])
        self.starts = _starts(counts)
        self.sizes = np.maximum(counts, LEAST_WORDS)
        self.texts, self.text_labels = texts, labels
        by_word = np.argsort(self.tokens, kind="stable")
        self.passage_of_token = np.repeat(np.arange(len(passages)), counts)[by_word]
        self.word_starts = np.searchsorted(self.tokens[by_word], np.arange(len(words)))
        rows = [rows_of[w] for w in words]
        self.row_sizes = np.array([len(r) for r in rows])
        self.row_starts = _starts(self.row_sizes)
        flat = np.concatenate(rows)
        order = np.argsort(flat, kind="stable")
        self.used, firsts = np.unique(flat[order], return_index=True)
        self.place = np.searchsorted(self.used, flat).astype(np.int32)
        self.word_of_row = np.repeat(np.arange(len(words), dtype=np.int32), self.row_sizes)[order]
        self.used_starts = firsts

    def passages(self, table: np.ndarray) -> np.ndarray:
        words = _means(table[self.used][self.place], self.row_starts, self.row_sizes)
        return _means(words[self.tokens], self.starts, self.sizes)

    def slopes(self, by_passage: np.ndarray) -> np.ndarray:
        """The gradient of the table rows in ``used``, given that of the passages."""
        by_passage = by_passage / self.sizes[:, None].astype(np.float32)
        words = np.add.reduceat(by_passage[self.passage_of_token], self.word_starts, axis=0)
        words /= self.row_sizes[:, None].astype(np.float32)
        return np.add.reduceat(words[self.word_of_row], self.used_starts, axis=0)

    def errors(self, margins: np.ndarray) -> np.ndarray:
        """The gradient of the loss by each passage's margin; every text weighs the same."""
        count = len(self.text_labels)
        highest = np.full(count, -np.inf)
        np.maximum.at(highest, self.texts, margins)
        odds = 1 / (1 + np.exp(-np.clip(highest, -30, 30)))
        seeming = np.exp(margins - highest[self.texts])
        share = seeming / np.bincount(self.texts, seeming, count)[self.texts]
        return (share * (odds - self.text_labels)[self.texts]).astype(np.float32)


def fit(texts: list[list[str]], labels: np.ndarray, share: float) -> Model:
    """Trains on texts given as passages, words parted by blanks; the same input always gives the same model."""
    toxic = labels.mean() if len(labels) else 0.5
    if toxic in (0.0, 1.0) or len(labels) < 2 * CALIBRATION:
        return Model(None, 0.0, 1.0, 0.0, share)
    numbers: dict[str, int] = {}
    coded = [[np.array([numbers.setdefault(w, len(numbers)) for w in p.split(" ")], np.int32) for p in t] for t in texts]
    rows_of = [np.array(buckets_of(w), np.int32) for w in numbers]
    held = np.zeros(BUCKETS, np.int64)
    for passages in coded:
        if passages:
            held[np.unique(np.concatenate([rows_of[w] for w in np.unique(np.concatenate(passages))]))] += 1
    common = (held >= LEAST_TEXTS)[:, None].astype(np.float32)
    rng = np.random.default_rng(12)
    order = rng.permutation(len(texts))
    ours = [i for n, i in enumerate(order) if n % CALIBRATION and coded[i]]
    rest = [i for n, i in enumerate(order) if n % CALIBRATION == 0]

    def batch(chosen):
        passages = [p for i in chosen for p in coded[i]]
        return Batch(passages, np.repeat(np.arange(len(chosen)), [len(coded[i]) for i in chosen]), labels[chosen], rows_of)

    batches = [batch(ours[k::BATCHES]) for k in range(BATCHES) if ours[k::BATCHES]]
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32) * common
    softmax = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, softmax, bias)]

    def step(n, which, value, at, slope):
        first, second = moments[which]
        first[at] = 0.9 * first[at] + 0.1 * slope
        second[at] = 0.99 * second[at] + 0.01 * slope**2
        rate = RATE * np.sqrt(1 - 0.99**n) / (1 - 0.9**n)
        value[at] -= rate * first[at] / (np.sqrt(second[at]) + FLOOR)

    n = 0
    for _ in range(EPOCHS):
        for some in batches:
            n += 1
            vectors = some.passages(table)
            logits = vectors @ softmax + bias
            error = some.errors(logits[:, 1] - logits[:, 0])
            by_logit = np.stack([-error, error], axis=1)
            by_table = some.slopes(by_logit @ softmax.T) * common[some.used]
            step(n, 1, softmax, slice(None), vectors.T @ by_logit)
            step(n, 2, bias, slice(None), by_logit.sum(axis=0))
            step(n, 0, table, some.used, by_table)
            rows = table[some.used]
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            table[some.used] = rows * np.maximum(0, 1 - RATE * SHRINK / np.maximum(norms, 1e-9))
    folded = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
    model = Model(folded, float(bias[1] - bias[0]), 1.0, 0.0, share)
    weights = np.array([folded[r].mean() for r in rows_of])
    means = [[weights[p].sum() / max(len(p), LEAST_WORDS) for p in coded[i]] for i in rest]
    margins = np.array([model.bias + max(m, default=0.0) for m in means])
    slope, offset = _line(margins, labels[rest])
    odds = np.log(share / (1 - share)) - np.log(toxic / (1 - toxic)) if 0 < share < 1 else 0.0
    model.slope, model.offset = slope, offset + float(odds)
    return model


def _line(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and offset of the logistic line through the margins, by Newton's method with a small prior."""
    spread = margins.std() or 1.0
    x = np.stack([(margins - margins.mean()) / spread, np.ones(len(margins))], axis=1)
    line = np.zeros(2)
    for _ in range(rounds):
        odds = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (odds - labels) + 0.1 * line
        curve = (x * (odds * (1 - odds))[:, None]).T @ x + 0.1 * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, slope), -2, 2)
    gain = max(line[0], 0.0) / spread
    return float(gain), float(line[1] - gain * margins.mean())


def held_out() -> Column:
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_passages: int = MAX_PASSAGES) -> Model:
    """Fits a model; what reaches the driver is bounded by ``max_rows`` and ``max_passages``."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    known = known.agg(F.min("toxic").alias("low"), F.max("toxic").alias("toxic"))
    known = known.filter("low = toxic and toxic in (0, 1)").select("doc_id", "toxic")
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r for c in (0, 1) for r in known.filter(F.col("toxic") == c).orderBy(*order).limit(max_rows).collect()]
    small = documents.sparkSession.createDataFrame(chosen, "doc_id bigint, toxic int")

    @F.pandas_udf("array<string>")
    def passages(texts: pd.Series) -> pd.Series:
        return pd.Series([[" ".join(p) for p in passages_of(words_of(t))] for t in texts])

    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(small), "doc_id")
    cut = texts.select("doc_id", "toxic", F.xxhash64("text").alias("t"), F.posexplode(passages("text")).alias("at", "passage"))
    cut = cut.filter(F.octet_length("passage") <= PASSAGE_BYTES).distinct()
    rows = cut.orderBy(*order, "t", F.xxhash64("passage"), "at").limit(max_passages).toArrow()
    texts, found = {}, []
    for doc_id, toxic, t, passage in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "toxic", "t", "passage"))):
        if (doc_id, t) not in texts:
            texts[doc_id, t] = len(found)
            found.append((float(toxic), []))
        found[texts[doc_id, t]][1].append(passage)
    return fit([p for _, p in found], np.array([y for y, _ in found]), share)


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with one more column, the score of the whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(texts.tolist()))

    return documents.withColumn(column, scored(F.coalesce(documents["text"], F.lit(""))))


def judged(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = learn(documents, labels, max_rows)
    rows = score(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

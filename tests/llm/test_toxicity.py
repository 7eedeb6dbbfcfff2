import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from musterline.llm import toxicity
from tests.llm.samples import FIELDS, awkward, frame, prose

SMALL = "/root/testdata/sf0.01"


def sample(count=800, seed=5):
    """(text, label): prose, the toxic half of it with a made-up insult, its endings varied."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        words = prose(1000 * seed + i, rng.randint(30, 300)).split()
        if i % 2:
            words.insert(rng.randrange(len(words)), "zwikfo" + "".join(rng.choice("abcdefgh") for _ in range(3)))
        out.append((" ".join(words), i % 2))
    return out


def passages(text):
    return [" ".join(p) for p in toxicity.passages_of(toxicity.words_of(text))]


@pytest.fixture(scope="module")
def model():
    rows = sample()
    return toxicity.fit([passages(t) for t, _ in rows], np.array([float(y) for _, y in rows]), 0.5)


def test_unseen_endings_are_caught_and_clean_texts_left_alone(model):
    rows = sample(seed=6)
    found = model.scores([t for t, _ in rows]) >= 0.3
    labels = np.array([y for _, y in rows]) == 1
    assert found[labels].mean() > 0.98 and found[~labels].mean() < 0.02


def test_misspelling_in_a_very_long_text(model):
    long = prose(77, 20_000).split()
    clean, toxic = (model.margin(" ".join(long[:9_000] + some + long[9_000:])) for some in ([], ["zwikfohhh"]))
    assert toxic > clean + 2 and model.scores([" ".join(long[:2_000])])[0] < 0.3


def test_scores_equal_a_plain_loop(model):
    def plain(text):
        words = toxicity._WORD.findall(text.lower())
        cuts = [n for n in range(0, len(words), 64) if n == 0 or len(words) - n > 32]
        worst = 0.0
        for a, b in zip(cuts, [*cuts[1:], len(words)]):
            total, distinct = 0.0, set(words[a:b])
            for word in distinct:
                marked = "<" + word + ">"
                grams = [marked] + [marked[i : i + k] for k in (3, 4, 5, 6) for i in range(len(marked)) if i + k <= len(marked)]
                total += sum(model.numbers[zlib.crc32(g.encode()) % (1 << 17)] for g in grams) / len(grams)
            mean = total / max(len(distinct), 16)
            worst = mean if a == 0 else max(worst, mean)
        return 1 / (1 + np.exp(-(model.slope * (model.bias + worst) + model.offset)))

    texts = [t or "" for _, t in awkward()] + [t for t, _ in sample(20)]
    assert np.allclose(model.scores(texts), [plain(t) for t in texts])


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(1)
    rows_of = [np.array(rng.integers(0, 9, 4), np.int32) for _ in range(6)]
    texts, labels = np.array([0, 0, 1, 2]), np.array([1.0, 0.0, 1.0])
    batch = toxicity.Batch([np.array(p) for p in ([0, 1, 2], [3, 1], [4, 5, 0], [2])], texts, labels, rows_of)
    table, softmax = rng.normal(size=(9, 3)), rng.normal(size=(3, 2))
    weights = rng.normal(size=4)

    def value(t):
        logits = batch.passages(t) @ softmax
        return float(weights @ (logits[:, 1] - logits[:, 0]))

    slopes = batch.slopes(np.stack([-weights, weights], axis=1) @ softmax.T)
    for n, row in enumerate(batch.used):
        for k in range(3):
            up = table.copy()
            up[row, k] += 1e-4
            down = table.copy()
            down[row, k] -= 1e-4
            assert abs((value(up) - value(down)) / 2e-4 - slopes[n, k]) < 1e-4


def test_awkward_rows_and_labels(spark):
    docs = frame(spark, awkward(), clashing=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 1), (4, 0, 0), (5, 1, None), (None, 1, 1), (9, 1, 7)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        found = toxicity.judged(docs, known).collect()
        assert len(found) == len(awkward())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
        ids = {r.doc_id: r.held_out for r in found}
        assert ids[None] is False and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in ids.items() if i is not None)
    assert toxicity.judged(spark.createDataFrame([], FIELDS), labels).count() == 0


def test_held_out_labels_play_no_part(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pylist()
    held = [i for i in range(len(labels)) if zlib.crc32(str(labels[i]["doc_id"]).encode()) % 4 == 2]
    turned = [{**r, "toxic": 1 - r["toxic"]} if i in set(held) else r for i, r in enumerate(labels)]
    schema = "doc_id bigint, quality int, toxic int"
    one, other = (toxicity.learn(docs, spark.createDataFrame([(r["doc_id"], r["quality"], r["toxic"]) for r in rows], schema), 50) for rows in (labels, turned))
    assert held and np.array_equal(one.numbers, other.numbers) and one.offset == other.offset

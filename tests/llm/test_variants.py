import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from musterline.llm import variants
from tests.llm.samples import FIELDS, awkward, frame

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, altered):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if altered and h % altered == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words.get(form[w])


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("altered", [None, 3])
def test_equals_plain(spark, altered):
    spelled = ["colouring", "coloring", "colourings", "Colouring", "colouringss", "été×÷éèà", "été×÷éè", "étéx÷éèà", "aaaaaaaa", "aaaaaaab", "aaaaaaa", "baaaaaaa"]
    rows = awkward() + [(100 + i, " ".join([w] * (3 * 11 ** (i % 4)))) for i, w in enumerate(spelled)]
    docs = frame(spark, rows, clashing=True).drop("words")
    found = [tuple(r[c] for c in COLUMNS) for r in variants.grouped(docs, altered).collect()]
    want = list(plain(rows, altered))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert any(w[1] and w[2] != w[1] for w in want) or altered


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {tuple(r) for r in variants.roots(forms).collect()} == {(f"w{i}", "w11") for i in range(11)}


def test_no_documents(spark):
    assert variants.grouped(spark.createDataFrame([], FIELDS), 31).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("abcàÿ", min_size=7, max_size=12), st.integers(0, 30), st.sampled_from("abdÿ"), st.sampled_from(["in", "out", "other"]))
def test_near_words_share_a_key(word, at, letter, kind):
    at %= len(word)
    edited = {"in": word[:at] + letter + word[at:], "out": word[:at] + word[at + 1 :], "other": word[:at] + letter + word[at + 1 :]}[kind]
    if edited == word:
        return
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"word": [word, edited]})
    rows = next(variants.signatures(iter([batch]))).to_pylist()
    keys = [{(r["key"], r["longer"]) for r in rows if r["word"] == w} for w in (word, edited)]
    assert any(k == j and not (a and b) for k, a in keys[0] for j, b in keys[1])

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from musterline.llm import merkle
from tests.llm.samples import FIELDS, awkward, frame

def altered():
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit("")))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            first = i // 3 * 3
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        at = [i // 3 for i in at]
        nodes = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    leaves = [plain_leaf(r, r.text) for r in rows]
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[row.source].append(i)
    subroots, paths = {}, {}
    for source, own in groups.items():
        own.sort(key=lambda i: (rows[i].doc_id is not None, rows[i].doc_id or 0, leaves[i]))
        subroots[source], found = plain_tree([leaves[i] for i in own])
        paths |= dict(zip(own, found))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    root, above = plain_tree([subroots[s] for s in order])
    above = dict(zip(order, above))
    for i, row in enumerate(rows):
        path = paths[i] + above[row.source]
        even = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0
        folded = plain_leaf(row, row.text.replace("\n", "") if even and row.text is not None else row.text)
        for before, after in path:
            folded = digest(before + folded + after)
        proof = digest("".join(b + a for b, a in path))
        yield row.doc_id, leaves[i], subroots[row.source], root, proof, folded, folded == root


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_awkward_rows(spark, levels):
    docs = frame(spark, awkward(), clashing=True).withColumns({c: F.lit("x") for c in ("tree", "pos", "many", "digest", "chunk", "path", "top")})
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 1, None).when(F.col("doc_id") % 5 == 2, "ü").otherwise(F.col("source")))
    docs = docs.unionByName(docs.filter("doc_id = 12"))
    found = merkle.verified(docs, altered(), levels).select(*COLUMNS)
    want = Counter(plain_manifest(docs.collect()))
    assert Counter(map(tuple, found.collect())) == want
    assert {w[-1] for w in want} == {True, False}


def test_sizes_around_runs_and_chunks(spark):
    sizes = [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 82]
    rows = [(n * 1000 + i, f"{n} {i}\n", "en", f"s{n}", 3) for n in sizes for i in range(n)]
    docs = spark.createDataFrame(rows, FIELDS)
    found = merkle.verified(docs, altered(), 2).select(*COLUMNS)
    assert Counter(map(tuple, found.collect())) == Counter(plain_manifest(docs.collect()))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "a\nb", "en", None, 3)], FIELDS)
    got = merkle.verified(one).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(7, got[0].leaf, got[0].leaf, got[0].leaf, digest(""), got[0].leaf, True)]
    assert merkle.verified(spark.createDataFrame([], FIELDS), altered()).count() == 0


def test_one_shuffle_for_all_levels_of_a_chunk(spark):
    nodes = spark.range(100).select((F.col("id") % 2).cast("string").alias("tree"), F.col("id").alias("pos"), F.lit(100).alias("many"), F.lit("d").alias("digest"))
    plan = merkle._levels(nodes, 4, siblings=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tree") == 1 and plan.count("Exchange") == 1

"""Classifier, URL filter, chat formatting, token files, the pipeline, and the queries against their SQL."""

import math
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from musterline.llm import CHECKS, QUERIES, chat, quality, queries, token_files, urls
from tests.llm.samples import FIELDS, awkward, frame, prose
from tests.llm.test_documents import MODEL, plain_hits, plain_lines, plain_near

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


# Quality


def test_scores_learn_and_hold_on_unseen_documents(spark):
    rows = [(i, prose(i, 60 + i % 40).capitalize() + ".") for i in range(160)]
    rows += [(1000 + i, prose(i, 50).upper().replace(" ", "!! ")) for i in range(80)]
    labels = [(i, int(i < 1000), 0) for i, _ in rows] + [(3, 1, 0), (7, 0, 0), (99999, 1, 0), (None, 0, 0), (8, None, 0), (9, 5, 0)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    found = quality.judged(docs, marks).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in found)
    unseen = [r for r in found if r.held_out]
    assert unseen and all(r.predicted == int(r.doc_id < 1000) for r in unseen)
    # Labels of held-out documents change nothing.
    turned = [(i, 1 - q if q in (0, 1) and held(i) else q, t) for i, q, t in labels]
    again = quality.judged(docs, spark.createDataFrame(turned, LABELS)).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in found)


def test_scores_of_awkward_rows(spark):
    docs = frame(spark, awkward(), clashing=True)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], LABELS)
    assert quality.judged(docs, labels).count() == len(awkward())
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.judged(docs, nothing).collect()} == {0.5}
    assert quality.accepted(docs, nothing).columns == docs.columns
    assert quality.judged(spark.createDataFrame([], FIELDS), labels).count() == 0
    only_good = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)], LABELS)
    assert all(r.score > 0.99 for r in quality.judged(docs, only_good).collect())


def test_pairs_catch_what_single_measures_cannot():
    rng = np.random.default_rng(0)
    values = rng.uniform(-1, 1, (4000, 3))
    labels = (values[:, 0] * values[:, 1] > 0).astype(float)
    model = quality.fit(values[:3000], labels[:3000])
    right = (model.scores(values[3000:]) > 0.5) == labels[3000:]
    assert right.mean() > 0.9


def test_the_sample_is_bounded(spark):
    rows = [(i, prose(i, 20)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    model = quality.learn(frame(spark, rows), labels, max_rows=6)
    assert len(model.edges) == len(quality.MEASURES)


# URLs


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def plain_rule(host, path):
    fits = []
    for rule, verdict in urls.RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


class PlainModel:
    def __init__(self, texts):
        self.count = [Counter() for _ in range(urls.CONTEXT + 1)]
        for t in texts:
            framed = urls.START * urls.CONTEXT + t + urls.END
            for i in range(urls.CONTEXT, len(framed)):
                for k in range(urls.CONTEXT + 1):
                    self.count[k][framed[i - k : i + 1]] += 1
        self.after = defaultdict(dict)
        for k in range(urls.CONTEXT + 1):
            for gram, n in self.count[k].items():
                self.after[k, gram[:-1]][gram[-1]] = n

    def chance(self, gram, less):
        p = 1 / urls.CHARACTERS
        for k in range(urls.CONTEXT + 1):
            g = gram[len(gram) - 1 - k :]
            n = self.count[k].get(g, 0)
            total = sum(self.after[k, g[:-1]].values())
            kinds = len(self.after[k, g[:-1]])
            if less:
                kinds -= n == 1
                n, total = max(n - 1, 0), max(total - 1, 0)
            if total + kinds > 0:
                p = (n + kinds * p) / (total + kinds)
        return p


def plain_scores(pages):
    parts = [plain_parts(u) for _, u in pages]
    rules = [plain_rule(*p) for p in parts]
    models = {v: PlainModel(h + p for (h, p), (_, x) in zip(parts, rules) if x == v) for v in ("allow", "block")}
    scores = []
    for (h, p), (_, verdict) in zip(parts, rules):
        framed, total = urls.START * urls.CONTEXT + h + p + urls.END, 0.0
        for i in range(urls.CONTEXT, len(framed)):
            g = framed[i - urls.CONTEXT : i + 1]
            total += math.log(models["allow"].chance(g, verdict == "allow")) - math.log(models["block"].chance(g, verdict == "block"))
        scores.append(total / (len(framed) - urls.CONTEXT))
    return parts, rules, scores


def test_url_scores_and_verdicts(spark):
    pages = [(r["page_id"], r["url"]) for r in pq.read_table(f"{SMALL}/pages.parquet", columns=["page_id", "url"]).to_pylist()]
    pages += [
        (-1, None), (-2, ""), (-3, "no scheme/x"), (-4, "http://"), (-5, "HTTP://EXAMPLE.COM"), (-6, "http://Éx.com/EN/"),
        (-7, "https://www.example.com/en/a?b#c"), (-8, "x://net/es/1"), (-8, "x://net/es/1"), (None, "http://a.org/" + "q" * 3000),
        (-9, "http://a.example.com/en/"), (-10, "a://b://c.net/fr/"), (-11, "http://example.com?x"), (-12, "http://xcom/"),
    ]
    table = spark.createDataFrame(pages, "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("text", "decided", "n")})
    found = urls.judged(table).collect()
    parts, rules, scores = plain_scores(pages)
    assert len(found) == len(pages)
    want = Counter((i, h, p, r) for (i, _), (h, p), (r, _) in zip(pages, parts, rules))
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in found) == want
    plain = {(h, p): s for (h, p), s in zip(parts, scores)}
    decided = {r.rule: r.verdict for r in found if r.rule}
    assert all(decided[r] == v for r, v in urls.RULES if r in decided)
    rest = [r for r in found if r.rule is None]
    assert rest and all(abs(r.score - plain[r.host, r.path]) < 1e-6 for r in rest)
    # The threshold errs least on the decided URLs.
    known = [(v, s) for (_, v), s in zip(rules, scores) if v]
    total = Counter(v for v, _ in known)

    steps = [(round(s * urls.STEPS) - 0.5) / urls.STEPS for _, s in known]
    # Verdicts agree with a threshold of least error, rounded scores standing for the scores.
    best = min(errors_of_steps(known, total, c) for c in steps)
    cuts = [c for c in steps if errors_of_steps(known, total, c) == best]
    assert any(all((r.verdict == "allow") == (r.score >= c) for r in rest) for c in cuts)


def errors_of_steps(known, total, cut):
    return round(sum(1 / total[v] for v, s in known if (v == "allow") != (round(s * urls.STEPS) / urls.STEPS >= cut)), 9)


def test_urls_without_decided_ones(spark):
    table = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in urls.judged(table).collect()} == {"allow"}
    assert urls.judged(table.limit(0)).count() == 0


# Chat


@pytest.mark.parametrize("stretch", [chat.STRETCH, 2])
def test_perspectives(spark, stretch):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 5, "ann", "x" * 5000), (1, 5, "cy", "tie"),
        (1, None, "bob", "late"), (2, 0, "system", "alone"), (None, 1, None, "nobody"), (None, 2, "a<|b", "n"), (3, 1, "u", "same"), (3, 1, "u", "same"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat.perspectives(table.withColumn("own", F.lit(1)), stretch=stretch).collect()
    turns = sorted(
        ((c, t, r or "unknown", x or "") for c, t, r, x in rows), key=lambda t: (str(t[0]), t[1] is None, t[1] or 0, t[2], t[3])
    )
    want = []
    for conv in {c for c, *_ in turns}:
        own = [t for t in turns if t[0] == conv]
        for who in {t[2] for t in own} - {"system"}:
            whole = ""
            for n, (_, turn, role, text) in enumerate(own):
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role.replace('<|', '< |')}|>\n"
                body = text.replace("<|", "< |") + "<|end|>\n"
                start = len(whole)
                whole += head + body
                mask = (start + len(head), len(whole)) if role == who else (None, None)
                want.append((conv, who, n + 1, turn, role, head + body, start, *mask))
    assert Counter(tuple(r) for r in found) == Counter(want)
    assert chat.perspectives(table.limit(0)).count() == 0


# Token files


def test_token_counts(spark, tmp_path):
    rows = awkward()
    ranks = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    folder = str(tmp_path / "tokens")
    order = token_files.write_token_files(frame(spark, rows, clashing=True).repartition(3), folder, ranks)
    encoding = token_files.tokenizer(token_files.read_ranks(ranks))
    want = Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t in rows)
    for block in (token_files.BLOCK_TOKENS, 7, 1):
        if block == 1:
            block = 1000
        counts = token_files.document_lengths(spark, folder, block_tokens=block)
        joined = order.join(counts, ["file", "ordinal"])
        assert Counter((r.doc_id, r.n_tokens) for r in joined.collect()) == want


@pytest.mark.parametrize("block", [1, 2, 3, 4, 100])
def test_ends_at_block_borders(spark, tmp_path, block):
    end = token_files.END
    files = {"a": [end, end, 1, 2, 3, 4, 5, 6, 7, end, 8], "b": [], "c": [1, 2, 3], "d": [1, 2, end]}
    for name, tokens in files.items():
        (tmp_path / f"tokens-{name}.bin").write_bytes(np.array(tokens, "<u2").tobytes())
    found = token_files.document_lengths(spark, str(tmp_path), block_tokens=block).collect()
    got = sorted((r.file[7], r.ordinal, r.n_tokens) for r in found)
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 7), ("a", 3, 1), ("c", 0, 3), ("d", 0, 2)]


def test_no_documents_no_files(spark, tmp_path):
    folder = str(tmp_path / "none")
    none = spark.createDataFrame([], FIELDS)
    order = token_files.write_token_files(none, folder, f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert order.count() == 0 and token_files.document_lengths(spark, folder).count() == 0


def test_scores_equal_a_plain_loop_over_bins():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(400, len(quality.MEASURES)))
    model = quality.fit(values, (values[:, 0] * values[:, 1] + values[:, 2] > 0).astype(float))
    assert model.pairs

    def bin_of(edges, value):
        return sum(1 for e in edges if e <= value)

    for row, score in zip(values, model.scores(values)):
        total = model.base
        for m, value in enumerate(row):
            total += model.tables[m][bin_of(model.edges[m], value)]
        for a, b, table in model.pairs:
            total += table[bin_of(model.coarse[a], row[a])][bin_of(model.coarse[b], row[b])]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


# Pipeline and queries


def test_pipeline_equals_plain_stages(spark):
    documents = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    rows = [(d["doc_id"], d["text"]) for d in documents]
    order = [r.doc_id for r in spark.createDataFrame(rows, "doc_id bigint, text string").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = dict(rows)
    learnt = [i for i in order if i in labels and not held(i)]
    model = quality.fit(np.array([quality.measures_of(texts[i]) for i in learnt]), np.array([float(labels[i]) for i in learnt]))
    good = [(i, t) for i, t in rows if model.scores(quality.measures_of(t)[None])[0] >= 0.5]
    cut = [(i, t) for (i, t), n in plain_lines(good).items() if t or t == texts[i]]
    stay = set(plain_near(cut))
    kept = [(i, t) for i, t in cut if i in stay]
    dirty = {i for i, _, hit, _ in plain_hits(kept, items) if hit}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {i: np.array(sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for i, t in kept if i not in dirty}
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: bytes(r.ids) for r in found} == want and len(found) == len(want)
    assert 0 < len(want) < len(rows) and all(r.n_tokens * 4 == len(r.ids) for r in found)


def test_the_last_stage_decodes_what_it_encodes(spark):
    docs = frame(spark, awkward(), clashing=True).drop("ids", "decoded")
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    found = corpus_pipeline.to_tokens(spark, docs, SMALL).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert Counter((r.doc_id, r.decoded) for r in found) == Counter((i, sp.decode(sp.encode(t))) for i, t in texts.elements())


def test_stages_take_awkward_rows(spark):
    docs = frame(spark, awkward(), clashing=True).drop("ids", "decoded")
    for docs_in in (docs, spark.createDataFrame([], FIELDS)):
        now = docs_in
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SMALL)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs_in.columns
        assert now.count() <= docs_in.count()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    ours = QUERIES[name](spark, SMALL)
    theirs = con.execute(CHECKS[name]).to_arrow_table().to_pylist()
    assert theirs and set(ours.columns) == set(theirs[0])

    def plain(v):
        return int(v) if isinstance(v, Decimal) else v

    columns = sorted(ours.columns)
    assert Counter(tuple(r[c] for c in columns) for r in ours.collect()) == Counter(tuple(plain(r[c]) for c in columns) for r in theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_has_a_row_for_every_row(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    assert QUERIES[name](spark, SMALL).count() == pq.read_table(f"{SMALL}/{table}.parquet").num_rows

"""The operators on documents against plain Python, on awkward rows."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from musterline.llm import decontamination, fingerprints, lines, near_copies, pieces, queries, simhash, suffixes
from tests.llm.samples import CLASHING, FIELDS, awkward, frame, prose

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, clashing=True).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# Fingerprints


def test_edited_texts_and_fingerprints(docs, rows):
    found = fingerprints.fingerprints_with_edits(docs).collect()
    assert len(found) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    texts = [(i, t or "") for i, t in order]
    nulls = [t for i, t in rows if i is None]
    by_id = {r.doc_id: r for r in found}
    for (i, t), (_, after) in zip(texts[:-1], texts[1:]):
        if i == 20:  # the two equal rows have different next ones
            continue
        half = len(t) // 2
        assert by_id[i].n_chars == len(t)
        assert by_id[i].edited_sha256 == sha((t[: len(t) - half] + after[:half]).encode())
        assert 0 <= by_id[i].near_edited <= 1 and 0 <= by_id[i].near_next <= 1
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint
    # The smallest id is followed by the rows without an id, the last of which is followed by the first row.
    first = texts[-1][1]
    assert by_id[1].edited_sha256 in {sha((first[: len(first) - len(first) // 2] + n[: len(first) // 2]).encode()) for n in nulls}
    last = {r.edited_sha256 for r in found if r.doc_id is None}
    top = texts[0][1]
    assert last & {sha((n[: len(n) - len(n) // 2] + top[: len(n) // 2]).encode()) for n in nulls}


def test_fingerprints_of_none_and_one(spark, none):
    assert fingerprints.fingerprints_with_edits(none).count() == 0
    alone = fingerprints.fingerprints_with_edits(frame(spark, [(5, "abcdef")])).collect()
    assert [(r.doc_id, r.edited_sha256) for r in alone] == [(5, sha(b"abcabc"))]


def test_spans_and_extensions():
    a, b = fingerprints.Prefixes("the quick brown fox"), fingerprints.Prefixes("a quick brown cat")
    assert a.same(4, b, 2, 11) and not a.same(4, b, 2, 13)
    assert a.common_extension(4, b, 2) == len("quick brown ")
    assert a.common_extension_left(15, b, 13) == len(" quick brown")
    hashes = fingerprints.Prefixes("abcabcabc").span_hashes(3)
    assert hashes[0] == hashes[3] == hashes[6] != hashes[1]


def test_likeness_follows_the_common_share():
    text = prose(7, 900)
    whole = fingerprints.fingerprint_of(fingerprints.Prefixes(text))
    for share in (0.25, 0.5, 0.75):
        cut = int(len(text) * share)
        mixed = text[:cut] + prose(8, 900)[: len(text) - cut]
        other = fingerprints.fingerprint_of(fingerprints.Prefixes(mixed))
        assert abs(fingerprints.likeness(whole, other) - share) < 0.25
    assert fingerprints.likeness(whole, whole) == 1.0


# SimHash


def plain_simhash(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("slice_rows", [simhash.SLICE, 2])
def test_components(spark, docs, rows, slice_rows):
    near = [(100 + i, prose(1, 120) + f" tail{i}") for i in range(30)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id bigint, text string"))
    everything = rows + near
    prints = [plain_simhash(t) for _, t in everything]
    want = Counter(zip((i for i, _ in everything), prints, plain_components([i for i, _ in everything], prints)))
    found = simhash.components(table, slice_rows).withColumn("h", simhash.as_hex(F.col("fingerprint"))).collect()
    assert Counter((r.doc_id, int(r.h, 16), r.component_id) for r in found) == want


def test_links_join_what_is_within_four_bits(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(15):
            for b in rng.integers(0, 64, 3).tolist():
                c ^= 1 << b
            prints.add(c)
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table, 4).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    group = {p: p for p in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        group[find(a)] = find(b)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 4:
                assert find(a) == find(b)


def test_one_of_each_keeps_the_smallest_id_and_the_columns(docs, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and not {2, 20, None} & set(ids) - {None} and ids.count(4) == 1
    assert simhash.one_of_each(none).count() == 0 and simhash.components(none).count() == 0


def plain_sets(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_near(rows):
    """The ids kept: the smallest of each group that pairs of similarity 0.8 or more connect."""
    sets, group = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted(least.values())


@pytest.mark.parametrize("slice_rows", [near_copies.SLICE, 2])
def test_one_of_each_drops_all_near_copies(spark, slice_rows):
    common, rows = prose(99, 30), []
    for n in range(12):
        words = prose(300 + n, 150).split()
        rows.append((n * 100, " ".join(words)))
        for k in range(1, 7):  # every changed word changes five shingles
            edited = words[:]
            for place in range(k):
                edited[10 + 20 * place + n] = f"edit{n}x{k}x{place}"
            rows.append((n * 100 + k, " ".join(edited)))
    rows += [(5000 + n, common + " " + prose(700 + n, 40)) for n in range(15)]  # a common passage, else different
    chain = prose(800, 200).split()
    rows += [(6000 + n, " ".join(chain[6 * n : 6 * n + 100])) for n in range(12)]  # each like the next ones only
    rows += [(7000, "a b c"), (7001, "A  b c"), (7002, "a b d"), (7003, ""), (7004, " ")]
    kept = simhash.one_of_each(frame(spark, rows).repartition(5), slice_rows)
    assert sorted(r.doc_id for r in kept.collect()) == plain_near(rows)
    assert not {1, 2, 3, 6001, 6011, 7001, 7004} & set(plain_near(rows)) and {5000, 5014, 7002} <= set(plain_near(rows))


@pytest.mark.parametrize("slice_rows", [near_copies.SLICE, 2])
def test_one_of_each_drops_what_fingerprints_link(spark, slice_rows):
    """Two texts of close fingerprints, too unlike for near copies, each with near copies of its own."""
    words = prose(45, 800).split()
    edited = [f"edit{at}" if at % 35 == 0 else w for at, w in enumerate(words)]
    first, second = " ".join(words), " ".join(edited)
    apart = simhash.fingerprint_of(first.encode()) ^ simhash.fingerprint_of(second.encode())
    assert (apart & (1 << 64) - 1).bit_count() <= 4 and len(plain_near([(1, first), (2, second)])) == 2
    rows = [(5, first), (6, first + " tail"), (3, second), (4, second + " tail"), (9, prose(42, 300)), (8, "")]
    kept = simhash.one_of_each(frame(spark, rows).repartition(3), slice_rows, fingerprints=True)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_parities_never_differ_in_more_places_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(1, 6000), dtype=np.uint64)
        other = np.concatenate([base[: rng.integers(0, len(base) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 6000), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        found = near_copies.differing([near_copies.parities_of(a)], [near_copies.parities_of(b)])[0]
        assert found <= len(np.setxor1d(a, b))
    far = [near_copies.parities_of(np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64))) for _ in range(2)]
    assert near_copies.differing(far[:1], far[1:])[0] * 9 > 18_000  # unlike sets of any size are told apart


def test_sets_under_one_shingle_are_compared_in_bounded_pieces():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(900, 1100, 700)]
    for n in range(0, 700, 20):
        sets[n + 1] = np.unique(np.concatenate([sets[n][3:], sets[n + 1][:3]]))
    bits = [near_copies.parities_of(s) for s in sets]
    assert len(set(map(len, bits))) == 2
    numbers, sizes = np.arange(len(sets)), [len(s) for s in sets]
    columns = [numbers, pa.array(sizes, pa.int32()), np.zeros(len(sets), np.int32), numbers // 2 * 2 - numbers % 20, pa.array(bits, pa.binary())]
    rows = pa.table(columns, names=["node", "size", "at", "component", "bits"])
    tracemalloc.start()
    side = near_copies.Side(rows)
    pairs = [set(zip(*(nodes.tolist() for nodes in found))) for found in (side.possible(side), side.possible(near_copies.Side(rows)))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = {(n, n + 1) for n in range(0, 700, 20)}
    assert pairs == [plain, plain | {(b, a) for a, b in plain}]
    assert peak < 40 << 20  # all 490,000 pairs at once took over 200 MB


# Repeated byte strings


def plain_suffixes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = [m.span() for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((bytes(b for b, g in zip(d, gone) if not g), runs))
    return out


@pytest.mark.parametrize("hot", [suffixes.SEGMENTS, 2])
def test_repeated_bytes(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "SEGMENTS", hot)
    passage = prose(30, 45)  # over 200 bytes, among different neighbours
    spread = [(200 + i, prose(40 + i, 30) + " " + passage + " " + prose(80 + i, 30)) for i in range(12)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(spread, "doc_id bigint, text string"))
    everything = rows + spread
    want = Counter((i, k, tuple(r)) for (i, _), (k, r) in zip(everything, plain_suffixes([t for _, t in everything], 200)))
    found = suffixes.without_repeats(table).collect()
    assert Counter((r.doc_id, bytes(r.kept), tuple((s.start, s.end) for s in r.removed)) for r in found) == want


def test_a_passage_in_many_surroundings_is_sorted_twice_at_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENTS", 2)
    passage, seen, plain = prose(30, 60), str(tmp_path), suffixes._sorted
    rows = [(n, prose(40 + n, 30) + " " + passage + " " + prose(200 + n, 30)) for n in range(40)]

    def counted(batches):
        whole = list(batches)
        groups = Counter(r for b in whole for r in zip(b.column("anchor").to_pylist(), b.column("part").to_pylist()))
        if groups:
            with open(f"{seen}/{max(groups.values())}", "w"):
                pass
        return plain(iter(whole))

    monkeypatch.setattr(suffixes, "_sorted", counted)
    found = suffixes.without_repeats(frame(spark, rows)).collect()
    want = Counter((i, k, tuple(r)) for (i, _), (k, r) in zip(rows, plain_suffixes([t for _, t in rows], 200)))
    assert Counter((r.doc_id, bytes(r.kept), tuple((s.start, s.end) for s in r.removed)) for r in found) == want
    assert 0 < max(int(f.name) for f in tmp_path.iterdir()) <= 12  # it stands in 40 texts


def test_suffix_order_is_that_of_the_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8).tobytes() + b"ab" * 500 + b"a" * 400
    starts = np.arange(len(data) - 60)
    found = suffixes.Suffixes(data, starts, 60)
    order = found.ordered()
    strings = [data[s : s + 60] for s in order.tolist()]
    assert strings == sorted(strings)
    counts = Counter(strings)
    assert found.repeated().tolist() == [s for s in starts.tolist() if counts[data[s : s + 60]] > 1]


def test_colliding_hashes_are_found_out(monkeypatch):
    data = (prose(9, 300) + prose(9, 40)).encode()
    monkeypatch.setattr(suffixes, "VALUES", np.zeros(256, dtype=np.uint64))  # everything collides
    found = suffixes.Suffixes(data, np.arange(len(data) - 199)).repeated()
    counts = Counter(data[i : i + 200] for i in range(len(data) - 199))
    assert found.tolist() == [i for i in range(len(data) - 199) if counts[data[i : i + 200]] > 1]


def test_windows_over_part_borders(monkeypatch):
    text = (prose(20, 400) + "|" + prose(21, 200)).encode()
    whole = {(a, f + k, p) for a, _, f, l, p in suffixes.segments_of(text) for k in range(l - f + 1)}
    monkeypatch.setattr(suffixes, "WINDOWS_AT_ONCE", 333)
    parts = {(a, f + k, p) for a, _, f, l, p in suffixes.segments_of(text) for k in range(l - f + 1)}
    assert whole == parts and len(whole) == len(text) - 199


def test_no_documents_no_suffixes(none):
    assert suffixes.without_repeats(none).count() == 0


# Decontamination


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_hits(rows, items):
    out = []
    for i, text in rows:
        words, hit, ids = plain_words(text), set(), set()
        for item, body in items:
            wanted = plain_words(body)
            size = min(10, len(wanted))
            if item is None or not size:
                continue
            windows = {tuple(wanted[p : p + size]) for p in range(len(wanted) - size + 1)}
            for p in range(len(words) - size + 1):
                if tuple(words[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    ids.add(str(item))
        out.append((i, len(words), tuple(sorted(hit)), tuple(sorted(ids))))
    return Counter(out)


def test_contamination(spark, docs, rows):
    long = prose(1, 120).split()
    items = [
        (1, " ".join(long[20:45])), (2, "ÉCOLE " + prose(2, 12)), (3, "ab ab ab"), (4, ""), (5, None), (None, prose(1, 30)),
        (6, "X"), (7, " ".join(["ab"] * 30)), (10, " ".join(long[40:49])), (10, " ".join(long[100:111])), (1, " ".join(long[20:45])),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit(1))
    found = decontamination.contamination(docs, benchmark).collect()
    got = Counter((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r["items"])) for r in found)
    assert got == plain_hits(rows, items)
    kept = decontamination.clean(docs, benchmark)
    clean = [i for (i, _, hit, _), n in plain_hits(rows, items).items() for _ in range(n) if not hit]
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, clean))


def test_long_items_stay_out_of_what_the_driver_holds(spark, docs, rows, monkeypatch):
    long = prose(5, 20_000)  # the text of document 16
    items = [(1, long), (2, prose(6, 3000)), (2, " ".join(long.split()[50:57])), (3, prose(2, 90))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    small, widths = decontamination.small_table, []

    def measured(df, most):
        widths.append({f.dataType.simpleString() for f in df.schema})
        return small(df, most)

    monkeypatch.setattr(decontamination, "small_table", measured)
    found = decontamination.contamination(docs, benchmark).collect()
    got = Counter((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r["items"])) for r in found)
    assert got == plain_hits(rows, items)
    assert widths and all(w <= {"bigint", "int"} for w in widths)


def test_contamination_without_rows(none, docs, spark):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(none, nothing).count() == 0
    assert not decontamination.contamination(docs, nothing).filter(F.size("hit_words") > 0).count()


# SentencePiece


def test_pieces_equal_the_library(docs, rows, none):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = pieces.encoded(docs.drop("ids", "decoded"), MODEL).collect()
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want[i, np.array(ids, "<u4").tobytes(), model.decode(ids)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in found) == want
    assert pieces.encoded(none, MODEL).count() == 0


def test_pieces_of_joined_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 50)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 50)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = pieces.Encoder(pieces.read_model(MODEL))
    rng = np.random.default_rng(1)
    vocabulary = sorted(encoder.ids)
    for _ in range(3000):
        text = "".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), rng.integers(0, 9)))
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == model.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.read_model(f"{queries.TOKENIZERS}/byte_bpe_50k.json")


# Lines


def plain_lines(rows, size=3):
    """Equal rows stand at one place, so they are left out of what is compared here."""
    places, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        parts = [] if text is None else text.split("\n")
        kept = [(n, x) for n, x in enumerate(parts) if x.strip(" \t\r")]
        gone = set()
        for p in range(len(kept)):
            runs = [min(size, len(kept)) if p == 0 else size]
            runs += [k for k in range(1, size) if sum(len(x.split()) for _, x in kept[p : p + k]) > 50][:1]
            for run in {r for r in runs if p + r <= len(kept)}:
                key = (run, *[x for _, x in kept[p : p + run]])
                if places.setdefault(key, (i, p)) != (i, p):
                    gone.update(range(kept[p][0], kept[p + run - 1][0] + 1))
        out.append((i, None if text is None else "\n".join(x for n, x in enumerate(parts) if n not in gone)))
    return Counter(out)


def test_repeated_runs_of_lines(spark, none):
    rows = [r for r in dict.fromkeys(awkward()) if r[0] is not None]
    docs = frame(spark, rows, clashing=True).drop("original", "runs")
    found = lines.without_repeats(docs)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == plain_lines(rows)
    kept = lines.deduplicated(frame(spark, rows, clashing=True))
    assert kept.columns == frame(spark, rows, clashing=True).columns
    texts = {r.doc_id: r for r in kept.collect()}
    assert 14 not in texts and texts[7].text is None and texts[6].text == ""
    assert texts[13].n_chars == len(texts[13].text) and len(CLASHING) + 5 == len(kept.columns)
    assert lines.without_repeats(none).count() == 0


def test_long_passages_of_one_or_two_lines(spark):
    long, half, other = prose(41, 51), prose(42, 30), prose(43, 30)
    short = prose(44, 50)
    rows = [(1, f"{prose(45, 9)}\n{long}\n{prose(46, 9)}"), (2, f"{prose(47, 9)}\n{prose(48, 9)}\n{long}"), (3, long)]
    rows += [(4, f"{half}\n\n{other}\n{prose(49, 9)}"), (5, f"{prose(50, 9)}\n{half}\n{other}"), (6, f"{other}\n{prose(51, 9)}")]
    rows += [(7, f"{short}\n{prose(52, 9)}\n{prose(53, 9)}"), (8, f"{short}\n{prose(54, 9)}\n{prose(55, 9)}")]
    texts = {r.doc_id: r.text for r in lines.without_repeats(frame(spark, rows)).collect()}
    assert Counter(texts.items()) == plain_lines(rows)
    assert texts[2] == rows[1][1].rsplit("\n", 1)[0] and texts[3] == "" and texts[5] == prose(50, 9)
    assert all(texts[i] == dict(rows)[i] for i in (1, 4, 6, 7, 8))


def test_equal_rows_are_no_repeats_of_each_other(spark):
    text = "one\ntwo\nthree\nfour"
    found = lines.without_repeats(frame(spark, [(1, text), (1, text), (2, text)]))
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, text), (1, text), (2, "")]

"""Each operator against brute force on hand-made rows with copies, nulls, empty texts and repeated rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from topicloom.llm import (
    decontaminate,
    embedding_pairs,
    licenses,
    mixing,
    ngram_jaccard,
    ngram_lm,
    quality,
    substrings,
    token_shards,
    warc,
)
from topicloom.llm.graph import components
from topicloom.session import RunFolder

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text, pattern, lower=True):
    raw = (text or "").encode()
    return pattern.findall(raw.translate(LOWER) if lower else raw)


def make_texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"W{i}" if i % 7 else f"é{i}" for i in range(400)]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = draw(120), draw(50)
    near = base.split()
    near[60] = "changed"
    texts = [draw(int(n)) for n in rng.integers(1, 150, 30)]
    texts += [base, base, base.upper(), " ".join(near), base + " and more"]
    texts += [f"{draw(40)} {passage} {draw(30)}" for _ in range(3)]
    texts += [None, "", " \t\n", "one", "one", "a\x1fb c", "This is Released under the MIT License. mit license, MIT-License"]
    texts += ["cc by cc by", "x " * 3000, draw(20_000)]
    return texts


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(make_texts())] + [
        (None, "one", None, None, None)
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def union_find(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (5, 5)], "a bigint, b bigint")
    got = {r.id: r.label for r in components(edges, RunFolder(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}


def test_language_model(docs, rows):
    counts, n = Counter(), {}
    for i, t, *_ in rows:
        tokens = words(t, SPACED) + [b""]
        n[i] = tokens
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens)
    total, distinct = sum(counts.values()), len(counts)
    found = by_id(ngram_lm.train_and_score(docs))
    assert set(found) == set(n)
    for i, tokens in n.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_language_model_keeps_every_ngram(spark):
    """Scores of a brute-force model at the defaults, on enough tokens that a frequency floor would cut."""
    rng = np.random.default_rng(9)
    rare = [(i, " ".join(f"r{j}" for j in rng.integers(0, 60, int(n)))) for i, n in enumerate(rng.integers(0, 40, 120))]
    rare += [(500, None), (501, ""), (None, "r1 r2 r3"), (3, "r1 r2 r3"), (3, "r1 r2 r3")]
    filler = [(1000 + i, "f1 f2 f3 f4 f5 f6 f7 f8 f9 f0 " * 5000) for i in range(140)]
    counts, texts = [Counter(), Counter(), Counter()], [(i, [b"", *words(t, SPACED), b""]) for i, t in rare + filler]
    for i, w in texts:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for n, c in enumerate(counts):
                c.update(zip(*(w[k:] for k in range(n + 1))) if n else w[1:])
    one, two, three = counts
    total = sum(one.values())
    assert total > 4_000_000  # half of a millionth of it is more than two occurrences

    def score(w):
        out = 0.0
        for k in range(1, len(w)):
            p = (one[w[k]] + 0.1) / (total + 0.1 * (len(one) + 1))
            p = (two[tuple(w[k - 1 : k + 1])] + 20 * p) / (one[w[k - 1]] + 20)
            if k > 1:
                p = (three[tuple(w[k - 2 : k + 1])] + 20 * p) / (two[tuple(w[k - 2 : k])] + 20)
            out += math.log10(p)
        return round(out, 6)

    docs = spark.createDataFrame(rare + filler, "doc_id bigint, text string").repartition(5)
    found = sorted(((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in ngram_lm.train_and_score(docs).collect()))
    expected = sorted((i or -1, len(w) - 1, score(w)) for i, w in texts)
    assert [x[:2] for x in found] == [x[:2] for x in expected]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in expected], rel=1e-6, abs=1e-5)


def test_stored_language_model_scores_other_texts(spark, docs, tmp_path):
    """The model read from its folder gives what training gave, and scores texts it has not seen."""
    folder = str(tmp_path / "model")
    learnt = sorted(map(str, ngram_lm.train_and_score(docs, folder=folder).collect()))
    model = ngram_lm.NgramModel(spark, folder)
    assert model.error() == 0
    assert sorted(map(str, model.score(docs).collect())) == learnt
    other = spark.createDataFrame([(1, "never seen here"), (2, None), (None, "words"), (2, None)], "doc_id bigint, text string")
    found = sorted((r.doc_id or -1, r.n_tokens, r.score < 0) for r in model.score(other).collect())
    assert found == [(-1, 2, True), (1, 4, True), (2, 1, True), (2, 1, True)]
    assert ngram_lm.train(docs, fold=7).score(other.limit(0)).count() == 0
    empty = ngram_lm.train(docs.limit(0)).score(other)
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score for r in empty.collect())


def test_quantised_values():
    """Few values are kept as they are; with more, neighbours share a code within the stated error."""
    rng = np.random.default_rng(5)
    values = 10 ** -rng.uniform(0, 11, 20_000)
    book, code, error = ngram_lm.quantise(values)
    assert error == 0 and (book[code] == values).all()
    book, code, error = ngram_lm.quantise(values, 1000)
    off = np.abs(np.log10(book[code]) - np.log10(values)).max()
    assert len(book) == 1000 and 0 < off <= error * (1 + 1e-9) < 0.05


def test_trie_is_a_distribution():
    """For every context the probabilities of all words and one unseen word add up to 1."""
    hashes = np.array([50, 20, 40, 10], np.uint64)
    counts = np.array([9, 7, 5, 3])
    pairs = (np.array([0, 0, 1, 3]), np.array([1, 2, 0, 3]), np.array([4, 3, 6, 2]))
    triples = (np.array([0, 0, 2]), np.array([0, 3, 1]), np.array([2, 1, 5]))
    trie = ngram_lm.Trie(ngram_lm.Trie.build(hashes, counts, [pairs, triples], 2.0))
    assert trie.words(hashes).tolist() == [0, 1, 2, 3] and trie.words(np.array([7], np.uint64)).tolist() == [-1]
    base = np.array([9.1, 7.1, 5.1, 3.1, 0.1]) / 24.5
    w = np.array([0, 1, 2, 3, -1])
    for u in range(-1, 4):
        for v in range(-1, 4):
            node, two, left2 = trie.child(0, np.full(5, v), w)
            context = trie.child(0, np.array([u]), np.array([v]))[0]
            _, three, left3 = trie.child(1, np.repeat(context, 5), w)
            assert (three + left3 * (two + left2 * base)).sum() == pytest.approx(1, abs=1e-6)


def test_elias_fano():
    values = np.sort(np.random.default_rng(1).integers(0, 100_000, 5000))
    coded = ngram_lm.EliasFano(*ngram_lm.EliasFano.encode(values))
    assert (coded[np.arange(5000)] == values).all()
    ask = np.arange(0, 100_000, 37)
    found = coded.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), 5000))
    assert (found == np.searchsorted(values, ask)).all()


def shingles(text):
    w = words(text, SPACED)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_jaccard(docs, rows):
    kept = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    edges = [
        (a, b)
        for a, x in kept
        for b, y in kept
        if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    label = union_find(len(kept), edges)
    found = by_id(ngram_jaccard.shingle_components(docs))
    assert found[None].component_id is None
    for i, s in kept:
        assert (found[i].n_shingles, found[i].component_id) == (len(s), label[i])
    assert edges


def test_jaccard_in_cut_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 8)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        for at in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            t[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(t))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [shingles(t) for t in texts]
    edges = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = by_id(ngram_jaccard.shingle_components(frame))
    assert [found[i].component_id for i in range(60)] == union_find(60, edges)


def test_substrings(docs, rows):
    texts = [(i, words(t, SPACED, False)) for i, t, *_ in rows]
    count = Counter(tuple(w[j : j + 35]) for _, w in texts for j in range(len(w) - 34))
    found = by_id(substrings.remove_repeats(docs))
    for i, w in texts:
        gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        r = found[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(left).hexdigest())


def test_repeats_in_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(frame).collect()) == [(1, 40), (1, 40), (2, 0)]


def test_warc(spark):
    pages = [(1, "u", "<p>a</p>"), (2, "u\r\n", "<p>a</p>"), (3, None, None), (4, "v", ""), (None, "w", "é\x00"), (5, "z", "x" * 200_000)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r.page_id: r for r in warc.round_trip(frame).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert {i: (found[i].payload_bytes, found[i].payload_digest) for i, _, _ in pages} == {
        i: (len((t or "").encode()), sha(t)) for i, _, t in pages
    }
    assert {i: (found[i].record_type, found[i].refers_to) for i, _, _ in pages} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("response", None), 5: ("response", None),
    }
    files = warc.write_archive(frame, RunFolder(spark, "t"))
    some = warc.read_archive(spark, files).where("page_id = 5 AND record_type = 'response'")
    assert [(r.page_id, len(r.payload)) for r in some.collect()] == [(5, 200_000)]
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_tokens(docs, rows):
    found = token_shards.write_shards(docs, length=16, shard=64).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    encoder = token_shards._encoder(token_shards.VOCABULARY)
    texts = {}
    for r in sorted(found, key=lambda r: r.part):
        texts.setdefault(r.doc_id, []).extend(np.frombuffer(r.token_ids, np.uint16).tolist())
        assert r.offset == (r.slot % 64) * token_shards.stride(16) and r.shard == r.slot // 64
    assert texts == {i: encoder.encode_ordinary(t or "") for i, t, *_ in rows}


def test_shards_are_taken_up_and_read_from_a_slot(spark, tmp_path):
    texts = [(None, "no id"), (-1, "below zero " * 40), (7, None), (7, ""), (8, "same row"), (8, "same row"), (9, "a b c " * 900)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id bigint, text string, slot int, data string")
    options = dict(length=8, shard=32, folder=str(tmp_path / "run"))
    layout = token_shards.build_shards(docs, **options)
    order = lambda frame: [tuple(r) for r in frame.orderBy("slot").collect()]
    whole = order(token_shards.read_slots(spark, layout))
    assert len(whole) == layout.count and [r[0] for r in whole] == list(range(layout.count))
    assert {r[3] for r in whole} == {None, -1, 7, 8, 9} and sum(r[3] == 8 for r in whole) == 2
    for start, stop in ((0, 5), (31, 33), (40, None), (layout.count - 1, None), (layout.count, None)):
        assert order(token_shards.read_slots(spark, layout, start, stop)) == whole[start:stop]
    # a run that stopped: one file lacks its end, one is gone, the token table is still there
    again = dict(options, folder=str(tmp_path / "second"))
    first = token_shards.build_shards(docs, **again | {"folder": str(tmp_path / "third")})
    drop, token_shards.RunFolder.drop = token_shards.RunFolder.drop, lambda *_: None
    try:
        second = token_shards.build_shards(docs, **again)
    finally:
        token_shards.RunFolder.drop = drop
    files = sorted((tmp_path / "second" / "binary").glob("shard-*.bin"))
    kept = files[2].stat().st_mtime_ns
    files[0].write_bytes(files[0].read_bytes()[:-5])
    files[1].unlink()
    assert token_shards.standing(spark, second).tolist() == [False, False] + [True] * (second.files - 2)
    assert token_shards.build_shards(docs, **again) == second
    assert order(token_shards.read_slots(spark, second)) == order(token_shards.read_slots(spark, first))
    assert files[2].stat().st_mtime_ns == kept and not (tmp_path / "second" / "tokens").exists()
    with pytest.raises(ValueError, match="another layout"):
        token_shards.build_shards(docs, **again | {"length": 9})


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000])
def test_feistel(count):
    slots = token_shards.feistel(np.arange(count), count, 9)
    assert sorted(slots.tolist()) == list(range(count))
    assert token_shards.feistel(slots, count, 9, inverse=True).tolist() == list(range(count))


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_pairs, "CHUNK", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8))
    x[100:] = x[rng.integers(0, 20, 50)] + rng.normal(size=(50, 8)) * 0.25
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(150, None), (151, [0.0] * 8), (152, [1.0, None] * 4), (153, [float("nan")] * 8), (154, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    found = {r.vec_id: r for r in embedding_pairs.vector_links(frame).collect()}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    label = union_find(150, list(zip(*np.nonzero(links))))
    assert [(found[i].n_links, found[i].component_id) for i in range(150)] == list(zip(links.sum(1).tolist(), label))
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i, _ in odd)


def clustered(rng, centres, each, size, noise):
    x = np.repeat(rng.normal(size=(centres, size)), each, axis=0)
    return (x + rng.normal(size=x.shape) * noise).astype(np.float32).astype(float)


def brute_links(x, cosine=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= cosine
    np.fill_diagonal(links, False)
    return links


@pytest.mark.parametrize("noise", [0.01, 0.1, 0.35])
def test_dual_traversal_prunes_and_stays_exact(noise):
    """Clusters that are tight, at the threshold and loose; a tree with itself and with another."""
    x = clustered(np.random.default_rng(4), 60, 30, 16, noise)
    links = brute_links(x)
    build = lambda rows: embedding_pairs.CoverTree.build(embedding_pairs._units(rows))
    whole = build(x)
    for radius_level in whole.levels[:-1]:
        assert radius_level[0][-1] == len(x) and (np.diff(radius_level[0]) > 0).all()
    one = np.ones(len(x), np.int64)
    found = embedding_pairs._Links(whole, whole, one, one)
    looked = embedding_pairs.dual_traversal(whole, whole, 0.9, found)
    assert (found.degree == links.sum(1)[whole.order]).all()
    assert noise > 0.1 or looked < len(x) ** 2 / 8
    order = whole.order[found.label]
    label = np.array(union_find(len(x), list(zip(*np.nonzero(links)))))
    assert (label[whole.order] == label[order]).all() and len(set(found.label.tolist())) == len(set(label.tolist()))
    a, b = build(x[::2]), build(x[1::2])
    half = np.ones(len(x) // 2, np.int64)
    found = embedding_pairs._Links(a, b, half, 3 * half)
    embedding_pairs.dual_traversal(a, b, 0.9, found)
    across = links[::2, 1::2]
    assert (found.degree == np.r_[3 * across.sum(1)[a.order], across.sum(0)[b.order]]).all()


def test_embeddings_at_cell_borders(spark, monkeypatch):
    """Many cells and parts, repeated vectors and ids, other lengths, a pair exactly at the threshold."""
    monkeypatch.setattr(embedding_pairs, "CHUNK", 25)
    rng = np.random.default_rng(8)
    x = np.concatenate([clustered(rng, 12, 20, 6, 0.3), clustered(rng, 1, 60, 6, 0.02)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (7, rows[100][1])]
    rows += [(2000 + i, v.tolist()) for i, v in enumerate(clustered(rng, 3, 10, 4, 0.1))]
    # powers of two: parallel vectors are equal in direction without rounding
    rows += [(3000, [3.0, 4.0]), (3001, [24.0, 32.0]), (3002, [-3.0, -4.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    edges, degree = [], [0] * len(rows)
    for size in (6, 4, 2):
        at = [i for i, r in enumerate(rows) if len(r[1]) == size]
        for i, j in zip(*np.nonzero(brute_links(np.array([rows[i][1] for i in at])))):
            edges.append((at[i], at[j]))
            degree[at[i]] += 1
    label = union_find(len(rows), edges)
    least = {}
    for (vec_id, _), c in zip(rows, label):
        least[c] = min(vec_id, least.get(c, vec_id))
    expected = sorted((r[0], n, least[c]) for r, n, c in zip(rows, degree, label))
    found = embedding_pairs.vector_links(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == expected


def test_decontamination(spark, docs, rows):
    long = words(rows[5][1] or "", PLAIN)
    items = [(1, rows[31][1]), (2, "one"), (3, None), (4, ""), (5, " ".join(w.decode() for w in long[:9])), (6, "MIT license"), (7, rows[35][1])]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, t in items:
        w = words(t, PLAIN)
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(str(i))
    for slice_words in (1, 10_000):
        found = by_id(decontaminate.contamination(docs, frame, slice_words=slice_words))
        for i, t, *_ in rows:
            w, hit, names = words(t, PLAIN), set(), set()
            for size in {len(k) for k in windows}:
                for j in range(len(w) - size + 1):
                    if (got := windows.get(tuple(w[j : j + size]))) is not None:
                        hit |= set(range(j, j + size))
                        names |= got
            r = found[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_items_without_id_are_matched(spark):
    leak = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(None, leak), (None, "p1 p2"), (3, leak), (None, None)], "item_id bigint, text string")
    texts = spark.createDataFrame([(1, f"a {leak} b c"), (2, "x p1 p2 y z"), (3, "clean")], "doc_id bigint, text string")
    found = by_id(decontaminate.contamination(texts, items))
    assert [(found[i].n_hit, found[i].n_items, found[i].contaminated) for i in (1, 2, 3)] == [(12, 1, True), (2, 0, True), (0, 0, False)]
    assert found[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert "p1" not in by_id(decontaminate.remove_spans(texts, items))[2].text


def test_spans_removed(spark):
    docs = spark.createDataFrame([(1, "keep this, A b c! and that"), (2, "a b c"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()} == {1: "keep this, ! and that", 3: None}


def test_quality(spark):
    good = [(i, f"The calm text number {i} goes on in plain words.") for i in range(200)]
    bad = [(i + 200, f"BUY!! NOW!! {i} $$$ %%%") for i in range(200)]
    docs = spark.createDataFrame(good + bad + [(400, None), (401, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(1, None)], "doc_id bigint, quality int")
    weights = quality.train(docs, labels, bits=14)
    found = by_id(quality.score(docs, weights))
    assert len(found) == 402 and all(0 <= r.score <= 1 for r in found.values())
    held = [i for i in range(400) if found[i].held_out]
    assert held and all(found[i].predicted == (i < 200) for i in held)
    assert quality.keep_good(docs.where("doc_id < 400"), weights).count() == 200


def test_mixing(docs, rows):
    found = mixing.mix(docs)
    got = found.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t, SPACED))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in order}
        more = {s for s in order if target[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(target[r.source])) and 0 <= r.taken <= 3 * r.size
    assert mixing.take(docs, found).count() == sum(r.copies for r in got)


def test_mixing_comes_near(spark):
    frame = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 97 AS int)) AS text", "IF(id % 3 = 0, 'b', 'a') AS source")
    rows = mixing.mix(frame).collect()
    for s in "ab":
        taken, target = sum(r.taken for r in rows if r.source == s), next(r.target for r in rows if r.source == s)
        assert abs(taken - target) < 0.02 * target


def test_licenses(docs, rows):
    found = by_id(licenses.scan(docs))
    for i, t, *_ in rows:
        w = words(t, PLAIN)
        places, names = [], set()
        for phrase, label in licenses.PHRASES:
            p = [x.encode() for x in phrase.split()]
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += at
            names |= {label} if at else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(names)) and names <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert "mit-release" in next(r.labels for r in found.values() if r.base_labels == "mit")


def test_pipeline_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(4)
    draw = lambda: " ".join(f"w{i}" for i in rng.integers(0, 5000, 60))
    a, b, c, d, e = (draw() for _ in range(5))
    rows = [
        (1, a), (2, a + " more"), (None, a),  # a null id goes if the group has another
        (None, b), (None, b), (None, b + " more"),  # without any id one row stays
        (4, c), (4, c),  # repeated rows
        (2, d),  # the id of a copy on a clean text
        (7, e), (5, e), (None, ""), (None, None), (9, ""),  # without words: linked with nothing
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.one_per_group(spark, docs, "")
    assert out.schema == docs.schema
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert sum(got.pop((None, t), 0) for t in (b, b + " more")) == 1
    assert got == Counter([(1, a), (4, c), (2, d), (5, e), (None, ""), (None, None), (9, "")])


def test_standard_license_passages(spark):
    gpl = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or later"
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including",
        "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "gpl-3.0": gpl.format("", "3"),
        "gpl-2.0": gpl.format("", "2"),
        "lgpl-3.0": gpl.format("Lesser ", "3"),
        "lgpl-2.1": gpl.format("Lesser ", "2.1"),
        "agpl-3.0": gpl.format("Affero ", "3"),
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc0-1.0": "The author has waived all copyright and related or neighboring rights to this work.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "": "a permission to deal with software and the public domain, no license",
    }
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    found = by_id(licenses.scan(frame))
    for i, label in enumerate(texts):
        assert set(found[i].labels.split(",")) - set(found[i].base_labels.split(",")) - {label} == set()
        assert label in found[i].labels.split(",")


@pytest.mark.parametrize(
    "operator",
    [
        ngram_lm.train_and_score,
        ngram_jaccard.shingle_components,
        substrings.remove_repeats,
        mixing.mix,
        licenses.scan,
        token_shards.write_shards,
    ],
)
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_empty_vectors(spark):
    assert embedding_pairs.vector_links(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0

"""Common shingles, and what else grew faster than the input or was held at once."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from topicloom.llm import ngram_jaccard, token_shards
from topicloom.session import RunFolder


def texts_with_a_common_line(rng, n):
    """Unlike texts of a few lines that all of them hold, every tenth a near copy of the one before."""
    lines = " ".join(f"c{i}" for i in range(30))
    out = []
    for i in range(n):
        own = [f"w{rng.integers(1 << 40)}" for _ in range(60)]
        if i % 10 == 9:
            own = out[-1].split()[30:]
            own[-1] = "other"
        out.append(f"{lines} {' '.join(own)}")
    return out


def largest_tile(spark, monkeypatch, texts):
    tables, write = {}, RunFolder.write

    def noted(self, df, name, partition_by=None):
        tables[name] = write(self, df, name, partition_by)
        return tables[name]

    with monkeypatch.context() as m:
        m.setattr(RunFolder, "write", noted)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        found = {r.doc_id: r.component_id for r in ngram_jaccard.shingle_components(frame).collect()}
    return found, max(r["count"] for r in tables["tiles"].groupBy("h").count().collect())


def test_a_line_of_all_texts_fills_no_tile(spark, monkeypatch):
    texts = texts_with_a_common_line(np.random.default_rng(6), 200)
    monkeypatch.setattr(ngram_jaccard, "ESTIMATED", 1)
    found, most = largest_tile(spark, monkeypatch, texts)
    assert found == {i: i - (i % 10 == 9) for i in range(200)}
    assert most < 20


def test_the_order_of_shingles_changes_no_link(spark, monkeypatch):
    texts = texts_with_a_common_line(np.random.default_rng(8), 60)
    # short texts hold nothing but common shingles
    texts += [" ".join(f"c{i}" for i in range(a, 30)) for a in (0, 0, 1, 9)]
    results = []
    for estimated, often, common in ((1 << 30, 4, 1 << 20), (1, 1, 1 << 20), (1, 4, 4)):
        for name, value in (("ESTIMATED", estimated), ("OFTEN", often), ("COMMON", common)):
            monkeypatch.setattr(ngram_jaccard, name, value)
        found, most = largest_tile(spark, monkeypatch, texts)
        # by hash alone the common line fills tiles
        assert estimated == 1 or most > 50
        results.append(found)
    assert all(r == results[0] for r in results)
    assert results[0][62] == results[0][61] == 60 and results[0][63] == 63


def test_first_of_a_set_are_its_rarest():
    order = ngram_jaccard._Order(np.array([5, 1 << 63], np.uint64), np.array([3, 1], np.uint8))
    sets = [np.array([2, 5, 9, 1 << 63], np.uint64), np.array([5, 8], np.uint64), np.zeros(0, np.uint64)]
    assert [x.tolist() for x in order.first(sets, [3, 1, 0])] == [[2, 9, 1 << 63], [8], []]
    none = ngram_jaccard._Order(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    assert [x.tolist() for x in none.first(sets, [2, 1, 0])] == [[2, 5], [5], []]


def test_distinct_pieces_are_encoded_in_one_call(monkeypatch):
    words = [f"w{i}" for i in range(300)] + ["it's", "3,14", "(a)", "end.\n\nNew", "x  y", "été", "\tq"]
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    texts += ["", None, " ", "a", " a", "a ", "  b", "b\n", " \n c d ", "'s 's", " a b c d", "é f g", "z" * 3000]
    encoder, calls = token_shards._encoder(token_shards.VOCABULARY), []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return encoder.encode_ordinary(text)

    token_shards._widths(token_shards.VOCABULARY)
    monkeypatch.setattr(token_shards, "_encoder", lambda path: Counted())
    ids, starts = token_shards.encode(pa.array(texts), token_shards.VOCABULARY)
    found = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
    assert found == [encoder.encode_ordinary(t or "") for t in texts]
    # ends of texts by themselves, whatever lies inside together
    assert len(calls) < 3 * len(texts)


def test_stages_send_few_texts_at_once(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    before = spark.conf.get(key)
    try:
        for given, after in (("64m", 4 << 20), ("2m", None)):
            spark.conf.set(key, given)
            corpus_pipeline.token_sequences(spark, docs, "")
            assert spark.conf.get(key) == (given if after is None else str(after))
    finally:
        spark.conf.set(key, before)

"""Columns that clash with helpers, repeated rows, empty tables, repetitive texts, word order, cut archives."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import decontaminate, embedding_pairs, filter_audit, licenses, mixing, ngram_jaccard, ngram_lm, periodic_runs, quality, substrings, token_shards, warc
from topicloom.session import RunFolder

# names that operators use inside
CLASHING = ("place", "copies", "row", "row_key", "id", "no_id", "hash", "_text", "_id", "_w", "_n", "_v", "held", "task", "slot", "shard", "data", "label", "x", "n", "score", "rep", "band", "unit", "words", "h", "d", "block")


@pytest.fixture(scope="module")
def plain(spark):
    text = F.expr("concat('word', id % 7, ' and ', repeat('some more words follow ', cast(1 + id % 5 AS int)), 'under the MIT License ', id)")
    rows = spark.range(40).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return rows.unionByName(rows.where("doc_id < 3"))  # repeated rows


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


OPERATORS = [
    ngram_lm.train_and_score, ngram_jaccard.shingle_components, substrings.remove_repeats, mixing.mix, licenses.scan,
    token_shards.write_shards, periodic_runs.run_digest,
]


@pytest.mark.parametrize("operator", OPERATORS)
def test_clashing_columns_change_nothing(plain, clashing, operator):
    found = operator(plain)
    assert found.count() >= plain.count() and same(found, operator(clashing))


def test_clashing_columns_beside_a_second_table(spark, plain, clashing):
    items = spark.createDataFrame([(1, "words follow some more words follow some more words follow", "x")], "item_id bigint, text string, words string")
    labels = plain.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"), F.lit(1).alias("x")).distinct()
    assert same(decontaminate.contamination(plain, items), decontaminate.contamination(clashing, items))
    assert same(filter_audit.audit(plain, labels), filter_audit.audit(clashing, labels))
    weights = quality.train(plain, labels, bits=12)
    assert (weights == quality.train(clashing, labels, bits=12)).all()
    assert same(quality.score(plain, weights), quality.score(clashing, weights))
    cleaned = decontaminate.remove_spans(clashing, items)
    assert cleaned.columns == clashing.columns and cleaned.select("words").distinct().first()[0] == "own words"


def test_mix_takes_rows_with_clashing_columns(clashing):
    mixed = mixing.mix(clashing)
    taken = mixing.take(clashing, mixed)
    assert taken.columns == clashing.columns and taken.count() == mixed.agg(F.sum("copies")).first()[0]
    assert taken.select(*CLASHING).distinct().collect() == clashing.select(*CLASHING).distinct().collect()


def test_one_row_of_a_group_with_clashing_columns(spark, plain, clashing):
    kept = corpus_pipeline.one_per_group(spark, clashing, "")
    assert kept.columns == clashing.columns and same(corpus_pipeline.one_per_group(spark, plain, ""), kept)
    assert kept.groupBy("doc_id").count().where("count > 1").isEmpty()


def test_stages_of_empty_tables(spark, plain, tmp_path):
    plain.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_whole_pipeline(spark, tmp_path):
    """Each stage by its own brute force: good rows, one of each group, no benchmark words, whole copies, every token."""
    leak = " ".join(f"q{i}" for i in range(12))
    calm = [(i, " ".join(f"calm{i}x{j}" for j in range(30)) + " goes on in plain words.", "a" if i % 2 else "b") for i in range(60)]
    copies = [(100 + i, calm[i][1], "a") for i in range(10)]
    leaking = [(200, calm[0][1].replace("calm0x5", f"calm0x5 {leak}", 1).replace("calm0", "other"), "a")]
    noisy = [(300 + i, f"BUY!! NOW!! {i} $$$ %%% " * 3, "b") for i in range(60)]
    rows = [(i, t, "en", s, len(t)) for i, t, s in calm + copies + leaking + noisy]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i, *_ in calm] + [(i, 0, 0) for i, *_ in noisy]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = RunFolder(spark, "stage").write(stage(spark, docs, str(tmp_path)), "rows")
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    assert set(seen[0]) == {i for i, *_ in calm + copies + leaking}
    assert set(seen[1]) == {i for i, *_ in calm + leaking}
    assert not any("q3" in t.split() for t in seen[2].values()) and set(seen[2]) >= {i for i, *_ in calm}
    assert all(seen[2][i] == t for i, t in seen[3].items())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = token_shards._encoder(token_shards.VOCABULARY)
    tokens = {r.doc_id: len(encoder.encode_ordinary(r.text)) for r in docs.collect()}
    times = docs.groupBy("doc_id").count().collect()
    assert sum(r.n_tokens for r in found) == sum(tokens[r.doc_id] * r["count"] for r in times)


def test_urls_come_back_as_they_were(spark):
    urls = ["http://x/a\\b", "http://x/%20?q=a b", "line\r\nbreak", " blank ", "%0D%0A", "", None, "é: ü"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    files = warc.write_archive(pages, RunFolder(spark, "urls"))
    assert {r.page_id: r.url for r in warc.read_archive(spark, files).collect()} == dict(enumerate(urls))
    for i, u in enumerate(urls[:-2]):
        assert [r.page_id for r in warc.read_archive(spark, files).where(F.col("url") == u).collect()] == [i]


def test_cut_archives_raise():
    data = warc.record({"page_id": 1, "url": "u", "record_type": "response", "payload_digest": "d"}, b"payload " * 4000)
    assert [r["page_id"] for r in warc.records(data, lambda r: True, True)] == [1]
    for end in (40, len(data) - 40):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.records(data[:end], lambda r: True, True))


def test_repetitive_texts_are_linear(spark):
    automaton = decontaminate.Automaton([("a", [1] * 20_000)], 10)
    begun = time.perf_counter()
    ranges, names = automaton.matches([1] * 20_000)
    assert len(ranges) == 19_991 and names == {"a"} and time.perf_counter() - begun < 1
    passage = "released under the mit license "
    docs = spark.createDataFrame([(1, passage * 9_600), (2, "x " * 9 + passage)], "doc_id bigint, text string")
    begun = time.perf_counter()
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert found[1].n_words == 48_000 and found[1].labels == found[2].labels == "mit,mit-release" and found[1].score == pytest.approx(1)
    assert time.perf_counter() - begun < 20


def test_quality_reads_word_order(spark):
    """The same words in two orders: only pairs and triples tell them apart."""
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(300):
        shift = i // 2 % 12
        order = words[shift:] + words[:shift]
        rows.append((i, " ".join(order if i % 2 else order[::-1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    found = quality.score(docs, quality.train(docs, labels, bits=14)).where("held_out").collect()
    assert len(found) > 30 and all(r.predicted == r.doc_id % 2 for r in found)

import pytest
from conftest import TINY, doc_ids, doc_terms
from pyspark.sql import functions as F

from topicloom import RunFolder, prepare_corpus, read_counts
from topicloom.operators.lookup import lookup_join
from topicloom.sources import corpus as source


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_count_lines_round_trip(spark, tmp_path):
    source.write_counts(doc_terms(spark, TINY), doc_ids(spark, 6), str(tmp_path / "counts"))
    back = read_counts(spark, str(tmp_path / "counts"), strict=False)
    assert rows(back, "doc_id", "term_id", "cnt") == sorted(TINY)
    problems = rows(source.check_pairs(source.parse_lines(source.read_lines(spark, str(tmp_path / "counts")))), "doc_id", "problem")
    assert problems == [(5, "empty_document")]


def test_document_ids_are_line_positions_across_splits(spark, tmp_path):
    """Several files and several splits per file, read back in file order."""
    folder = tmp_path / "many"
    folder.mkdir()
    lines = [f"1 {i}:{i % 9 + 1}" for i in range(4000)]
    for part in range(3):
        (folder / f"part-{part}.txt").write_text("\n".join(lines[part * 1000 : (part + 1) * 1000 if part < 2 else 4000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert source.read_lines(spark, str(folder)).rdd.getNumPartitions() > 0
        got = rows(read_counts(spark, str(folder)), "doc_id", "term_id", "cnt")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, i, i % 9 + 1) for i in range(4000)]


def test_every_broken_rule_is_reported(spark):
    lines = spark.createDataFrame(
        [(0, "2 1:3 4:1"), (1, "2 1:3 1:1"), (2, "1 5:0"), (3, "1 -2:4"), (4, "3 1:1"), (5, "0"), (6, "1 x:2")],
        "doc_id bigint, line string",
    )
    pairs = source.parse_lines(lines)
    assert rows(source.check_pairs(pairs), "doc_id", "problem", "n") == [
        (1, "repeated_term", 2),
        (2, "count_not_positive", 1),
        (3, "negative_id", 1),
        (4, "declared_differs", 1),
        (5, "empty_document", 0),
        (6, "negative_id", 1),
    ]
    assert (1, 1, 4) in rows(source.sum_pairs(pairs), "doc_id", "term_id", "cnt")


def test_strict_read_raises(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("2 1:3 1:1\n")
    with pytest.raises(ValueError):
        read_counts(spark, str(path), strict=True)


def test_text_to_corpus(spark):
    docs = spark.createDataFrame([(0, "The cat. THE dog's 2 cats"), (1, "é cat"), (2, ""), (3, None)], "doc_id bigint, text string")
    pairs = source.corpus_from_text(docs)
    assert rows(pairs, "doc_id", "term", "cnt") == [
        (0, "cat", 1), (0, "cats", 1), (0, "dog", 1), (0, "s", 1), (0, "the", 2), (1, "cat", 1), (1, "é", 1),
    ]
    vocab = source.vocabulary(pairs, RunFolder(spark, "test"))
    assert rows(vocab, "term_id", "term", "n") == [
        (0, "cat", 2), (1, "cats", 1), (2, "dog", 1), (3, "s", 1), (4, "the", 1), (5, "é", 1),
    ]
    assert rows(source.corpus_from_text(docs, min_df=2), "doc_id", "term", "cnt") == [(0, "cat", 1), (1, "cat", 1)]
    stats = source.doc_stats(source.encode_terms(pairs, vocab), docs)
    assert rows(stats, "doc_id", "num_words", "num_unique") == [(0, 6, 5), (1, 2, 2), (2, 0, 0), (3, 0, 0)]


def test_few_files_are_spread_and_many_are_left_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i)}") for i in range(8)], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    docs.repartition(6, "doc_id").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "many"))
    assert rows(source.spread_few_files(one), "doc_id") == rows(docs, "doc_id")
    assert source.spread_few_files(many) is many


def test_lookup_join_is_exact_when_one_key_is_hot(spark):
    facts = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("key"), "id")
    dim = spark.range(60).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    sizes = facts.groupBy("key").agg(F.count("*").alias("n"))
    joined = lookup_join(facts, dim, "key", "id", sizes)
    assert joined.count() == 3000
    assert joined.where("value <> key * 10").count() == 0


def test_blocks_hold_every_pair_once(spark):
    big = [(0, t, 1 + t % 3) for t in range(400)] + [(d, d, 2) for d in range(1, 60)]
    corpus = prepare_corpus(doc_terms(spark, big), doc_ids(spark, 61), block_pairs=40)
    assert rows(corpus.doc_terms, "doc_id", "term_id", "cnt") == sorted(big)
    assert corpus.tokens.where("doc_id = 0").select("block").distinct().count() > 3
    sizes = [r["count"] for r in corpus.tokens.groupBy("block").count().collect()]
    assert max(sizes) < 160
    assert (corpus.num_docs, corpus.seen_terms, corpus.vocab_size) == (61, 400, 400)
    with pytest.raises(ValueError):
        prepare_corpus(doc_terms(spark, big), vocab_size=10)


def test_any_white_space_and_bad_pairs(spark, tmp_path):
    (tmp_path / "w").write_text("2\t1:2 \t3:4\n0\n1 5:1 5:2\n")
    got = sorted(tuple(r) for r in source.read_counts(spark, str(tmp_path / "w")).collect())
    assert got == [(0, 1, 2), (0, 3, 4), (2, 5, 3)]
    (tmp_path / "x").write_text("1 1:x\n")
    with pytest.raises(Exception, match="not term:count"):
        source.read_counts(spark, str(tmp_path / "x")).collect()


def test_repeats_and_empty_corpora(spark):
    from topicloom import prepare_corpus
    from topicloom.operators.kmeans import fit_kmeans

    twice = spark.createDataFrame([(0, 0, 3), (0, 0, 3), (0, 1, 2), (1, 2, 1)], "doc_id bigint, term_id bigint, cnt bigint")
    corpus = prepare_corpus(twice)
    assert (corpus.num_pairs, corpus.num_words) == (3, 9)
    first, _ = fit_kmeans(corpus, 2)
    fit_kmeans(corpus, 2, seed=1)
    assert first.count() == 3
    assert prepare_corpus(twice.limit(0), spark.range(3).withColumnRenamed("id", "doc_id")).num_docs == 3
    with pytest.raises(Exception, match="negative"):
        prepare_corpus(twice.selectExpr("doc_id", "term_id", "-cnt AS cnt"))


def test_pairs_that_do_not_repeat_move_once(spark):
    docs = spark.createDataFrame([(0, "cat dog cat"), (1, "dog"), (0, "Cat é")], "doc_id bigint, text string")
    pairs = source.corpus_from_text(docs)
    assert rows(pairs, "doc_id", "term", "cnt") == [(0, "cat", 3), (0, "dog", 1), (0, "é", 1), (1, "dog", 1)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "hashpartitioning(doc_id#" in plan and "term#" not in plan.split("hashpartitioning")[1].split(")")[0]
    big = [(0, t, 1 + t % 3) for t in range(400)] + [(d, d, 2) for d in range(1, 60)]
    known = prepare_corpus(doc_terms(spark, big), doc_ids(spark, 61), block_pairs=40, unique=True)
    plain = prepare_corpus(doc_terms(spark, big), doc_ids(spark, 61), block_pairs=40)
    assert rows(known.tokens, "block", "doc_id", "term_id", "cnt") == rows(plain.tokens, "block", "doc_id", "term_id", "cnt")
    assert rows(known.needed, "block", "kind", "id") == rows(plain.needed, "block", "kind", "id")
    listed = {(r["block"], 0, r["doc_id"]) for r in known.tokens.collect()} | {(r["block"], 1, r["term_id"]) for r in known.tokens.collect()}
    assert set(rows(known.needed, "block", "kind", "id")) == listed
    with pytest.raises(Exception, match="negative"):
        prepare_corpus(doc_terms(spark, [(0, 1, -1)]), unique=True)


def test_partitions_grow_with_the_blocks(spark):
    pairs = doc_terms(spark, [(d, t, 1) for d in range(100) for t in range(10)])
    corpus = prepare_corpus(pairs, block_pairs=10)
    assert corpus.partitions == 25 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(tuple(r) for r in corpus.doc_terms.collect()) == sorted(tuple(r) for r in pairs.collect())
    corpus.release()


def test_unreadable_pairs_are_set_aside(spark, tmp_path):
    (tmp_path / "f").write_text("2 1:2 x:4\n1 5\n0\n3 1:1 2:z 7:3\n")
    pairs, rejects = source.read_counts_and_rejects(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, pairs.collect())) == [(0, 1, 2), (3, 1, 1), (3, 7, 3)]
    assert sorted(map(tuple, rejects.collect())) == [(0, 1, "x:4"), (1, 0, "5"), (3, 1, "2:z")]


def test_line_positions_need_no_window_over_all_splits(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}").write_text("".join(f"1 {i}:{j + 1}\n" for j in range(30)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = source.read_lines(spark, str(tmp_path))
        got = [r["line"] for r in lines.orderBy("doc_id").collect()]
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"1 {i}:{j + 1}" for i in range(5) for j in range(30)]
    windows = [row for row in plan.splitlines() if "Window [" in row]
    assert windows and all("[_part#" in row for row in windows)


def test_words_are_counted_inside_their_row(spark):
    """No table of words is shuffled or aggregated; ids on several rows, null ids and null texts still count."""
    once = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "Ä1ä z")], "doc_id bigint, text string")
    found = source.corpus_from_text(once)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 1), (1, "b", 2), (4, "z", 1), (4, "ä", 2)]
    again = once.unionAll(spark.createDataFrame([(1, "b c"), (None, "x y"), (None, "x")], once.schema))
    rows = {(r["doc_id"], r["term"]): r["cnt"] for r in source.corpus_from_text(again).collect()}
    assert rows == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (4, "z"): 1, (4, "ä"): 2, (None, "x"): 2, (None, "y"): 1}


def test_encoding_does_not_sort_the_pairs(spark):
    pairs = spark.range(2000).selectExpr("id AS doc_id", "concat('t', id % 7) AS term", "1L AS cnt")
    vocab = spark.range(7).selectExpr("concat('t', id) AS term", "id AS term_id", "286L AS n")
    joined = source.encode_terms(pairs, vocab)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert joined.count() == 2000 and joined.where("doc_id % 7 <> term_id").isEmpty()


def test_pairs_of_a_count_file_do_not_move(spark, tmp_path):
    """A document is one line: its repeated pairs are added up there. Only listed documents are written."""
    (tmp_path / "f").write_text("3 5:1 5:2 7:1 5:4\n0\n1 2:9\n")
    back = read_counts(spark, str(tmp_path / "f"))
    assert rows(back, "doc_id", "term_id", "cnt") == [(0, 5, 7), (0, 7, 1), (2, 2, 9)]
    assert "hashpartitioning(doc_id" not in back._jdf.queryExecution().executedPlan().toString()
    listed = spark.createDataFrame([(9,), (3,), (3,), (4,)], "doc_id bigint")
    source.write_counts(doc_terms(spark, [(3, 8, 1), (3, 2, 5), (7, 1, 1), (9, 0, 2)]), listed, str(tmp_path / "w"))
    lines = [r["line"] for r in source.read_lines(spark, str(tmp_path / "w")).orderBy("doc_id").collect()]
    assert lines == ["2 2:5 8:1", "2 2:5 8:1", "0", "1 0:2"]


def test_rules_about_documents_take_one_pass(spark):
    pairs = doc_terms(spark, [(0, 1, 2), (1, 4, 1)]).selectExpr("doc_id", "2L AS declared", "0L AS position", "term_id", "cnt")
    problems = source.check_pairs(pairs)
    assert problems._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [doc_id") == 2
    assert rows(problems, "doc_id", "problem", "n") == [(0, "declared_differs", 1), (1, "declared_differs", 1)]

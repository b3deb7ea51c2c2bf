"""Corpora as tables: reading count files, counting words in text, vocabulary, statistics, checks.

A corpus is ``doc_terms(doc_id BIGINT, term_id BIGINT, cnt BIGINT)`` with one row per document and term.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.operators.lookup import lookup_join
from topicloom.session import RunFolder, shuffle_partitions

# A word is a maximal run of Unicode letters, lower-cased; "term:count" pairs are
# written with one space between and read with any white space, after the declared number.
NOT_LETTERS = r"[^\p{L}]+"
PAIR_SEPARATOR = " "
WHITE_SPACE = r"\s+"
COUNT_SEPARATOR = ":"
UNREADABLE = "position IS NOT NULL AND (term_id IS NULL OR cnt IS NULL)"
# Pairs that a task should put in the order of their documents.
PAIRS_PER_TASK = 2_000_000


# --- count files -------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, line)`` of a count file or folder; the document id is the position of the line.

    The reader hands out file splits. Rows of one split are consecutive within one partition, so a line's
    position is the number of lines in earlier splits plus its place in its own split: one narrow counting
    job over the splits replaces a global ordering of the lines. The splits themselves are added up range by
    range of their order, so no task reads all of them.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("seen_as"),
    )
    splits = lines.groupBy("file", "split_start").agg(F.count("*").alias("n"), F.min("seen_as").alias("first_seen_as"))
    order = ["file", "split_start"]
    ordered = RunFolder(spark, "lines").write(splits.orderBy(*order).withColumn("_part", F.spark_partition_id()), "splits")
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("_start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    offsets = ordered.join(F.broadcast(_starts(ordered, "n")), "_part").select(*order, "first_seen_as", offset.alias("offset"))
    # a row for each file split, so it goes to the lines
    return lines.join(F.broadcast(offsets), order).select(
        (F.col("offset") + F.col("seen_as") - F.col("first_seen_as")).alias("doc_id"), "line"
    )


def _starts(ordered: DataFrame, size: str) -> DataFrame:
    """``(_part, _start)``: the sum of ``size`` over all partitions before each; one number of each meets the driver."""
    rows = ordered.groupBy("_part").agg(F.sum(size).alias("n")).collect()
    starts, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in rows):
        starts.append((part, total))
        total += n
    return ordered.sparkSession.createDataFrame(starts, "_part int, _start bigint")


def parse_lines(lines: DataFrame, id_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """Raw ``(doc_id, declared, position, term_id, cnt)``, one row per written pair, nothing repaired.

    A document without pairs yields one row with a null position.
    """
    return _written_pairs(lines, id_col, line_col).drop("pair")


def unreadable_pairs(lines: DataFrame, id_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """``(doc_id, position, pair)``: what stands where a pair should, but is not term:count."""
    return _written_pairs(lines, id_col, line_col).where(UNREADABLE).select("doc_id", "position", "pair")


def _written_pairs(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    pair = F.split(F.col("pair"), COUNT_SEPARATOR)
    return lines.select(
        F.col(id_col).alias("doc_id"),
        F.get(_fields(line_col), F.lit(0)).try_cast("bigint").alias("declared"),
        F.posexplode_outer(_fields_of_pairs(line_col)).alias("position", "pair"),
    ).select(
        "doc_id",
        "declared",
        F.col("position").cast("bigint").alias("position"),
        "pair",
        F.get(pair, F.lit(0)).try_cast("bigint").alias("term_id"),
        F.get(pair, F.lit(1)).try_cast("bigint").alias("cnt"),
    )


def _fields(line_col: str):
    return F.split(F.regexp_replace(F.col(line_col), r"^\s+|\s+$", ""), WHITE_SPACE)


def _fields_of_pairs(line_col: str):
    parts = _fields(line_col)
    return F.filter(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: p != "")


def read_counts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``doc_terms`` of a count file. Repeated pairs of a document are added up; a pair that cannot be read
    is an error when the result is computed.

    With ``strict`` the read fails when any line breaks a rule of the format. A document is one line, so its pairs are
    added up there and none of them moves.
    """
    lines = read_lines(spark, path)
    if strict and not check_pairs(parse_lines(lines)).isEmpty():
        raise ValueError(f"{path} breaks the count format; check_pairs() lists the rows")

    def pair_of(text):
        term, cnt = (F.get(F.split(text, COUNT_SEPARATOR), F.lit(i)).try_cast("bigint") for i in range(2))
        wrong = F.raise_error(F.lit("a pair is not term:count")).cast("bigint")
        return F.struct(term.alias("term_id"), F.when(term.isNull() | cnt.isNull(), wrong).otherwise(cnt).alias("cnt"))

    parsed = lines.select("doc_id", F.transform(_fields_of_pairs("line"), pair_of).alias("pairs"))
    repeats = F.size(F.array_distinct(F.col("pairs.term_id"))) < F.size("pairs")
    ordered = parsed.select("doc_id", F.when(repeats, F.array_sort("pairs")).otherwise(F.col("pairs")).alias("pairs"), repeats.alias("repeats"))
    at = lambda i: F.get("pairs", i)["term_id"]
    starts = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: (i == 1) | (at(i - 1) != at(i - 2)))
    marked = ordered.select("doc_id", "pairs", F.when(F.col("repeats"), starts).alias("starts"))

    def run_of(start, place):
        end = F.coalesce(F.get("starts", place + 1), F.size("pairs") + 1)
        total = F.aggregate(F.slice("pairs", start, end - start), F.lit(0).cast("bigint"), lambda s, x: s + x["cnt"])
        return F.struct(at(start - 1).alias("term_id"), total.alias("cnt"))

    summed = F.when(F.col("starts").isNotNull(), F.transform("starts", run_of)).otherwise(F.col("pairs"))
    return marked.select("doc_id", F.explode(summed).alias("x")).select("doc_id", "x.term_id", "x.cnt")


def read_counts_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``doc_terms`` of the pairs of a count file that can be read, and the others as ``(doc_id, position, pair)``."""
    lines = read_lines(spark, path)
    return sum_pairs(parse_lines(lines)), unreadable_pairs(lines)


def sum_pairs(pairs: DataFrame) -> DataFrame:
    """``doc_terms`` of the pairs that could be read; :func:`check_pairs` lists the others."""
    return (
        pairs.where(F.col("term_id").isNotNull() & F.col("cnt").isNotNull())
        .groupBy("doc_id", "term_id")
        .agg(F.sum("cnt").alias("cnt"))
    )


def write_counts(doc_terms: DataFrame, doc_ids: DataFrame, path: str) -> None:
    """Write a corpus as count lines in document order; documents without terms become a line ``0``.

    The format puts a whole document on one line, so here one task must hold a document's terms. Reading
    and everything else does not need that. Pairs move once, into ranges of documents; a row without a pair stands for
    each document of ``doc_ids``.
    """
    parts = max(shuffle_partitions(doc_terms.sparkSession), -(-doc_terms.count() // PAIRS_PER_TASK))
    pairs = doc_terms.where("doc_id IS NOT NULL").select("doc_id", F.struct("term_id", "cnt").alias("pair"))
    marks = doc_ids.select("doc_id", F.lit(None).cast(pairs.schema["pair"].dataType).alias("pair"))
    ranges = pairs.unionByName(marks).repartitionByRange(parts, "doc_id")
    lines = ranges.groupBy("doc_id").agg(
        F.count(F.when(F.col("pair").isNull(), 1)).alias("times"), F.array_sort(F.collect_list("pair")).alias("pairs")
    )
    text = F.transform("pairs", lambda x: F.concat_ws(COUNT_SEPARATOR, x["term_id"].cast("string"), x["cnt"].cast("string")))
    line = F.concat_ws(PAIR_SEPARATOR, F.size("pairs").cast("string"), text)
    (
        lines.sortWithinPartitions("doc_id")
        .select(F.explode(F.array_repeat(line, F.col("times").cast("int"))).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Every broken rule as ``(doc_id, term_id, problem, n)``; empty when the corpus is clean.

    ``pairs(doc_id, declared, position, term_id, cnt)`` is the output of :func:`parse_lines`. Rules: counts
    are positive, ids are not negative, a term occurs once per document, a document is not empty, and the
    declared number of pairs is the number written. ``n`` is the number of offending pairs, or the number
    of pairs written for the two rules about whole documents.
    """
    written = F.col("position").isNotNull()
    by_term = (
        pairs.where(written)
        .groupBy("doc_id", "term_id")
        .agg(
            F.count(F.when(F.coalesce(F.col("cnt"), F.lit(0)) <= 0, 1)).alias("bad_count"),
            F.count(F.when(F.coalesce(F.col("term_id"), F.lit(-1)) < 0, 1)).alias("bad_id"),
            F.count("*").alias("written"),
        )
        .select(
            "doc_id",
            "term_id",
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.lit("count_not_positive").alias("problem"), F.col("bad_count").alias("n")),
                        F.struct(F.lit("negative_id").alias("problem"), F.col("bad_id").alias("n")),
                        F.struct(
                            F.lit("repeated_term").alias("problem"),
                            F.when(F.col("written") > 1, F.col("written")).otherwise(0).alias("n"),
                        ),
                    ),
                    lambda x: x["n"] > 0,
                )
            ).alias("x"),
        )
        .select("doc_id", "term_id", "x.problem", "x.n")
    )
    by_doc = pairs.groupBy("doc_id").agg(
        F.count("position").alias("n"), F.max("declared").alias("declared")
    )
    # both rules about whole documents from one pass over the pairs
    broken = F.filter(
        F.array(
            F.struct(F.lit("empty_document").alias("problem"), F.expr("n = 0").alias("found")),
            F.struct(F.lit("declared_differs").alias("problem"), F.expr("declared IS DISTINCT FROM n").alias("found")),
        ),
        lambda x: x["found"],
    )
    by_doc = by_doc.select("doc_id", "n", F.explode(broken).alias("x"))
    return by_term.unionByName(by_doc.select("doc_id", F.lit(None).cast("bigint").alias("term_id"), "x.problem", "n"))


# --- text --------------------------------------------------------------------------------------------


def corpus_from_text(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 1
) -> DataFrame:
    """``(doc_id, term, cnt)`` of a text table; terms in fewer than ``min_df`` documents are left out.

    The words of a row are sorted and counted inside it, so nothing moves and no table of words is kept. Only where an
    id stands on several rows (looked up first) does the text move, once, by document, to add their counts up.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        pairs = _words_of_rows(spread_few_files(texts))
    else:
        pairs = _words_of_rows(texts.repartition("doc_id")).groupBy("doc_id", "term").agg(F.sum("cnt").alias("cnt"))
    if min_df <= 1:
        return pairs
    spread_of_term = pairs.groupBy("term").agg(F.count("*").alias("n"))
    kept = spread_of_term.where(F.col("n") >= min_df).select("term")
    return lookup_join(pairs, kept, "term", "doc_id", spread_of_term)


def _words_of_rows(texts: DataFrame) -> DataFrame:
    """``(doc_id, term, cnt)`` of every row ``(doc_id, text)`` by itself: runs of equal words in its sorted words."""
    words = texts.select("doc_id", F.sort_array(F.split(F.lower("text"), NOT_LETTERS)).alias("words"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("words")),
        lambda i: (F.get("words", i - 1) != "") & ((i == 1) | (F.get("words", i - 1) != F.get("words", i - 2))),
    )
    runs = words.select("doc_id", "words", starts.alias("starts"))
    # a run becomes its word and length before it becomes a row, so that no row carries the words of its text
    counted = F.transform(
        "starts",
        lambda start, at: F.struct(
            F.get("words", start - 1).alias("term"),
            (F.coalesce(F.get("starts", at + 1), F.size("words") + 1) - start).cast("bigint").alias("cnt"),
        ),
    )
    return runs.select("doc_id", F.explode(counted).alias("x")).select("doc_id", "x.term", "x.cnt")


def spread_few_files(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents`` over all cores when they sit in fewer files than there are cores.

    A table in many files is returned as it is: moving its text would be a shuffle for nothing.
    """
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if len(documents.inputFiles()) >= cores:
        return documents
    return documents.repartition(cores, id_col)


def vocabulary(pairs: DataFrame, run: RunFolder) -> DataFrame:
    """``(term, term_id, n)``: dense ids in byte order of the term, and the documents it occurs in."""
    terms = pairs.groupBy("term").agg(F.count("*").alias("n"))
    return dense_ids(terms, "term", "term_id", run)


def dense_ids(table: DataFrame, order_col: str, id_col: str, run: RunFolder) -> DataFrame:
    """Number the rows 0, 1, ... in the order of a unique column without a one-partition window.

    The table is range-partitioned, sorted and written with Spark's per-partition running ids; the ids
    become dense by subtracting each partition's start, which needs one row per partition.
    """
    ordered = run.write(
        table.orderBy(order_col).withColumn("_running", F.monotonically_increasing_id()), f"ordered_{order_col}-{uuid.uuid4().hex[:8]}"
    )
    numbered = ordered.withColumn("_part", F.shiftright("_running", 33).cast("int")).withColumn("_one", F.lit(1))
    return (
        numbered.join(F.broadcast(_starts(numbered, "_one")), "_part")
        .withColumn(id_col, F.col("_start") + F.col("_running").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_running", "_start", "_one")
    )


def encode_terms(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_terms`` of ``(doc_id, term, cnt)``. Pairs pass by a task's share of the vocabulary and are not sorted."""
    joined = lookup_join(pairs, vocab.select("term", "term_id"), "term", "doc_id", vocab.select("term", "n"), hashed=True)
    return joined.select("doc_id", "term_id", "cnt")


# --- statistics --------------------------------------------------------------------------------------


def doc_stats(doc_terms: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """``(doc_id, num_words, num_unique)``; with ``doc_ids`` documents without terms are kept as zeros."""
    stats = doc_terms.groupBy("doc_id").agg(F.sum("cnt").alias("num_words"), F.count("*").alias("num_unique"))
    if doc_ids is None:
        return stats
    return doc_ids.select("doc_id").join(stats, "doc_id", "left").na.fill(0, ["num_words", "num_unique"])


def corpus_stats(stats: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """One row ``(num_docs, num_words, vocab_size)``; the vocabulary runs to the largest id in use."""
    docs = stats.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum("num_words"), F.lit(0)).alias("num_words"))
    size = doc_terms.agg((F.coalesce(F.max("term_id"), F.lit(-1)) + 1).alias("vocab_size"))
    return docs.select("num_docs", "num_words", size.scalar().alias("vocab_size"))


def term_frequencies(doc_terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``(doc_id, term_id, freq)``: counts divided by the length of their document."""
    sizes = stats.select("doc_id", F.col("num_unique").alias("n"))
    joined = lookup_join(doc_terms, stats.select("doc_id", "num_words"), "doc_id", "term_id", sizes)
    return joined.select("doc_id", "term_id", (F.col("cnt") / F.col("num_words")).alias("freq"))

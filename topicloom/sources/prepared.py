"""A corpus laid out for repeated passes: bounded blocks of (document, term) pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import RunFolder, shuffle_partitions
from topicloom.sources.corpus import doc_stats

DOC, TERM, BLOCK, ASSIGN = 0, 1, 2, 3
BLOCK_PAIRS = 500_000
MIN_BLOCK_PAIRS = 20_000
BLOCKS_PER_TASK = 4
NEEDED_PER_PARTITION = 2_000_000


@dataclass(frozen=True)
class Corpus:
    """``tokens`` has one block per partition and is cached; ``needed`` lists the ids each block must look up."""

    spark: SparkSession
    run: RunFolder
    tokens: DataFrame  # block, doc_id, term_id, cnt
    needed: DataFrame  # block, kind, id
    docs: DataFrame  # doc_id, num_words, num_unique; documents without terms included
    partitions: int
    needed_rows: int
    piece: int  # documents of more distinct terms are spread over blocks
    num_docs: int
    num_words: int
    num_pairs: int
    seen_terms: int
    vocab_size: int

    @property
    def doc_terms(self) -> DataFrame:
        return self.tokens.select("doc_id", "term_id", "cnt")

    def release(self) -> None:
        self.tokens.unpersist()
        self.needed.unpersist()


def prepare_corpus(
    doc_terms: DataFrame,
    doc_ids: DataFrame | None = None,
    vocab_size: int | None = None,
    block_pairs: int = BLOCK_PAIRS,
    unique: bool = False,
    sizes_of: DataFrame | None = None,
) -> Corpus:
    """Cut a corpus into blocks and write it once.

    A block is what a pass hands to one task: all pairs of many documents, about ``block_pairs`` of
    them while the session has a task for each, and up to BLOCKS_PER_TASK times as many beyond. A document that is itself larger is cut by the hash of the term, so no document and no term
    can overfill a task: a pair occurs once, and a term at most once per document of a block.
    Every block is one partition, so a task ships the vector of an id, and the sums of an id, once. The ids
    of a block are listed where its pairs are; listing them moves none.
    Repeated pairs are added up first, which moves every pair once; with ``unique`` the caller vouches that no
    pair repeats, and they stay where they are. Nulls, negative term ids and negative counts are errors.
    ``sizes_of(doc_id, cnt)`` are the same pairs where a task holds whole documents, so that its documents are counted
    before they move; pairs in the order of the term would send a row for each task that holds some of a document.
    """
    spark = doc_terms.sparkSession
    run = RunFolder(spark, "corpus")
    wrong = F.expr("doc_id IS NULL OR term_id IS NULL OR cnt IS NULL OR term_id < 0 OR cnt < 0")
    checked = F.when(wrong, F.raise_error(F.lit("a pair has a null, a negative term or a negative count"))).otherwise(F.col("cnt"))
    if unique:
        summed = doc_terms.select("doc_id", "term_id", checked.cast("bigint").alias("cnt"))
    else:
        summed = doc_terms.groupBy("doc_id", "term_id").agg(F.sum(checked).cast("bigint").alias("cnt"))
    pairs = run.write(summed, "doc_terms")
    stats = run.write(doc_stats(pairs if sizes_of is None else sizes_of, doc_ids), "doc_stats")
    sizes = stats.agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("num_words"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("num_unique"), F.lit(0)).alias("pairs"),
    ).first()
    cores = spark.sparkContext.defaultParallelism
    least = max(-(-sizes.pairs // block_pairs), min(cores, -(-sizes.pairs // MIN_BLOCK_PAIRS)), 1)
    n_blocks = min(least, max(shuffle_partitions(spark), cores, -(-least // BLOCKS_PER_TASK)))
    piece = max(block_pairs // 4, 1)
    # there are at most pairs / piece documents of several pieces, so only these few are looked up
    large = stats.where(F.col("num_unique") > piece).select("doc_id", F.ceil(F.col("num_unique") / piece).cast("int").alias("pieces"))
    pieces = pairs.join(F.broadcast(large), "doc_id", "left")
    # one-piece documents must land whole in a block, so their terms do not enter the hash
    part = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("term_id"), F.col("pieces"))).otherwise(F.lit(0))
    blocked = pieces.select(
        F.pmod(F.xxhash64("doc_id", part.cast("int")), F.lit(n_blocks)).cast("int").alias("block"),
        "doc_id",
        "term_id",
        "cnt",
    )
    tokens = blocked.repartitionById(n_blocks, "block").sortWithinPartitions("block", "doc_id").persist()
    listed = run.write(tokens.select("block", "doc_id", "term_id").mapInArrow(_ids_of_blocks, "block int, kind int, id bigint"), "needed")
    is_term = F.col("kind") == TERM
    terms = listed.agg(
        F.count_distinct(F.when(is_term, F.col("id"))).alias("seen"),
        (F.coalesce(F.max(F.when(is_term, F.col("id"))), F.lit(-1)) + 1).alias("size"),
        F.count("*").alias("rows"),
    )
    seen = terms.first()
    needed = listed.repartition(max(shuffle_partitions(spark), -(-seen["rows"] // NEEDED_PER_PARTITION)), "kind", "id").persist()
    if vocab_size is not None and vocab_size < seen["size"]:
        raise ValueError(f"vocab_size {vocab_size} is smaller than the largest term id + 1 ({seen['size']})")
    return Corpus(
        spark=spark,
        run=run,
        tokens=tokens,
        needed=needed,
        docs=stats,
        partitions=n_blocks,
        needed_rows=seen["rows"],
        piece=piece,
        num_docs=sizes.docs,
        num_words=sizes.words,
        num_pairs=sizes.pairs,
        seen_terms=seen["seen"],
        vocab_size=vocab_size if vocab_size is not None else seen["size"],
    )


def _ids_of_blocks(batches):
    """The distinct document and term ids of the blocks of one partition, whose pairs are in the order of block."""

    def listed(b, held):
        for kind, parts in zip((DOC, TERM), held):
            ids = np.unique(np.concatenate(parts))
            yield pa.record_batch(
                {
                    "block": pa.array(np.full(len(ids), b, np.int32)),
                    "kind": pa.array(np.full(len(ids), kind, np.int32)),
                    "id": pa.array(ids),
                }
            )

    current, held = None, ([], [])
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if current is not None and block[lo] != current:
                yield from listed(current, held)
                held = ([], [])
            current = int(block[lo])
            for parts, name in zip(held, ("doc_id", "term_id")):
                # documents come in order, terms of a batch repeat
                parts.append(np.unique(batch.column(name).to_numpy()[lo:hi]))
    if current is not None:
        yield from listed(current, held)

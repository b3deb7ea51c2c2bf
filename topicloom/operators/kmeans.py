"""L1 (or Lp) k-means over sparse document frequencies, used to start the topics.

Centroids are kept as ``(term_id, vec ARRAY<DOUBLE>)`` with one entry per cluster, for terms in use only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.special import pack
from topicloom.functions.vectors import literal_sql, number, per_topic
from topicloom.operators.blocks import VECTOR_SCHEMA, Block, add_shares, run_blocks, vector_table
from topicloom.session import RunFolder, wide_expressions
from topicloom.sources.prepared import DOC, TERM, Corpus


def seed_documents(stats: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``(k, doc_id)``: k distinct non-empty documents, drawn by the order of a keyed hash."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    drawn = stats.where("num_words > 0").select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(k)
    rank = F.row_number().over(Window.orderBy("key", "doc_id")) - 1  # over the k drawn rows only
    return drawn.select(rank.alias("k"), "doc_id")


def seed_centroids(corpus: Corpus, seeds: DataFrame, k: int) -> DataFrame:
    """The frequencies of the k seed documents as centroids; the seeds are k rows, so they are broadcast."""
    chosen = corpus.docs.join(F.broadcast(seeds), "doc_id").select("doc_id", "k", "num_words")
    freq = corpus.doc_terms.join(F.broadcast(chosen), "doc_id").select(
        "term_id", "k", (F.col("cnt") / F.col("num_words")).alias("freq")
    )
    return centroid_vectors(freq.select("k", "term_id", F.col("freq").alias("value")), k)


def centroid_vectors(centroids: DataFrame, k: int) -> DataFrame:
    """``(k, term_id, value)`` as one vector per term."""
    at = lambda i: f"coalesce(sum(value) FILTER (WHERE k = {i}), 0D)"
    return centroids.groupBy("term_id").agg(per_topic(k, at).alias("vec"))


def distances(corpus: Corpus, centroids: DataFrame, k: int, p: float = 1.0) -> DataFrame:
    """``(doc_id, dist)``: sum over the vocabulary of abs(freq - centroid)^p, for non-empty documents.

    Only the terms of a document differ from the sum of the centroid alone, so the pass visits its pairs
    and corrects that sum: no document is ever expanded to the vocabulary.
    """
    row = centroids.agg(per_topic(k, lambda i: f"sum(power(abs(vec[{i}]), {number(p)}))").alias("alone")).first()
    alone = literal_sql([x or 0.0 for x in row["alone"]])
    lengths = F.array_repeat(F.col("num_words").cast("double"), k)
    vectors = corpus.docs.select(
        F.lit(DOC).alias("kind"), F.col("doc_id").alias("id"), pack(lengths).alias("vec")
    ).unionAll(centroids.select(F.lit(TERM).alias("kind"), F.col("term_id").alias("id"), pack("vec").alias("vec")))
    shares = run_blocks(corpus, vectors, _distance_kernel(k, p), VECTOR_SCHEMA)
    return add_shares(corpus, shares, k).select(
        F.col("id").alias("doc_id"), F.expr(f"zip_with(vec, {alone}, (x, s) -> x + s)").alias("dist")
    )


def _distance_kernel(k: int, p: float):
    def kernel(pairs, vectors):
        block = Block(pairs, vectors, k, sparse_terms=True)
        alone = np.abs(block.term_vec) ** p
        out = np.empty((len(block.segments), k))
        for i, ((lo, hi), d) in enumerate(zip(block.segments, block.segment_doc)):
            t = block.term[lo:hi]
            freq = block.cnt[lo:hi] / block.doc_vec[d, 0]
            out[i] = (np.abs(freq[:, None] - block.term_vec[t]) ** p - alone[t]).sum(axis=0)
        return vector_table(DOC, block.segment_doc_id, out)

    return kernel


def assign(dist: DataFrame) -> DataFrame:
    """``(doc_id, k)``: the nearest centroid, the lowest index among equals.

    A document that shares no term with any centroid is equally far from all of them, but for the last
    bits of the sums. Distances that agree to nine decimals count as equal, so that the order in which
    rows are added up cannot decide.
    """
    rounded = dist.select("doc_id", F.transform("dist", lambda x: F.round(x, 9)).alias("dist"))
    return rounded.select("doc_id", (F.array_position("dist", F.array_min("dist")) - 1).cast("int").alias("k"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("k").agg(F.count("*").alias("size"))


def mean_centroids(corpus: Corpus, assigned: DataFrame, k: int) -> DataFrame:
    """``(term_id, vec)``: per cluster the mean frequency over all members, absent terms counting as zero.

    The label of a document is routed to the blocks that hold its pairs; a block adds up frequencies by
    (cluster, term) itself and sends one vector per term, so no pair moves.
    """
    label = F.array(F.col("k").cast("double"), F.col("num_words").cast("double"))
    labels = corpus.docs.join(assigned, "doc_id").select(
        F.lit(DOC).alias("kind"), F.col("doc_id").alias("id"), pack(label).alias("vec")
    )
    sums = add_shares(corpus, run_blocks(corpus, labels, _member_kernel(k), VECTOR_SCHEMA), k)
    sizes = np.ones(k)
    for row in cluster_sizes(assigned).collect():  # at most k rows
        sizes[row["k"]] = row["size"]
    means = f"zip_with(vec, {literal_sql(sizes)}, (x, n) -> x / n)"
    return sums.select(F.col("id").alias("term_id"), F.expr(means).alias("vec"))


def centroid_rows(centroids: DataFrame) -> DataFrame:
    """``(k, term_id, value)`` of the terms that members of a cluster hold."""
    return centroids.select("term_id", F.posexplode("vec").alias("k", "value")).where("value <> 0").select("k", "term_id", "value")


def _member_kernel(k: int):
    def kernel(pairs, vectors):
        block = Block(pairs, vectors, 2)
        terms, term = np.unique(block.pair_term_id, return_inverse=True)
        doc_id = np.repeat(block.segment_doc_id, [hi - lo for lo, hi in block.segments])
        place = np.minimum(block.pair_doc, max(len(block.doc_ids) - 1, 0))
        known = block.doc_ids[place] == doc_id if len(block.doc_ids) else np.zeros(len(doc_id), bool)
        label, words = block.doc_vec[place[known], 0].astype(np.int64), block.doc_vec[place[known], 1]
        sums = np.bincount(term[known] * k + label, block.cnt[known] / words, minlength=len(terms) * k)
        return vector_table(TERM, terms, sums.reshape(len(terms), k))

    return kernel


def relabel(sizes: DataFrame, k: int) -> DataFrame:
    """``(k, size, rank)``: clusters by falling size, ties by index; empty clusters come last."""
    every = sizes.sparkSession.range(k).select(F.col("id").cast("int").alias("k"))
    full = every.join(sizes, "k", "left").na.fill(0, ["size"])
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "k")) - 1  # over k rows
    return full.select("k", "size", rank.alias("rank"))


def fit_kmeans(
    corpus: Corpus, k: int, passes: int = 1, seed: int = 0, p: float = 1.0, run: RunFolder | None = None
) -> tuple[DataFrame, DataFrame]:
    """A fixed number of passes from hash-drawn seeds: ``(centroids, assigned)``."""
    run = run or RunFolder(corpus.spark, "kmeans")
    with wide_expressions(corpus.spark):
        seeds = run.write(seed_documents(corpus.docs, k, seed), "kmeans_seeds")
        centroids = run.write(seed_centroids(corpus, seeds, k), "kmeans_centroids-0")
        for step in range(1, passes + 1):
            assigned = run.write_slot(assign(distances(corpus, centroids, k, p)), "kmeans_assigned", step)
            centroids = run.write_slot(mean_centroids(corpus, assigned, k), "kmeans_centroids", step)
    return centroids, assigned


def initial_topics(corpus: Corpus, centroids: DataFrame, order: list[int], gamma: float) -> DataFrame:
    """``(term_id, gam)`` of every seen term: gamma/D + gamma * centroid, clusters taken in ``order``."""
    flat = gamma / corpus.vocab_size
    seen = corpus.needed.where(F.col("kind") == TERM).select(F.col("id").alias("term_id")).distinct()
    value = lambda i: f"coalesce(vec[{order[i]}], 0D) * {number(gamma)} + {number(flat)}"
    return seen.join(centroids, "term_id", "left").select("term_id", per_topic(len(order), value).alias("gam"))

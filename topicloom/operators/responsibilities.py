"""Topic responsibilities of (document, term) pairs and the counts they imply.

A pair's responsibility for topic k is proportional to exp(E[ln eta_kw] + E[ln Z_dk]).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import digamma_array, np_digamma, pack
from topicloom.functions.vectors import literal_sql, per_topic, sum_vectors
from topicloom.operators.blocks import VECTOR_SCHEMA, Block, add_shares, list_column, run_blocks, vector_table
from topicloom.sources.prepared import ASSIGN, BLOCK, DOC, TERM, Corpus

# E[ln Z] from digamma of the shape and the rate.
LOG_WEIGHT = "zip_with(psi_a, b, (x, y) -> x - ln(y))"
# Below this the plain product of two exponentials may have lost digits; the pair is redone in logs.
UNDERFLOW = 1e-200


def topic_totals(gam: DataFrame, k: int, seen_terms: int, vocab_size: int, prior: float) -> np.ndarray:
    """Sum of each topic's Dirichlet parameters over the whole vocabulary; unseen ids hold the prior."""
    row = gam.agg(sum_vectors("gam", k).alias("gam")).first()
    return np.array([x or 0.0 for x in row["gam"]]) + (vocab_size - seen_terms) * prior


def expected_log_topics(gam: DataFrame, totals) -> DataFrame:
    """``(term_id, elneta)``: digamma of the parameter minus digamma of the topic's total."""
    shift = literal_sql(np_digamma(totals))
    psi = gam.select("term_id", digamma_array("gam").alias("psi"))
    return psi.select("term_id", F.expr(f"zip_with(psi, {shift}, (x, s) -> x - s)").alias("elneta"))


def expected_log_weights(docs: DataFrame) -> DataFrame:
    """``(doc_id, elnz)`` of documents with gamma shapes ``a`` and rates ``b``."""
    logs = docs.select("doc_id", "b", digamma_array("a").alias("psi_a"))
    return logs.select("doc_id", F.expr(LOG_WEIGHT).alias("elnz"))


def token_scores(corpus: Corpus, elneta: DataFrame, elnz: DataFrame, k: int) -> DataFrame:
    """``(doc_id, term_id, cnt, score)``: the unnormalised log responsibility of every pair, computed in the blocks."""

    def kernel(pairs, vectors):
        block = Block(pairs, vectors, k)
        return pa.table(
            {
                "doc_id": pa.array(block.doc_ids[block.pair_doc]),
                "term_id": pa.array(block.pair_term_id),
                "cnt": pa.array(block.cnt.astype(np.int64)),
                "score": list_column(block.doc_vec[block.pair_doc] + block.term_vec[block.term]),
            }
        )

    return run_blocks(corpus, log_vectors(elneta, elnz), kernel, "doc_id bigint, term_id bigint, cnt bigint, score array<double>")


def responsibilities(scores: DataFrame, k: int) -> DataFrame:
    """``(doc_id, term_id, cnt, r)``: the softmax of the scores, with the largest score subtracted."""
    topped = scores.select("doc_id", "term_id", "cnt", "score", F.array_max("score").alias("top"))
    weights = topped.select(
        "doc_id", "term_id", "cnt", per_topic(k, lambda i: f"exp(score[{i}] - top)").alias("w")
    ).withColumn("size", F.expr(" + ".join(f"w[{i}]" for i in range(k))))
    return weights.select("doc_id", "term_id", "cnt", per_topic(k, lambda i: f"w[{i}] / size").alias("r"))


def log_vectors(elneta: DataFrame, elnz: DataFrame) -> DataFrame:
    """Both sides of a token pass as one packed ``(kind, id, vec)`` table."""
    docs = elnz.select(F.lit(DOC).alias("kind"), F.col("doc_id").alias("id"), pack("elnz").alias("vec"))
    terms = elneta.select(F.lit(TERM).alias("kind"), F.col("term_id").alias("id"), pack("elneta").alias("vec"))
    return docs.unionAll(terms)


def expected_counts(corpus: Corpus, vectors: DataFrame, k: int, shift=0.0) -> DataFrame:
    """``(kind, id, vec)``: expected counts per topic of every document and every term.

    ``vectors`` hold E[ln Z] per document and per term E[ln eta], up to the ``shift`` to be subtracted.

    One pass gives both. Rows of kind BLOCK carry two sums of their block instead: the entropy of the
    responsibilities and the expected log-probability of the words; rows of kind ASSIGN that of the topic
    assignments. Each block adds up its own share first; one shuffle by id adds the shares.
    """
    return add_shares(corpus, run_blocks(corpus, vectors, _count_kernel(k, shift), VECTOR_SCHEMA), k)


def _count_kernel(k: int, shift):
    def kernel(pairs, vectors):
        block = Block(pairs, vectors, k)
        ln_z, ln_eta = block.doc_vec, block.term_vec - shift
        top_z, top_eta = ln_z.max(axis=1), ln_eta.max(axis=1)
        z, eta = np.exp(ln_z - top_z[:, None]), np.exp(ln_eta - top_eta[:, None])
        doc_counts, term_weights = np.zeros_like(z), np.zeros_like(eta)
        exact_terms = np.zeros_like(eta)
        entropy = 0.0
        for (lo, hi), d in zip(block.segments, block.segment_doc):
            t, n = block.term[lo:hi], block.cnt[lo:hi]
            rows = eta[t]
            norm = rows @ z[d]
            ln_norm = top_z[d] + top_eta[t]
            lost = norm < UNDERFLOW
            if lost.any():
                x = ln_eta[t[lost]] + ln_z[d]
                top = x.max(axis=1)
                r = np.exp(x - top[:, None])
                size = r.sum(axis=1)
                r *= (n[lost] / size)[:, None]
                exact_terms[t[lost]] += r
                doc_counts[d] += r.sum(axis=0)
                entropy += n[lost] @ (top + np.log(size))
                t, n, rows, norm, ln_norm = t[~lost], n[~lost], rows[~lost], norm[~lost], ln_norm[~lost]
            w = n / norm
            doc_counts[d] += z[d] * (w @ rows)
            term_weights[t] += w[:, None] * z[d]  # a term occurs once in a document's part of the block
            entropy += n @ (np.log(norm) + ln_norm)
        term_counts = term_weights * eta + exact_terms
        words, assigned = (term_counts * ln_eta).sum(), (doc_counts * ln_z).sum()
        first, second = np.zeros((1, k)), np.zeros((1, k))
        first[0, :2] = entropy - assigned - words, words
        second[0, 0] = assigned
        block_id = np.array([pairs["block"][0].as_py()])
        return pa.concat_tables(
            [
                vector_table(DOC, block.doc_ids, doc_counts),
                vector_table(TERM, block.term_ids, term_counts),
                vector_table(BLOCK, block_id, first),
                vector_table(ASSIGN, block_id, second),
            ]
        )

    return kernel


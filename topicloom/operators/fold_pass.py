"""All iterations of a fold-in in one pass over the blocks.

With the topics held fixed a document depends on no other, so a block that holds it whole can take it through any
number of iterations at once; its pairs, and the topics of its terms, are read a single time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import np_digamma, pack_rows
from topicloom.operators.blocks import Block, list_column, run_blocks
from topicloom.operators.document_pass import MOVED, SCHEMA, SUMS, moved_rows
from topicloom.operators.responsibilities import UNDERFLOW
from topicloom.sources.prepared import TERM, Corpus

# Numbers that the topics of the pairs at hand may hold at once.
AT_ONCE = 1 << 20


def fold_blocks(
    corpus: Corpus, terms: DataFrame, shift, start, beta_p, u, inv_cov, steps: int, iterations: int
) -> DataFrame:
    """SCHEMA of the documents after ``iterations`` from the shape, rate, mean and variance of ``start``.

    ``terms(term_id, psi)`` hold packed digammas, ``shift`` those of the topics' totals. Rows of part SUMS carry, for
    every iteration, the expected log-probability and entropy of the tokens and then the sums over documents.
    Every document must lie whole in a block.
    """
    k = len(beta_p)

    def run(words, pairs):
        state = [np.full((len(words), k), x) for x in start]
        ln_z = np_digamma(state[0]) - np.log(state[1])
        sums = []
        for _ in range(iterations):
            n, tokens = _counts(pairs, ln_z) if pairs else (np.zeros((len(words), k)), 0.0)
            *state, ln_z, added = moved_rows(words, n, *state, beta_p, u, inv_cov, steps)
            sums.append(np.r_[tokens, added])
        return n, state, ln_z, np.array(sums)

    def table(ids, words, n, state, ln_z):
        rows = len(ids)
        return pa.table(
            {
                "part": pa.array(np.full(rows, MOVED, np.int32)),
                "doc_id": pa.array(ids),
                "num_words": pa.array(words.astype(np.int64)),
                **{c: list_column(v) for c, v in zip(("n", "a", "b", "mu", "sig"), (n, *state))},
                "lnz": pack_rows(ln_z.ravel(), rows),
                "sums": pa.nulls(rows, pa.list_(pa.float64())),
                "note": pa.nulls(rows, pa.string()),
            }
        )

    def sums_table(sums):
        columns = {"part": pa.array([SUMS], pa.int32()), **{c: pa.nulls(1, pa.int64()) for c in ("doc_id", "num_words")}}
        columns |= {c: pa.nulls(1, pa.list_(pa.float64())) for c in ("n", "a", "b", "mu", "sig")}
        return pa.table(columns | {"lnz": pa.nulls(1, pa.binary()), "sums": pa.array([sums.ravel()], pa.list_(pa.float64())), "note": pa.nulls(1, pa.string())})

    def kernel(pairs, vectors):
        block = Block(pairs, vectors, k)
        words = block.sums_by_document(block.cnt)
        ends = np.array([hi for _, hi in block.segments])
        out, total, begin = [], 0.0, 0
        while begin < len(ends):
            first = block.segments[begin][0]
            end = max(begin + 1, int(np.searchsorted(ends, first + AT_ONCE // k, side="right")))
            at = slice(first, ends[end - 1])
            sizes = np.diff(np.r_[first, ends[begin:end]])
            ln_eta = block.term_vec[block.term[at]] - shift
            held = (np.repeat(np.arange(end - begin), sizes), block.cnt[at], ln_eta)
            n, state, ln_z, sums = run(words[begin:end], held)
            out.append(table(block.segment_doc_id[begin:end], words[begin:end], n, state, ln_z))
            total, begin = total + sums, end
        return pa.concat_tables([*out, sums_table(total)])

    def wordless(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                ids, words = batch.column("doc_id").to_numpy(), np.zeros(batch.num_rows)
                n, state, ln_z, sums = run(words, None)
                total = sums if total is None else total + sums
                yield from table(ids, words, n, state, ln_z).to_batches()
        if total is not None:
            yield from sums_table(total).to_batches()

    vectors = terms.select(F.lit(TERM).alias("kind"), F.col("term_id").alias("id"), F.col("psi").alias("vec"))
    empty = corpus.docs.where("num_unique = 0").select("doc_id")
    return run_blocks(corpus, vectors, kernel, SCHEMA).unionAll(empty.mapInArrow(wordless, SCHEMA))


def _counts(pairs, ln_z):
    """Expected counts of documents per topic, and the tokens' part of the bound."""
    doc, cnt, ln_eta = pairs
    top_eta, top_z = ln_eta.max(axis=1), ln_z.max(axis=1)
    eta, z = np.exp(ln_eta - top_eta[:, None]), np.exp(ln_z - top_z[:, None])
    norm = np.einsum("pk,pk->p", eta, z[doc])
    lost = norm < UNDERFLOW
    norm[lost] = 1.0
    share = np.where(lost, 0.0, cnt / norm)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.add.reduceat(share[:, None] * eta, starts, axis=0) * z
    value = np.where(lost, 0.0, cnt) @ (np.log(norm) + top_z[doc] + top_eta)
    if lost.any():
        x = ln_eta[lost] + ln_z[doc[lost]]
        top = x.max(axis=1)
        r = np.exp(x - top[:, None])
        size = r.sum(axis=1)
        np.add.at(n, doc[lost], r * (cnt[lost] / size)[:, None])
        value += cnt[lost] @ (top + np.log(size))
    return n, value - (n * ln_z).sum()


def collect_fold_sums(slot: DataFrame, iterations: int) -> np.ndarray:
    """What :func:`fold_blocks` added up, a row for each iteration."""
    rows = slot.where(F.col("part") == SUMS).select(F.posexplode("sums").alias("at", "value"))
    found = rows.groupBy("at").agg(F.sum("value").alias("value")).collect()  # a few numbers for each iteration
    flat = np.zeros(len(found))
    for r in found:
        flat[r["at"]] = r["value"]
    return flat.reshape(iterations, -1)

"""One pass over the pairs of a corpus, with the vectors of their documents and terms at hand.

Joining a topic vector to every pair would ship pairs x topics numbers. Instead each block receives the
vector of every distinct document and term it holds once, next to its pairs, which never move. A kernel
returns sums, or one row per document or per pair; all operators on pairs are kernels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import unpack_rows
from topicloom.functions.vectors import sum_vectors
from topicloom.session import shuffle_partitions
from topicloom.sources.prepared import DOC, TERM, Corpus

VECTOR_SCHEMA = "kind int, id bigint, vec array<double>"
# Blocks beyond which sums go through a tree, and bytes of shares that one task of a sum should read.
TREE = 512
SHARE_BYTES = 128 << 20


def route(corpus: Corpus, vectors: DataFrame) -> DataFrame:
    """``(at, kind, id, vec)``: each packed vector once per block that needs it, placed with the block."""
    return (
        corpus.needed.join(vectors, ["kind", "id"])
        .select(F.col("block").alias("at"), "kind", "id", "vec")
        .repartitionById(corpus.partitions, "at")
    )


def run_blocks(
    corpus: Corpus, vectors: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``kernel(pairs, vectors)`` for every block; both sides are already placed by block.

    ``vectors(kind, id, vec BINARY)`` are packed; the kernel's own rows are plain arrays, ready for sums.
    """
    return (
        corpus.tokens.groupBy("block").cogroup(route(corpus, vectors).groupBy("at")).applyInArrow(kernel, schema)
    )


def add_shares(corpus: Corpus, shares: DataFrame, k: int, tree: int = TREE) -> DataFrame:
    """``(kind, id, vec)`` added up over the blocks.

    A block is a task and has added up its own rows, so a task sends one row per id. Placing the rows
    before the sum spares the map side a useless hash aggregation of wide rows. A term that every block holds
    has as many rows as there are blocks; beyond ``tree`` blocks they are first added up in about as many
    groups as each group has rows, so that no task reads more than the square root of them.
    """
    rows = max(1, SHARE_BYTES // (8 * k + 16))
    wide = -(-corpus.needed_rows // rows)
    parts = (wide,) if wide > shuffle_partitions(corpus.spark) else ()
    if corpus.partitions > tree:
        groups = math.isqrt(corpus.partitions)
        salted = shares.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(groups)))
        salted = salted.repartition(*parts, "kind", "id", "salt").groupBy("kind", "id", "salt")
        shares = salted.agg(sum_vectors("vec", k).alias("vec")).drop("salt")
    return shares.repartition(*parts, "kind", "id").groupBy("kind", "id").agg(sum_vectors("vec", k).alias("vec"))


class Block:
    """The pairs of one block as positions into its document and term vectors, grouped by document.

    With ``sparse_terms`` a term may have no vector; it then points at a row of zeros after the others.
    """

    def __init__(self, pairs: pa.Table, vectors: pa.Table, k: int, sparse_terms: bool = False):
        kinds = vectors["kind"].to_numpy()
        ids = vectors["id"].to_numpy()
        rows = unpack_rows(vectors["vec"].combine_chunks(), k)
        self.doc_ids, self.doc_vec = _sorted_side(ids, rows, kinds == DOC)
        self.term_ids, self.term_vec = _sorted_side(ids, rows, kinds == TERM)
        doc_id = pairs["doc_id"].to_numpy()
        order = np.argsort(doc_id, kind="stable")
        doc_id = doc_id[order]
        self.pair_term_id = pairs["term_id"].to_numpy()[order]
        self.cnt = pairs["cnt"].to_numpy()[order].astype(float)
        starts = np.flatnonzero(np.r_[True, doc_id[1:] != doc_id[:-1]])
        self.segments = list(zip(starts, np.r_[starts[1:], len(doc_id)]))
        self.segment_doc_id = doc_id[starts]
        self.segment_doc = np.searchsorted(self.doc_ids, self.segment_doc_id)
        self.term = np.searchsorted(self.term_ids, self.pair_term_id)
        if sparse_terms:
            known = np.r_[self.term_ids, -1][self.term] == self.pair_term_id
            self.term[~known] = len(self.term_ids)
            self.term_vec = np.vstack([self.term_vec, np.zeros((1, k))])


    @property
    def pair_doc(self) -> np.ndarray:
        """The position of every pair's document among the document vectors."""
        return np.repeat(self.segment_doc, [hi - lo for lo, hi in self.segments])

    def sums_by_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value per pair, one for each of ``segment_doc_id``."""
        return np.add.reduceat(values, [lo for lo, _ in self.segments])


def _sorted_side(ids, rows, chosen):
    ids, rows = ids[chosen], rows[chosen]
    order = np.argsort(ids)
    return ids[order], rows[order]


def list_column(rows: np.ndarray) -> pa.ListArray:
    n, k = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel())
    )


def vector_table(kind: int, ids: np.ndarray, rows: np.ndarray) -> pa.Table:
    """Rows of VECTOR_SCHEMA."""
    return pa.table(
        {
            "kind": pa.array(np.full(len(rows), kind, dtype=np.int32)),
            "id": pa.array(ids.astype(np.int64)),
            "vec": list_column(rows),
        }
    )

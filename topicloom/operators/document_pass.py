"""The document half of an iteration as one pass: gamma posterior, normal posterior, and every sum over documents.

The pass reads each document once and leaves, beside the moved documents, one row of sums per task. Nothing
else has to read the documents before the next iteration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import np_digamma, np_lgamma, pack_rows
from topicloom.operators.blocks import list_column
from topicloom.operators.updates import ascend
from topicloom.sources.prepared import BLOCK, TERM

MOVED, SUMS = 0, 1
SCHEMA = (
    "part int, doc_id bigint, num_words bigint, n array<double>, a array<double>, b array<double>,"
    " mu array<double>, sig array<double>, lnz binary, sums array<double>, note string"
)
DOCUMENT = ("doc_id", "num_words", "n", "a", "b", "mu", "sig", "lnz")
# Places below zero in the collected sums belong to the counts of the token pass.
TOPIC_LNG, TOKEN_ENTROPY, TOKEN_WORDS = -1, -2, -3


def move_documents(docs: DataFrame, beta_p, u, inv_cov, steps: int, note: str = "") -> DataFrame:
    """SCHEMA of ``docs(doc_id, num_words, n, a, b, mu, sig)``, whose ``n`` are the new expected counts.

    Rows of part MOVED are the documents with new a, b and, where ``inv_cov`` is given, ``steps`` moves of mu
    and sig, and their packed E[ln Z]. A task adds one row of part SUMS with what it added up; ``note`` stands
    on that of the first task. A document without words keeps its prior: a = beta p, b = exp(mu + sig / 2).
    """
    beta_p, u = np.asarray(beta_p, dtype=float), np.asarray(u, dtype=float)
    k = len(beta_p)

    def matrix(batch, name):
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    def move(batches):
        total = np.zeros(3 + 3 * k + k * (k + 3))
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            words = batch.column("num_words").to_numpy().astype(float)
            n, old_a, old_b, mu, sig = (matrix(batch, c) for c in ("n", "a", "b", "mu", "sig"))
            a, b, mu, sig, ln_z, sums = moved_rows(words, n, old_a, old_b, mu, sig, beta_p, u, inv_cov, steps)
            total += sums
            arrays = {
                "part": pa.array(np.full(rows, MOVED, np.int32)),
                "doc_id": batch.column("doc_id"),
                "num_words": batch.column("num_words"),
                "n": batch.column("n"),
                **{c: list_column(v) for c, v in (("a", a), ("b", b), ("mu", mu), ("sig", sig))},
                "lnz": pack_rows(ln_z.ravel(), rows),
                "sums": pa.nulls(rows, pa.list_(pa.float64())),
                "note": pa.nulls(rows, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(arrays)
        vector, empty = pa.list_(pa.float64()), pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([SUMS], pa.int32()),
                "doc_id": empty,
                "num_words": empty,
                **{c: pa.nulls(1, vector) for c in ("n", "a", "b", "mu", "sig")},
                "lnz": pa.nulls(1, pa.binary()),
                "sums": pa.array([total], vector),
                "note": pa.array([note if TaskContext.get().partitionId() == 0 else ""]),
            }
        )

    return docs.select("doc_id", "num_words", "n", "a", "b", "mu", "sig").mapInArrow(move, SCHEMA)


def moved_rows(words, n, a, b, mu, sig, beta_p, u, inv_cov, steps: int):
    """New a, b, mu, sig and E[ln Z] of some documents, one in a row, and what they add to the sums."""
    a, b = n + beta_p, np.exp(mu + 0.5 * sig) + (words / (a / b).sum(axis=1))[:, None]
    if inv_cov is not None:
        for _ in range(steps):
            mu, sig = ascend(mu, sig, a / b, beta_p, u, inv_cov)
    ln_b, mean = np.log(b), a / b
    ln_z = np_digamma(a) - ln_b
    off = mu - u
    moments = [off.T @ off, off.sum(axis=0), sig.sum(axis=0), np.log(np.where(sig > 0, sig, 1.0)).sum(axis=0)]
    settled = (a - a * ln_b).sum() + np_lgamma(a).sum()
    normaliser = -(words @ np.log(mean.sum(axis=1)))
    rate = -(mean * np.exp(mu + 0.5 * sig)).sum()
    sums = np.r_[
        settled, normaliser, rate, n.sum(axis=0), mu.sum(axis=0), ln_z.sum(axis=0), np.column_stack(moments).ravel()
    ]
    return a, b, mu, sig, ln_z, sums


def moved_documents(slot: DataFrame) -> DataFrame:
    return slot.where(F.col("part") == MOVED).select(*DOCUMENT)


def collect_sums(slot: DataFrame, counts: DataFrame, k: int) -> dict:
    """Every sum over documents and over the token pass, by one action; K x (K + 6) numbers and a few more.

    ``counts`` may carry ``lng``, the log-gamma of the new topics; without it that sum is 0.
    """
    docs = slot.where(F.col("part") == SUMS).select(F.posexplode("sums").alias("at", "value"))
    lng = F.col("lng") if "lng" in counts.columns else F.lit(0.0)
    is_kind = lambda kind: F.col("kind") == kind
    entries = F.when(is_kind(TERM), F.array(F.struct(F.lit(TOPIC_LNG).alias("at"), lng.alias("value")))).otherwise(
        F.array(
            F.struct(F.lit(TOKEN_ENTROPY).alias("at"), F.col("vec")[0].alias("value")),
            F.struct(F.lit(TOKEN_WORDS).alias("at"), F.col("vec")[1].alias("value")),
        )
    )
    tokens = counts.where(is_kind(TERM) | is_kind(BLOCK)).select(F.inline(entries))
    found = docs.unionAll(tokens).groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = {r["at"]: r["value"] for r in found}
    flat = np.array([values.get(i, 0.0) for i in range(3 + 3 * k + k * (k + 3))])
    return {
        **named_sums(flat, k),
        "lng": values.get(TOPIC_LNG) or 0.0,
        "token_entropy": values.get(TOKEN_ENTROPY) or 0.0,
        "token_words": values.get(TOKEN_WORDS) or 0.0,
    }


def named_sums(flat: np.ndarray, k: int) -> dict:
    """The sums over documents by name."""
    n, mu, elnz = flat[3 : 3 + 3 * k].reshape(3, k)
    return {
        "settled": flat[0],
        "normaliser": flat[1],
        "rate": flat[2],
        "n": n,
        "mu": mu,
        "elnz": elnz,
        "moments": flat[3 + 3 * k :].reshape(k, k + 3),
    }

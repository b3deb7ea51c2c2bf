"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is read as tokens: runs of word bytes and runs of other visible bytes. One to three neighbours are
hashed as they are (lower-cased) and by shape (upper, lower, digit, mark), so that word order and layout
count as well as vocabulary. A feature's value is its share of the text's tokens.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, the smallest by hash of the id)
and has a fixed size; scoring reads every row once and moves nothing.

Defined results: null and empty texts score the bias alone; labels that are null are not learnt from;
repeated labels are repeated examples; without labels every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.text import LOWER, mix, pair_hash, steps, texts_of
from topicloom.llm.tables import pack_fields, remainder, unpack_fields

BITS = 18
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
# Bytes of text whose features are held at once; a byte takes about 70 bytes while it becomes features.
STEP = 512 << 10

# byte classes: 0 space, 1 lower and beyond ASCII, 2 upper, 3 digit, 4 mark
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3




def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and owner of every feature occurrence, and the number of tokens of each text."""
    texts = texts_of(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _CLASS[raw]
    coarse = np.where(kind == 0, 0, np.where(kind == 4, 2, 1)).astype(np.uint8)
    cut = np.r_[True, coarse[1:] != coarse[:-1]]
    cut[edges[:-1][edges[:-1] < len(raw)]] = True
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(raw)]
    visible = coarse[first] > 0
    first, last = first[visible], last[visible]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(edges, first, "right") - 1
    # bytes by position in their token: a multiplier for each position would restart at the token
    weight = mix(LOWER[raw].astype(np.uint64) + np.uint64(1))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))[0 : len(raw)] if first[0] == 0 else None
    if place is None:
        place = np.arange(len(raw)) - np.maximum.accumulate(np.where(cut, np.arange(len(raw)), 0))
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(weight * (2 * place.astype(np.uint64) + np.uint64(1)))]
        words = mix(sums[last] - sums[first])
    lead, size = kind[first], last - first
    tail = kind[np.minimum(first + 1, last - 1)]
    shape = (lead.astype(np.uint64) * np.uint64(8) + tail) * np.uint64(8) + np.minimum(size, 3).astype(np.uint64)
    marks = lead == 4
    shape = np.where(marks, shape * np.uint64(256) + LOWER[raw[first]], shape)
    edge = np.r_[False, owner[1:] != owner[:-1]]
    two = pair_hash(shape[:-1], shape[1:])[~edge[1:]]
    ok3 = ~(edge[1:-1] | edge[2:]) if len(shape) > 2 else np.zeros(0, bool)
    three = pair_hash(pair_hash(shape[:-2], shape[1:-1]), shape[2:])[ok3] if len(shape) > 2 else np.zeros(0, np.uint64)
    words2 = pair_hash(words[:-1], words[1:])
    words3 = pair_hash(words2[:-1], words[2:])[ok3] if len(shape) > 2 else np.zeros(0, np.uint64)
    owner2, owner3 = owner[:-1][~edge[1:]], owner[:-2][ok3] if len(shape) > 2 else owner[:0]
    hashes = [words, mix(shape + np.uint64(1 << 40)), mix(two + np.uint64(1)), mix(three + np.uint64(2)), words2[~edge[1:]], words3]
    owners = [owner, owner, owner2, owner3, owner2, owner3]
    buckets = (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)
    return buckets, np.concatenate(owners), np.bincount(owner, minlength=len(texts))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for the logistic loss."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (_sigmoid(float(w @ x)) - label) * x
        grown = self.n[at] + gradient**2
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


SCALE = 10.0


def _example(at: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted buckets and their counts; steps between buckets by byte planes, which compress best."""
    steps_ = np.diff(at, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
    return pack_fields(steps_, count.astype("<i4"))


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes, count = unpack_fields(data, np.uint8, "<i4")
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()), count


def train(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = BITS,
    sample_rows: int = SAMPLE_ROWS,
    epochs: int = 3,
    label: str = "quality",
) -> np.ndarray:
    """Weights (the bias last) from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    learn = F.expr("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0")
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(learn & F.col("label").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample_rows)
    )

    def extract(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                buckets, owner, n = features(part["text"], bits)
                order = np.argsort(owner, kind="stable")
                buckets, ends = buckets[order], np.cumsum(np.bincount(owner, minlength=part.num_rows))
                rows = []
                for i in range(part.num_rows):
                    at, count = np.unique(buckets[(ends[i - 1] if i else 0) : ends[i]], return_counts=True)
                    rows.append(_example(at, count))
                yield pa.record_batch(
                    {"doc_id": part["doc_id"], "label": part["label"], "n": pa.array(n), "x": pa.array(rows, pa.binary())}
                )

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # at most sample_rows (id, label) pairs are sent to the tasks that hold the texts
    examples = text.join(F.broadcast(chosen), "doc_id").mapInArrow(extract, "doc_id bigint, label int, n bigint, x binary")
    # the driver holds the examples packed and opens one at a time
    held = examples.toArrow()
    keys = [(hash((i * 2654435761) % (1 << 32)), i, y) for i, y in zip(held["doc_id"].to_pylist(), held["label"].to_pylist())]
    packed, sizes = held["x"].combine_chunks(), np.maximum(np.asarray(held["n"]), 1)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    model = Ftrl(1 << bits)
    for _ in range(epochs):
        for i in order:
            at, count = _opened(packed[i].as_py())
            model.learn(np.r_[at, 1 << bits], np.r_[count * (SCALE / sizes[i]), 1.0], keys[i][2])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part, values in _scored(batch, shared.value):
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"],
                        "held_out": pa.array(remainder(part["doc_id"].to_pylist(), 5) == 0),
                        "score": pa.array(values),
                        "predicted": pa.array((values >= threshold).astype(np.int32)),
                    }
                )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part, values in _scored(batch, shared.value):
                yield part.filter(pa.array(values >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scored(batch: pa.RecordBatch, weights: np.ndarray):
    """Slices of a batch with their scores."""
    for part in steps(batch, "text", STEP):
        yield part, _scores(part["text"], weights)


def _scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    buckets, owner, n = features(column, (len(weights) - 1).bit_length() - 1)
    sums = np.bincount(owner, weights[buckets].astype(float), minlength=len(n))
    return _sigmoid(sums * (SCALE / np.maximum(n, 1)) + float(weights[-1]))

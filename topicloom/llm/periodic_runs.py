"""Periodic runs of words: passages that repeat with a fixed period, and texts with the repeats taken out.

A run is a maximal stretch of consecutive words with smallest period q and at least max(least, 2 q) words.
Every word of a run stands in it twice or more. So words that stand only once in a segment split it, and the
pieces are split again until nothing changes; what is shorter than ``least`` is dropped on the way. The
first segment is the text. All texts of a batch are split together, a round being one sort of what is left.

A surviving segment is scanned lag by lag. A run of period q holds ``q`` or more words in a row that equal
the word q further on, so it is enough to look at every max(q, least - q)-th word; over all lags these are
n log n words instead of n squared. A hit is extended both ways by names of doubling length (equal names,
equal words), so a scan stays near n log n squared even where all words are equal. Runs found with several
lags keep the smallest.

A text is handled by one task and never moves. Memory is bounded by batches of ``STEP_BYTES``, and for one
very long text by about 100 bytes a word of its longest segment times the logarithm of its length.

Defined results: null and empty texts have no words and no runs; rows without an id are scanned like any
other, but get no period planted; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.text import spaced_words, steps

LEAST = 12
SCHEMA = (
    "doc_id bigint, n_words bigint, n_kept bigint, starts array<bigint>, lengths array<bigint>, "
    "periods array<bigint>, collapsed string"
)
DIGEST_SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


# --- finding runs ------------------------------------------------------------------------------------


def surviving_segments(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """``[begin, end)`` of the segments in which every word stands twice or more, in order.

    ``words`` are numbers, equal for equal words; text i has those from ``starts[i]`` to ``starts[i + 1]``.
    """
    place = np.arange(len(words))
    segment = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    while True:
        # drop short segments
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(segment)])
        long = np.repeat(size >= least, size)
        place, segment = place[long], segment[long]
        if not len(place):
            return []
        # words that stand once in their segment
        key = words[place]
        order = np.lexsort((key, segment))
        new = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (segment[order[1:]] != segment[order[:-1]])]
        edge = np.flatnonzero(np.r_[new, True])
        once = np.zeros(len(place), bool)
        once[order[edge[:-1][np.diff(edge) == 1]]] = True
        if not once.any():
            break
        place, segment = place[~once], segment[~once]
        if not len(place):
            return []
        cut = np.r_[True, (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])]
        segment = np.cumsum(cut) - 1
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    last = np.r_[first[1:], len(segment)] - 1
    return list(zip(place[first].tolist(), (place[last] + 1).tolist()))


def _names(x: np.ndarray) -> list[np.ndarray]:
    """Level k names the words from i on, 2^k of them, by a number; equal names are equal words."""
    levels = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while 2 * step <= len(x):
        below = levels[-1]
        pair = below[:-step] * (int(below.max()) + 1) + below[step:]
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return levels


def _reach(levels, left: np.ndarray, right: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``left`` on (or, ``back``, before it) equal those at ``right``."""
    size = len(levels[0])
    got = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, names = 1 << k, levels[k]
        if back:
            a, b = left - got - step, right - got - step
            inside = a >= 0
        else:
            a, b = left + got, right + got
            inside = b + step <= size
        same = inside.copy()
        same[inside] = names[a[inside]] == names[b[inside]]
        got[same] += step
    return got


def runs_of_segment(x: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of ``x``, by start, then period."""
    n = len(x)
    lags = np.arange(1, n // 2 + 1)
    if n < least or not len(lags):
        return np.zeros((0, 3), np.int64)
    stride = np.maximum(lags, least - lags)
    counts = np.maximum((n - lags - 1) // stride + 1, 0)
    hits_at, hits_lag = [], []
    # the places looked at, in blocks of lags of about equal work
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(lags):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")), lo + 1)
        c = counts[lo:hi]
        lag = np.repeat(lags[lo:hi], c)
        at = (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(stride[lo:hi], c)
        hit = x[at] == x[at + lag]
        hits_at.append(at[hit])
        hits_lag.append(lag[hit])
        lo = hi
    at, lag = np.concatenate(hits_at), np.concatenate(hits_lag)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # a run's stretch is at least max(q, least - q) words; look that far first on the cheap side
    levels = _names(x)
    out = []
    for lo in range(0, len(at), 1 << 20):
        a, q = at[lo : lo + (1 << 20)], lag[lo : lo + (1 << 20)]
        ahead = _reach(levels, a, a + q, False)
        behind = _reach(levels, a, a + q, True)
        good = ahead + behind >= np.maximum(q, least - q)
        out.append(np.stack([a[good] - behind[good], ahead[good] + behind[good] + q[good], q[good]], axis=1))
    found = np.concatenate(out)
    # one row per stretch, the smallest period first
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find_runs(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """All runs of all texts as rows ``place, length, period``, and the text of each."""
    parts = [np.zeros((0, 3), np.int64)]
    for begin, end in surviving_segments(words, starts, least):
        runs = runs_of_segment(words[begin:end], least)
        runs[:, 0] += begin
        parts.append(runs)
    runs = np.concatenate(parts)
    return runs, np.searchsorted(starts, runs[:, 0], "right") - 1


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


# --- over tables -------------------------------------------------------------------------------------


def planted_period(ids: list[int | None], starts: np.ndarray) -> np.ndarray:
    """The place whose word stands at each place once some texts are made periodic.

    With h the crc32 of the id in decimal: where h mod 10 is 0, words from a on repeat the first p of them.
    """
    source = np.arange(starts[-1])
    for i, doc_id in enumerate(ids):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n = int(starts[i + 1] - starts[i])
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[starts[i] + a : starts[i + 1]] = starts[i] + a + np.arange(n - a) % p
    return source


def _per_text(docs: DataFrame, plant: bool, least: int, emit, schema: str, doc_id: str, text: str) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                words, starts = spaced_words(part["text"], lower=False)
                ids = part["doc_id"].to_pylist()
                coded = words.dictionary_encode()
                number = np.asarray(coded.indices).astype(np.int64)
                if plant:
                    source = planted_period(ids, starts)
                    number = number[source]
                runs, owner = find_runs(number, starts, least)
                kept = kept_words(len(number), runs)
                places = np.flatnonzero(kept)
                # numbers of kept words, back to words, one list a text
                bounds = np.searchsorted(places, starts)
                chosen = coded.dictionary.take(pa.array(number[places])).cast(pa.large_string())
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), chosen)
                collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                edges = np.searchsorted(owner, np.arange(len(ids) + 1))
                yield emit(ids, starts, runs, edges, np.diff(bounds), collapsed)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, schema)


def periodic_runs(
    docs: DataFrame, least: int = LEAST, plant: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """SCHEMA for every row: all runs by start, then period, and the text without the repeated words."""

    def emit(ids, starts, runs, edges, n_kept, collapsed):
        local = runs[:, 0] - np.repeat(starts[:-1], np.diff(edges))
        as_lists = lambda v: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, pa.int64()))
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(starts), pa.int64()),
                "n_kept": pa.array(n_kept, pa.int64()),
                "starts": as_lists(local),
                "lengths": as_lists(runs[:, 1]),
                "periods": as_lists(runs[:, 2]),
                "collapsed": collapsed.cast(pa.string()),
            }
        )

    return _per_text(docs, plant, least, emit, SCHEMA, doc_id, text)


def run_digest(docs: DataFrame, least: int = LEAST, plant: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """DIGEST_SCHEMA for every row: the longest run and hashes of all runs and of the collapsed text."""

    def emit(ids, starts, runs, edges, n_kept, collapsed):
        best, listed = [], []
        for i in range(len(ids)):
            own = runs[edges[i] : edges[i + 1]]
            if not len(own):
                best.append((None, None, None))
                listed.append(hashlib.sha256(b"").hexdigest())
                continue
            own = own - [starts[i], 0, 0]
            best.append(tuple(own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()))
            listed.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own.tolist()).encode()).hexdigest())
        start, length, period = zip(*best)
        milli = [None if n is None else 1000 * n // q for n, q in zip(length, period)]
        column = lambda v: pa.array(v, pa.int64())
        return pa.record_batch(
            {
                "doc_id": column(ids),
                "n_runs": column(np.diff(edges)),
                "start": column(start),
                "length": column(length),
                "period": column(period),
                "exponent_milli": column(milli),
                "runs_sha256": pa.array(listed, pa.string()),
                "collapsed_sha256": pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in collapsed], pa.string()),
            }
        )

    return _per_text(docs, plant, least, emit, DIGEST_SCHEMA, doc_id, text)

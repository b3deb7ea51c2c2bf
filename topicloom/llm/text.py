"""Words of whole texts, vectorised over Arrow arrays.

Two kinds of words are used. *Spaced* words are runs of bytes other than the six ASCII white-space bytes.
*Plain* words are runs of ASCII digits, ASCII letters (lower-cased) and bytes above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# How many bytes of text a step holds at once; a longer text is a step of its own.
STEP_BYTES = 8 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _plain_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:0x80] = ord(" ")
    for first, last in (("0", "9"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


PLAIN = _plain_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` text bytes, whole rows each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, done + limit, "right")), begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def texts_of(column: pa.Array) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def _translate(texts: pa.LargeStringArray, table: np.ndarray) -> pa.LargeStringArray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[raw])
    )


def split(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and where each text's words start (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    starts = np.asarray(lists.offsets).astype(np.int64)
    starts = starts - starts[0]
    if not len(words):
        return words, starts
    filled = np.asarray(pc.greater(pc.binary_length(words), 0))
    if filled.all():
        return words, starts
    kept = np.r_[0, np.cumsum(filled)]
    return words.filter(pa.array(filled)), kept[starts]


def spaced_words(column: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    texts = texts_of(column)
    return split(_translate(texts, LOWER) if lower else texts)


def plain_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split(_translate(texts_of(column), PLAIN))


# --- hashes ------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit values in order."""
    with np.errstate(over="ignore"):
        return mix(mix(a) * _MULTIPLIER + np.asarray(b).astype(np.uint64) + np.uint64(1))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes and length.

    Powers of an odd number are invertible modulo 2^64, so differences of one running sum over all bytes
    give the polynomial hash of every word at once.
    """
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words) or offsets[-1] == offsets[0]:
        return mix(np.zeros(len(words), np.uint64))
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    values = mix(np.arange(1, 257, dtype=np.uint64))
    with np.errstate(over="ignore"):
        powers = _powers(_MULTIPLIER, len(raw) + 1)
        running = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * powers[:-1], out=running[1:])
        inverse = _powers(np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)), len(raw) + 1)
        sums = (running[ends[1:]] - running[ends[:-1]]) * inverse[ends[:-1]]
        return mix(sums + np.diff(ends).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within their text, and the text of each run.

    A text of fewer words, but not none, gives one run: all of its words.
    """
    lengths = np.diff(starts)
    runs = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), runs)
    first = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + starts[:-1][owner]
    out = np.zeros(len(first), np.uint64)
    for i in range(size):
        at = first + i
        inside = at < starts[1:][owner]
        step = pair_hash(out, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else out)
        out = np.where(inside, step, out)
    return out, owner

"""Removal of repeated word windows by level-wise doubling.

Texts are packed once into blocks, compressed, one row each. Level 1 looks at short windows, and of those
only at the ones that are the smallest by hash among all short windows of some full window: equal full
windows share that one, so no repeat is missed. What is repeated there is extended to windows of about
twice the length, and what is repeated there to the full window.

At each level a block sends every distinct hash of its open windows once, cut by ranges of the hash and
packed, with a bit that says whether the block itself repeats it; a range of hashes is one group, counts
them and returns one bit per hash. So a hot passage is one value per block, and what moves is 8 bytes per
open window and a bit back. A block replays the levels before from its bits. Groups grow in number with
the words. Blocks are shuffled once, into a bucketed table, so that bits come to the blocks and not the
other way round. ``docs`` has to give the same rows in the same order when a lost task is run again, as
stored tables do.

Windows are told apart by 64-bit hashes. Defined results: a null or empty text has no words and keeps none;
texts of fewer words than the window keep all; equal rows repeat each other, whatever their ids; every row
of the input has a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.tables import pack_fields, partitions, unpack_fields
from topicloom.llm.text import pair_hash, split, steps, texts_of, word_hashes
from topicloom.session import RunFolder

WINDOW = 35
LEVELS = 3
# Words for each group that counts hashes.
GROUP_WORDS = 4 << 20
# Spark's own limit for the buckets of a table.
MOST_BUCKETS = 100_000


def lengths(window: int) -> tuple[int, int]:
    """Lengths of the first two levels; two overlapping windows of one make one of the next."""
    half = (window + 1) // 2
    return (half + 1) // 2, half


def _join(x: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of the windows that two windows ``gap`` words apart cover together."""
    return pair_hash(x[: max(len(x) - gap, 0)], x[gap:]) if gap else x


def _slide(x: np.ndarray, width: int, what) -> np.ndarray:
    """``what`` over every stretch of ``width`` values, by stretches of twice the width each time."""
    have = 1
    while have < width:
        gap = min(have, width - have)
        x = what(x[: max(len(x) - gap, 0)], x[gap:])
        have += gap
    return x


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of ``x`` the sorted array ``known`` holds."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _group(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Group of each hash: equal ranges, so that sorted hashes have sorted groups."""
    return ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _repeated(values: np.ndarray, bits: dict[int, bytes], groups: int) -> np.ndarray:
    """Of a block's candidate hashes those, sorted, that their groups found repeated."""
    distinct = np.unique(values)
    edges = np.searchsorted(_group(distinct, groups), np.array(list(bits), np.int64)[:, None] + np.array([0, 1]))
    flags = np.zeros(len(distinct), bool)
    for (begin, end), mask in zip(edges.tolist(), bits.values()):
        flags[begin:end] = np.unpackbits(np.frombuffer(mask, np.uint8), count=end - begin)
    return distinct[flags]


def trace(
    hashes: np.ndarray, starts: np.ndarray, window: int, done: list[dict[int, bytes]], groups: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which full windows of a block are open after the levels ``done``, and the hashes the next one counts."""
    short, half = lengths(window)
    n, rest, width = len(hashes), window - half, window - short + 1
    if n < window:
        return np.zeros(0, bool), np.zeros(0, np.uint64)
    ends = np.repeat(starts[1:], np.diff(starts))
    full = np.arange(n - window + 1)
    open_ = full + window <= ends[full]

    first, have = hashes, 1
    while have < short:
        gap = min(have, short - have)
        first, have = _join(first, gap), have + gap
    least = _slide(first, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    peak = _slide(np.r_[edge, np.where(open_, least, np.uint64(0)), edge], width, np.maximum)
    values = first[first == peak]
    if not done:
        return open_, values
    open_[open_] = _among(least[open_], _repeated(values, done[0], groups))

    second = _join(first, half - short)
    wanted = np.zeros(len(second), bool)
    wanted[: len(full)] |= open_
    wanted[rest:] |= open_
    values = second[wanted]
    if len(done) == 1:
        return open_, values
    wanted[wanted] = _among(values, _repeated(values, done[1], groups))
    open_ &= wanted[: len(full)] & wanted[rest:]

    values = _join(second, rest)[open_]
    if len(done) > 2:
        open_[open_] = _among(values, _repeated(values, done[2], groups))
    return open_, values


def _count(table: pa.Table) -> pa.Table:
    """For each block of a group one bit per hash: is it repeated anywhere."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    sizes = [len(x) for x in hashes]
    more = [np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table["more"].to_pylist(), sizes)]
    _, where, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    often = (n > 1) | (np.bincount(where, np.concatenate(more)) > 0)
    parts = np.split(often[where], np.cumsum(sizes)[:-1])
    some = [i for i, x in enumerate(parts) if x.any()]
    kept = table.select(["block", "part"]).take(pa.array(some, pa.int64()))
    return kept.append_column("bits", pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept`` (the text that is left)."""
    spark = docs.sparkSession
    run = RunFolder(spark, "repeats")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def to_blocks(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in steps(batch, "text"):
                texts = texts_of(part["text"])
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = texts.buffers()[2]
                raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
                ids = np.asarray(pc.fill_null(part["doc_id"], 0))
                none = np.asarray(pc.is_null(part["doc_id"])).astype(np.uint8)
                yield pa.record_batch(
                    {
                        "block": pa.array([task << 32 | n], pa.int64()),
                        "words": pa.array([len(split(texts)[0])], pa.int64()),
                        "content": pa.array([pack_fields(ids, none, offsets - offsets[0], raw)], pa.binary()),
                    }
                )
                n += 1

    buckets = max(partitions(spark), min(rows.rdd.getNumPartitions(), MOST_BUCKETS))
    packed = rows.mapInArrow(to_blocks, "block bigint, words bigint, content binary").repartition(buckets, "block")
    name = f"blocks_{uuid.uuid4().hex}"
    packed.write.bucketBy(buckets, "block").option("path", f"{run.path}/blocks").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.agg(F.sum("words")).first()[0] or 0
    groups = max(-(-total // GROUP_WORDS), partitions(spark))

    def opened(batches) -> Iterator[tuple]:
        """Blocks one by one: number, ids, words, where texts start, and the bits of each level."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, none, offsets, raw = unpack_fields(batch["content"][i].as_py(), np.int64, np.uint8, np.int64, np.uint8)
                texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(raw.tobytes()))
                words, starts = split(texts)
                done = [{} for _ in range(LEVELS)]
                for x in batch["levels"][i].as_py() or []:
                    done[x["level"]][x["part"]] = x["bits"]
                yield batch["block"][i].as_py(), pa.array(ids, mask=none.astype(bool)), words, starts, done

    def send(level: int):
        def candidates(batches):
            for block, _, words, starts, done in opened(batches):
                values = trace(word_hashes(words), starts, window, done[:level], groups)[1]
                hashes, n = np.unique(values, return_counts=True)
                part = _group(hashes, groups)
                begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
                cuts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(part)]))
                yield pa.record_batch(
                    {
                        "block": pa.array([block] * len(cuts), pa.int64()),
                        "part": pa.array(part[begin].astype(np.int32)),
                        "hashes": pa.array([hashes[a:b].tobytes() for a, b in cuts], pa.binary()),
                        "more": pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in cuts], pa.binary()),
                    }
                )

        return candidates

    def keep(batches):
        for _, ids, words, starts, done in opened(batches):
            open_ = trace(word_hashes(words), starts, window, done, groups)[0]
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(open_)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            free = np.cumsum(cover[:-1]) == 0
            ends = np.r_[0, np.cumsum(free)][starts]
            lists = pa.LargeListArray.from_arrays(pa.array(ends), words.filter(pa.array(free)))
            kept = pc.binary_join(lists, pa.scalar(" ", words.type))
            yield pa.record_batch(
                {
                    "doc_id": ids,
                    "n_words": pa.array(np.diff(starts)),
                    "n_removed": pa.array(np.diff(starts) - np.diff(ends)),
                    "kept_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in kept], pa.string()),
                    "kept": kept.cast(pa.string()),
                }
            )

    def with_bits(found: list[DataFrame]) -> DataFrame:
        """The blocks with the bits of the levels so far; the bits of a block are fewer than its words."""
        if not found:
            return blocks.select("block", "content", F.lit(None).cast(levels).alias("levels"))
        bits = found[0]
        for more in found[1:]:
            bits = bits.unionByName(more)
        own = bits.groupBy("block").agg(F.collect_list(F.struct("level", "part", "bits")).alias("levels"))
        return blocks.join(own, "block", "left").select("block", "content", "levels")

    levels = "array<struct<level: int, part: int, bits: binary>>"
    found: list[DataFrame] = []
    for level in range(LEVELS):
        sent = with_bits(found).mapInArrow(send(level), "block bigint, part int, hashes binary, more binary")
        counted = sent.groupBy("part").applyInArrow(_count, "block bigint, part int, bits binary")
        found.append(run.write(counted.withColumn("level", F.lit(level)), f"level-{level}"))
    return with_bits(found).mapInArrow(
        keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    )

"""N-gram Jaccard join: size-banded tiles with bitmap signatures, then exact intersection.

Documents are sets of word shingles. Equal sets become one class, known by a number made of its set. A tile holds
the classes that share one shingle of their prefix (the first in a fixed order of all shingles, as many as a pair over
the threshold cannot all miss); in a tile, sorted by size, only the band of sizes within the threshold is compared. The
bits that differ between two bitmaps bound the overlap from above; only for pairs that pass are the shingles themselves
computed again, moved and intersected exactly.

Any one order of the shingles gives the same links. Here common shingles stand last, so that a line which a fixed share
of all documents holds is in the prefix of those only that hold little else, and its tile does not grow with the square
of the input. How common a shingle is, is estimated from some of the texts; the others are by hash.

Most shingles stand in one class only and never become rows: a block of classes sends its prefix hashes packed, by
hash range, one entry for each hash however many of its classes hold it, and a range returns the entries of
hashes that several blocks hold.

Links of a tile's first class are tried first and what they connect is labelled, so a group of near
copies is joined by a star; after that only pairs between different labels are compared, first those that would
join all labels, then, in the tiles that had others, whatever is still undecided. Big tiles are compared chunk by
chunk in tasks of their own, small ones many at a time.

Defined results: texts with fewer words than a shingle are one shingle, null and empty texts link with
nothing; rows with the same id are linked by their own texts only; a component is named by the smallest id
on any of its rows; null ids have no component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import components
from topicloom.llm.tables import pack, pack_fields, partitions, unpack, unpack_fields
from topicloom.llm.text import mix, shingle_hashes, spaced_words, steps, word_hashes
from topicloom.session import RunFolder

SIZE = 5
PERCENT = 80
CHUNK = 1024
STARS = 3
# One text in so many tells which shingles are common: those that this many of these texts hold, and how many of them
# may be listed to every task.
ESTIMATED = 64
OFTEN = 4
COMMON = 1 << 20
# Classes in a block, and prefix hashes that one range should hold.
BLOCK = 4096
RANGE = 1_000_000
# Bytes of text whose shingles are held at once.
STEP = 1 << 20
# Ids of texts to read again that may be broadcast.
LISTED = 1_000_000
# Tiles of up to so many classes are compared many at a time.
SMALL = 128
# Tiles by which a class tells, at the last comparison, whether it has met another class before.
MET = 32


def _sets(part: pa.RecordBatch, size: int):
    words, starts = spaced_words(part["text"], True)
    hashes, owner = shingle_hashes(word_hashes(words), starts, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)]
    hashes, owner = hashes[new], owner[new]
    return np.split(hashes, np.cumsum(np.bincount(owner, minlength=part.num_rows))[:-1])


class _Order:
    """The order of all shingles: by how common they are, then by hash."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.levels = hashes[order], levels[order]
        # most shingles are not listed, which one look at their last bits tells
        self.mask = np.uint64((1 << max(16, (8 * len(hashes)).bit_length())) - 1)
        self.listed = np.zeros(int(self.mask) + 1, bool)
        self.listed[(self.hashes & self.mask).astype(np.int64)] = True

    def level(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint8)
        some = np.flatnonzero(self.listed[(values & self.mask).astype(np.int64)])
        place = np.searchsorted(self.hashes, values[some])
        found = place < len(self.hashes)
        found[found] = self.hashes[place[found]] == values[some[found]]
        out[some[found]] = self.levels[place[found]]
        return out

    def first(self, sets: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The first ``counts[i]`` members of each sorted set."""
        if not len(self.hashes) or not len(sets):
            return [s[:k] for s, k in zip(sets, counts)]
        level = self.level(np.concatenate(sets))
        out, end = [], 0
        for s, k in zip(sets, counts):
            begin, end = end, end + len(s)
            mine = level[begin:end]
            out.append(s[np.argsort(mine, kind="stable")[:k]] if mine[:k].any() else s[:k])
        return out


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts seem to hold, and the logarithm of how many; at most COMMON in all."""
    ranges = partitions(rows.sparkSession)

    def send(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                h = np.sort(np.concatenate([np.zeros(0, np.uint64), *_sets(part, size)]))
                yield from _by_range(h, ranges)

    def count(pieces: pa.Table) -> pa.Table:
        h = np.concatenate([np.cumsum(unpack(p, np.uint64), dtype=np.uint64) for p in pieces["piece"].to_pylist()])
        h, n = np.unique(h, return_counts=True)
        often = np.flatnonzero(n >= OFTEN)
        often = often[np.argsort(-n[often], kind="stable")[: -(-COMMON // ranges)]]
        level = np.log2(n[often]).astype(np.uint8)
        return pa.table({"h": pa.array([h[often].tobytes()], pa.binary()), "level": pa.array([level.tobytes()], pa.binary())})

    # copies of a text count once
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(ESTIMATED)) == 0).select("text").distinct()
    found = some.mapInArrow(send, "place int, piece binary").groupBy("place").applyInArrow(count, "h binary, level binary").collect()
    return tuple(np.frombuffer(b"".join(bytes(r[c]) for r in found), t) for c, t in (("h", "<u8"), ("level", "u1")))


def _places(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` ranges of equal width begins among sorted hashes, and the end of the last."""
    place = ((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))


def _by_range(values: np.ndarray, ranges: int):
    """Sorted hashes packed, a row for each range that has some."""
    edge = _places(values, ranges)
    some = np.flatnonzero(np.diff(edge)).tolist()
    pieces = [pack(_gaps(values[edge[r] : edge[r + 1]])) for r in some]
    yield pa.record_batch({"place": pa.array(some, pa.int32()), "piece": pa.array(pieces, pa.binary())})


def _bitmap(values: np.ndarray) -> bytes:
    """Parity of the members that fall on each bit; a bit or two for each member, a power of two.

    Unrelated sets of n members then differ in about half of the bits, far more than the n / 9 or so that two sets
    over the threshold may have alone, so wider maps would reject little more and be moved with every tile.
    """
    bits = max(1 << (len(values) - 1).bit_length(), 64)
    ones = np.bincount((mix(values) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def _allowed(bits: list[bytes], i: np.ndarray, j: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bits leave the sets ``i[k]`` and ``j[k]`` a chance to be over the threshold."""
    na, nb = n[i], n[j]
    out = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    wide = np.array([len(b) for b in bits], np.int64)
    shape = wide[i] << 32 | wide[j]
    for one in np.unique(shape[out]).tolist():
        pairs = np.flatnonzero(out & (shape == one))
        width = min(one >> 32, one & 0xFFFFFFFF)
        for at in np.split(pairs, range(4096, len(pairs), 4096)):
            a, b = (np.frombuffer(b"".join(bits[k] for k in side[at]), np.uint8).reshape(len(at), -1, width) for side in (i, j))
            differ = np.bitwise_count(np.bitwise_xor.reduce(a, axis=1) ^ np.bitwise_xor.reduce(b, axis=1)).sum(axis=1, dtype=np.int64)
            out[at] = (na[at] + nb[at] - differ) // 2 * (100 + percent) >= percent * (na[at] + nb[at])
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    """Sorted values as first value and differences, which compress better."""
    return np.diff(values, prepend=np.zeros(1, values.dtype))


def _shared_in_block(hashes: np.ndarray, owner: np.ndarray):
    """Splits the (hash, class) entries of a block: those of hashes met twice here, and one entry for each hash."""
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(hashes)])
    again = np.repeat(count > 1, count)
    return (hashes[again], owner[again]), (hashes[first], owner[first], count > 1)


def _fold(bitmap: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer bits: parities add up, since the bit is the hash modulo a power of two."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, width), axis=0)


def _candidates(n: np.ndarray, bitmaps: list[bytes], label: np.ndarray, cut: np.ndarray, percent: int):
    """Pairs of different labels, and of different chunks if there are two, that sizes and bits allow."""
    out = []
    maps = [np.frombuffer(b, np.uint8) for b in bitmaps]
    cache: dict[int, np.ndarray] = {}
    span, two = np.arange(len(n)), cut.min() != cut.max()
    for i in range(len(n)):
        near = span[(n[span] * 100 >= n[i] * percent) & ((n[span] > n[i]) | ((n[span] == n[i]) & (span > i)))]
        near = near[(n[near] * percent <= n[i] * 100) & (label[near] != label[i])]
        if two:
            near = near[cut[near] != cut[i]]
        if not len(near):
            continue
        width = len(maps[i])
        if width not in cache:
            cache[width] = np.zeros((len(n), width), np.uint8)
            for j in span:
                if len(maps[j]) >= width:
                    cache[width][j] = _fold(maps[j], width)
        differ = np.bitwise_count(cache[width][near] ^ maps[i]).sum(1).astype(np.int64)
        most = (n[i] + n[near] - differ) // 2
        near = near[most * (100 + percent) >= percent * (n[i] + n[near])]
        out += [(i, j) for j in near.tolist()]
    return out


def _earlier(met: list[list[int]], h) -> list[set[int]]:
    """The tiles of each class that come before the tile of its row."""
    return [{x for x in tiles if x < at} for tiles, at in zip(met, h)]


def _compare(parts: list, percent: int, forest: bool, h: int) -> tuple[list[tuple[int, int]], bool]:
    """Candidate pairs of tile ``h``, or of two chunks of it; as a ``forest`` only those that join labels, and
    whether there were others, else those that are not known to meet in an earlier tile."""
    if not parts:
        return [], False
    cut, n, label, rep = (np.concatenate([p[i] for p in parts]) for i in range(4))
    bits = [b for p in parts for b in p[4]]
    pairs = _candidates(n, bits, label, cut, percent)
    if not forest:
        met = _earlier([tiles for p in parts for tiles in p[5]], [h] * len(n))
        pairs = [(i, j) for i, j in pairs if met[i].isdisjoint(met[j])]
    chosen = _joining([(label[i], label[j]) for i, j in pairs], {}) if forest else [True] * len(pairs)
    out = [(int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))) for (i, j), c in zip(pairs, chosen) if c]
    return out, len(out) < len(pairs)


def _joining(labels: list[tuple[int, int]], top: dict[int, int]) -> list[bool]:
    """For each pair of labels whether it joins what earlier pairs have not joined yet."""
    out = []
    for a, b in labels:
        x, y = _root(top, int(a)), _root(top, int(b))
        out.append(x != y)
        top[x] = y
    return out


def _compare_small(tiles: list[tuple[int, int]], columns, two: np.ndarray, percent: int, forest: bool, h: np.ndarray):
    """Candidate pairs of many tiles, each ``[begin, end)`` of the columns, and a row of every tile with others left."""
    cut, n, label, rep, bits = columns[:5]
    span = np.array(tiles, np.int64).reshape(-1, 2)
    size, left, right = span[:, 1] - span[:, 0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size).tolist():
        i, j = np.triu_indices(m, 1)
        begin = span[size == m, :1]
        left.append((begin + i).ravel())
        right.append((begin + j).ravel())
    i, j = np.concatenate(left), np.concatenate(right)
    fits = (label[i] != label[j]) & (n[i] * 100 >= n[j] * percent) & (n[j] * 100 >= n[i] * percent)
    fits &= ~two[i] | (cut[i] != cut[j])
    i, j = i[fits], j[fits]
    # a pair may share many tiles; it is tried once, in the first of them
    low, high = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
    order = np.lexsort((h[i], high, low))
    once = order[np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])][: len(order)]]
    good = once[_allowed(bits, i[once], j[once], n, percent)].tolist()
    if not forest:
        met = _earlier(columns[5], h.tolist())
        good = [k for k in good if met[i[k]].isdisjoint(met[j[k]])]
    chosen = _joining([(label[i[k]], label[j[k]]) for k in good], {}) if forest else [True] * len(good)
    pairs = [(int(low[k]), int(high[k])) for k, c in zip(good, chosen) if c]
    return pairs, [int(i[k]) for k, c in zip(good, chosen) if not c]


def _root(top: dict[int, int], x: int) -> int:
    top.setdefault(x, x)
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def _pairs(rows: list[tuple[int, int]], left: set[int]) -> pa.RecordBatch:
    """Rows ``a, b`` of pairs and rows ``h`` of tiles that have others left."""
    at = np.array(sorted(set(rows)), np.int64).reshape(-1, 2)
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.record_batch(
        {
            "a": pa.concat_arrays([pa.array(at[:, 0].copy()), none(len(left))]),
            "b": pa.concat_arrays([pa.array(at[:, 1].copy()), none(len(left))]),
            "h": pa.concat_arrays([none(len(at)), pa.array(sorted(left), pa.int64())]),
        }
    )


def shingle_components(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    spark = docs.sparkSession
    run = RunFolder(spark, "jaccard", passing=True)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    number = F.xxhash64("n", "f1", "f2").alias("cid")

    def sums(sets):
        """Two hashes of each set that do not depend on the order of its members."""
        f1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        f2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(7))).astype(np.int64)) if len(s) else 0 for s in sets]
        return {"n": pa.array([len(s) for s in sets], pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64())}

    listed = spark.sparkContext.broadcast(_common(rows, size))

    def describe(batches):
        order = _Order(*listed.value)
        for batch in batches:
            for part in steps(batch, "text", STEP):
                sets = _sets(part, size)
                least = [len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0 for s in sets]
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"],
                        **sums(sets),
                        "bits": pa.array([_bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
                        # scrambled, as the first by hash are the smallest and would meet in few ranges
                        "prefix": pa.array([pack(_gaps(np.sort(mix(s)))) for s in order.first(sets, least)], pa.binary()),
                    }
                )

    described = rows.mapInArrow(describe, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bits binary, prefix binary")
    described = run.write(described.select("doc_id", "n", number, "bits", "prefix"), "sets")
    sound = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = run.write(sound.dropDuplicates(["cid"]), "classes")
    held = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    ranges = max(1, -(-int(held) // RANGE))

    def send(batches):
        """Tile rows of hashes shared inside a block, and its packed entries by range."""
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cid, n = np.asarray(part["cid"]), np.asarray(part["n"])
                sets = [np.cumsum(unpack(p, np.uint64), dtype=np.uint64) for p in part["prefix"].to_pylist()]
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                (h, own), (one, first, local) = _shared_in_block(np.concatenate(sets), owner)
                yield _tile_rows(h, cid[own], n[own])
                # ranges of equal width of the hash, so that one is a slice of the sorted entries
                edge = _places(one, ranges)
                for r in np.flatnonzero(np.diff(edge)).tolist():
                    cut = slice(edge[r], edge[r + 1])
                    names, index = np.unique(first[cut], return_inverse=True)
                    piece = pack_fields(_gaps(one[cut]), index.astype(np.uint16), cid[names], n[names], local[cut])
                    yield pa.record_batch(
                        {
                            "h": pa.nulls(1, pa.int64()),
                            "cid": pa.nulls(1, pa.int64()),
                            "n": pa.nulls(1, pa.int64()),
                            "place": pa.array([r], pa.int32()),
                            "piece": pa.array([piece], pa.binary()),
                        }
                    )

    def meet(pieces: pa.Table) -> pa.Table:
        """Tile rows of the entries that are not alone with their hash, but for those their block has already."""
        h, index, local, names, sizes = [], [], [], [], []
        for piece in pieces["piece"].to_pylist():
            gaps, at, cid, n, own = unpack_fields(piece, np.uint64, np.uint16, np.int64, np.int64, bool)
            for held, part in zip((h, index, local, names, sizes), (np.cumsum(gaps, dtype=np.uint64), at, own, cid, n)):
                held.append(part)
        # a class of a piece is told by its place among those of all pieces, until it is known which entries meet
        starts, lengths = np.cumsum([0] + [len(x) for x in names[:-1]]), [len(x) for x in h]
        h = np.concatenate(h)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[first, len(h)])
        wanted = np.flatnonzero(np.repeat(count > 1, count) & ~np.concatenate(local)[order])
        h, order = h[wanted], order[wanted]
        at = np.concatenate(index)[order] + starts[np.searchsorted(np.cumsum(lengths), order, "right")]
        cid, n = np.concatenate(names)[at], np.concatenate(sizes)[at]
        return pa.table({"h": pa.array(h.view(np.int64)), "cid": pa.array(cid), "n": pa.array(n)})

    sent = run.write(
        classes.select("cid", "n", "prefix").mapInArrow(send, "h bigint, cid bigint, n bigint, place int, piece binary"), "sent"
    )
    pieces = sent.where("place IS NOT NULL").select("place", "piece")
    tiles = run.write(
        sent.where("place IS NULL").select("h", "cid", "n").unionAll(
            pieces.groupBy("place").applyInArrow(meet, "h bigint, cid bigint, n bigint")
        ),
        "tiles",
    )
    run.drop("sent")
    signatures = classes.select("cid", "n", "bits")

    def content(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                sets = _sets(part, size)
                members = pa.array([pack(_gaps(s)) for s in sets], pa.binary())
                yield pa.record_batch({"doc_id": part["doc_id"], **sums(sets), "members": members})

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch["ma"].to_pylist(), batch["mb"].to_pylist()):
                x, y = (np.cumsum(unpack(m, np.uint64), dtype=np.uint64) for m in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs; the members of classes that no pair names are never computed."""
        pairs = run.write(pairs.distinct(), f"{name}-pairs")
        named = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct()
        ids = run.write(named.join(classes.select("cid", "doc_id"), "cid").select("doc_id").distinct(), f"{name}-ids")
        # a list of checked size goes to the texts; beyond it the texts are shuffled to the list
        texts = rows.join(F.broadcast(ids) if ids.count() <= LISTED else ids, "doc_id", "left_semi")
        found = texts.mapInArrow(content, "doc_id bigint, n bigint, f1 bigint, f2 bigint, members binary")
        members = run.write(
            found.select(number, "members").join(named, "cid", "left_semi").dropDuplicates(["cid"]), f"{name}-members"
        )
        left = members.select(F.col("cid").alias("a"), F.col("members").alias("ma"))
        right = members.select(F.col("cid").alias("b"), F.col("members").alias("mb"))
        links = run.write(pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(verify, "a bigint, b bigint"), name)
        run.drop(f"{name}-members")
        run.drop(f"{name}-pairs")
        return links

    def likely(batches):
        for batch in batches:
            rows = np.arange(batch.num_rows)
            n = np.r_[np.asarray(batch["na"]), np.asarray(batch["nb"])]
            good = _allowed(batch["ba"].to_pylist() + batch["bb"].to_pylist(), rows, rows + len(rows), n, percent)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # stars: in every tile the class that a keyed hash puts first, and all others of the tile within its
    # size band; each class takes part through its smallest shared shingles only
    head = tiles.groupBy("cid", "n").agg(F.slice(F.array_sort(F.collect_list("h")), 1, STARS).alias("hs"))
    head = head.select("cid", "n", F.explode("hs").alias("h"))
    centre = head.groupBy("h").agg(F.min_by(F.struct("cid", "n"), F.xxhash64("cid")).alias("c"))
    band = f"cid <> c.cid AND n * 100 >= c.n * {percent} AND c.n * 100 >= n * {percent}"
    stars = head.join(centre, "h").where(band)
    stars = stars.select(F.least("c.cid", "cid").alias("a"), F.greatest("c.cid", "cid").alias("b")).distinct()
    bits_of = lambda x: signatures.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    links = verified(stars.join(bits_of("a"), "a").join(bits_of("b"), "b").mapInArrow(likely, "a bigint, b bigint"), "stars")
    label = components(links, run, "labels")

    def open_tiles(tiles: DataFrame, label: DataFrame, forest: bool) -> DataFrame:
        """Rows of the tiles that hold different labels, one row for each chunk pair that they take part in.

        Near copies share most of their prefixes, so many tiles hold the same classes (told by their number and two
        hashes): one of them is compared for all. Other tiles overlap, so but for a ``forest`` a class brings the
        first of its tiles: a pair that has one of them in common before a tile is left to that one.
        """
        labelled = tiles.join(label.withColumnRenamed("id", "cid"), "cid", "left").select(
            "h", F.col("cid").alias("rep"), "n", F.coalesce("label", "cid").alias("label")
        )
        sizes = labelled.groupBy("h").agg(
            F.count("*").alias("m"),
            F.min("label").alias("x"),
            F.max("label").alias("y"),
            *[F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"s{i}") for i in range(2)],
        )
        chosen = sizes.where("x <> y").groupBy("m", "x", "y", "s0", "s1").agg(F.min("h").alias("h"))
        placed = labelled.join(chosen.select("h", F.ceil(F.col("m") / CHUNK).cast("int").alias("cuts")), "h").withColumn(
            "cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
        )
        spread = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        tasks = spread.select("h", "rep", "n", "label", "cut", F.least("cut", "with").alias("c1"), F.greatest("cut", "with").alias("c2"))
        with_bits = tasks.join(signatures.select(F.col("cid").alias("rep"), "bits"), "rep")
        if not forest:
            met = placed.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("h")), 1, MET).alias("met"))
            with_bits = with_bits.join(met, "rep")
        return with_bits.repartition(partitions(spark), "h", "c1", "c2").sortWithinPartitions("h", "c1", "c2")

    def compare(batches, forest):
        """Tiles one after another; rows arrive sorted by tile, and a tile may go on in the next batch."""
        kept, at = [], None
        for batch in batches:
            h, c1, c2 = (np.asarray(batch[c]) for c in ("h", "c1", "c2"))
            new = np.r_[True, (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]
            begins = np.flatnonzero(new)
            ends = np.r_[begins[1:], batch.num_rows]
            columns = [np.asarray(batch[c]) for c in ("cut", "n", "label", "rep")] + [batch["bits"].to_pylist()]
            columns += [] if forest else [batch["met"].to_pylist()]
            out, left, small = [], set(), []
            for t, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
                tile = int(h[begin]), int(c1[begin]), int(c2[begin])
                if tile != at:
                    found, more = _compare(kept, percent, forest, at and at[0])
                    out += found
                    left |= {at[0]} if more else set()
                    kept, at = [], None
                    if t + 1 < len(begins) and end - begin <= SMALL:  # it ends in this batch
                        small.append((begin, end))
                        continue
                kept, at = [*kept, [c[begin:end] for c in columns]], tile
            found, others = _compare_small(small, columns, c1 != c2, percent, forest, h)
            yield _pairs(out + found, left | {int(h[row]) for row in others})
        found, more = _compare(kept, percent, forest, at and at[0])
        yield _pairs(found, {at[0]} if more else set())

    # first what would join the labels of a tile if all of it were links, then whatever is left undecided
    undecided = tiles
    for name, forest in (("forest", True), ("rest", False)):
        compared = open_tiles(undecided, label, forest).mapInArrow(lambda b, f=forest: compare(b, f), "a bigint, b bigint, h bigint")
        compared = run.write(compared, f"{name}-compared")
        links = links.unionByName(verified(compared.where("h IS NULL").select("a", "b"), name))
        label = components(links, run, f"{name}-joined")
        undecided = tiles.join(compared.where("h IS NOT NULL").select("h").distinct(), "h", "left_semi")
    smallest = sound.groupBy("cid").agg(F.min("doc_id").alias("first"))
    labelled = smallest.join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    labelled = run.write(labelled, "labelled")
    names = labelled.groupBy("label").agg(F.min("first").alias("component"))
    named = labelled.join(names, "label").select("cid", "component")
    return described.select("doc_id", "n", "cid").join(named, "cid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def _tile_rows(h: np.ndarray, cid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "h": pa.array(h.view(np.int64)),
            "cid": pa.array(cid),
            "n": pa.array(n),
            "place": pa.nulls(len(h), pa.int32()),
            "piece": pa.nulls(len(h), pa.binary()),
        }
    )

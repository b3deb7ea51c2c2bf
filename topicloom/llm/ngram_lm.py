"""Language-model scores from an Elias-Fano n-gram trie.

Every word, pair and triple of the training texts counts, however rare, so the model grows with them. No
task holds all of it: words and pairs are dealt to shards by their hash, and a triple goes with the pair of its
first two words. A shard adds up what blocks of texts send, stores its part of the trie in the model's folder
and answers from it. :func:`train` leaves a model that :meth:`NgramModel.score` applies to any other texts;
:func:`train_and_score` answers the blocks it learnt from in the same pass.

With c the counts, m the mass and f the smoothed word frequency, and p(w) = f(w) for the shortest context,
``p(w | v) = s(v w) + r(v) f(w)`` and ``p(w | u v) = s(u v w) + r(u v) p(w | v)``. A node stores its share
``s(v w) = c(v w) / (c(v) + m)``, and ``r``, what its context leaves to the shorter one, is ``m / (c(v) + m)``:
every occurrence of a context has a word after it, so the words' probabilities add up to 1. The first word
of a text has the end token before it and no longer context.

Levels are memory-mapped files of Elias-Fano sequences: children of a node are words made monotone by
adding the last value of the node before, pointers are monotone as they are, and a word is found by successor
search relative to its context. Shares and rests are quantised: 16 bits into a codebook for each level of a shard.
A level of no more than 65,535 different values is exact; else neighbours share a code, and the largest error, in
log10, stands beside the shard (``NgramModel.error``).

Defined results: null and empty texts are one end token; texts with a null id are trained on and not
held out; repeated rows count as often as they occur; other columns are ignored; a model of no texts gives every
token the frequency of an unseen one. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.tables import bucket_count, bucketed, pack, pack_fields, partitions, remainder, unpack, unpack_fields
from topicloom.llm.text import mix, spaced_words, steps, word_hashes
from topicloom.session import RunFolder

MASS = 20.0
FLOOR = 0.1
BLOCK_BYTES = 3 << 20
SHARD_TOKENS = 300_000
# Rows that go back to Spark at once.
REPLIES = 16
CODES = (1 << 16) - 1  # the code 0 is left for what is absent
END = np.uint64(1)


# --- Elias-Fano --------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, over a memory-mapped buffer."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[np.ndarray, ...]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max((top // max(n, 1)).bit_length() - 1, 0)
        head = np.array([n, low], np.int64)
        bits = np.empty((n, low), np.uint8)
        for i in range(low):
            bits[:, i] = (values >> i) & 1
        lows = np.packbits(bits.ravel(), bitorder="little")
        unary = np.zeros(n + (top >> low) + 2, np.uint8)
        unary[(values >> low) + np.arange(n)] = 1
        highs = np.packbits(np.pad(unary, (0, -len(unary) % 64)), bitorder="little").view(np.uint64)
        ranks = np.r_[0, np.cumsum(np.bitwise_count(highs).astype(np.int64))]
        return head, np.r_[lows, np.zeros(8, np.uint8)], highs, ranks.astype(np.int64)

    def __init__(self, head, lows, highs, ranks):
        self.n, self.low = int(head[0]), int(head[1])
        self.highs, self.ranks = highs, ranks
        # eight bytes from every byte on, so that up to 57 low bits are read at once
        self.words = np.lib.stride_tricks.as_strided(lows[:8].view(np.uint64), (len(lows) - 7,), (1,))

        self.zeros = np.arange(len(ranks)) * 64 - ranks

    @staticmethod
    def _select(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Place of the one in each word that has ``left`` ones before it."""
        place = np.zeros(len(left), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << half) - 1)
            ones = np.bitwise_count((bits >> place.astype(np.uint64)) & mask).astype(np.int64)
            right = left >= ones
            left = left - np.where(right, ones, 0)
            place += np.where(right, half, 0)
        return place

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        word = np.searchsorted(self.ranks, at, "right") - 1
        high = word * 64 + self._select(self.highs[word], at - self.ranks[word]) - at
        begin = at * self.low
        low = (self.words[begin >> 3] >> (begin & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.low) - 1)
        return (high << self.low) | low

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many elements have high bits of at most ``high``: the ones before that zero."""
        out = np.where(high < 0, 0, self.n)
        ask = np.flatnonzero((high >= 0) & (high < self.zeros[-1]))
        word = np.searchsorted(self.zeros, high[ask], "right") - 1
        out[ask] = word * 64 + self._select(~self.highs[word], high[ask] - self.zeros[word]) - high[ask]
        return out

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first element >= value in [begin, end): among those that share its high bits."""
        high = value >> self.low
        left, right = np.clip(self._below(high - 1), begin, end), np.clip(self._below(high), begin, end)
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                return left
            middle = (left[open_] + right[open_]) // 2
            less = self[middle] < value[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]


def quantise(values: np.ndarray, size: int = CODES) -> tuple[np.ndarray, np.ndarray, float]:
    """Codebook, code of each positive value, and the largest error in log10."""
    held, at = np.unique(values, return_inverse=True)
    if len(held) <= size:
        return held, at.astype(np.uint16), 0.0
    group = np.arange(len(held)) * size // len(held)
    starts = np.searchsorted(group, np.arange(size))
    low, high = np.log10(held[starts]), np.log10(held[np.r_[starts[1:], len(held)] - 1])
    return 10 ** ((low + high) / 2), group[at].astype(np.uint16), float((high - low).max() / 2)


class Trie:
    """Levels of nodes; level 0 is the words 0..n-1 themselves."""

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], mass: float) -> bytes:
        """``levels``: (parent node, word, count) sorted by parent and word; parents are nodes of the level above."""
        out = [np.sort(words), np.argsort(words, kind="stable").astype(np.int32)]
        above, errors = counts.astype(float), [0.0]
        for parent, word, count in levels:
            n = len(above)
            pointer = np.searchsorted(parent, np.arange(n + 1)).astype(np.int64)
            widest = np.int64(len(words) + 1)
            share, share_of, off = quantise(count / (above[parent] + mass))
            rest, rest_of, off_rest = quantise(1 - np.bincount(parent, count / (above[parent] + mass), minlength=n) if len(parent) else np.ones(n))
            # the node before a range ends at a value of its own: ranges follow each other in one sequence
            filled = np.cumsum(np.diff(pointer) > 0) - 1
            out += [*EliasFano.encode(pointer), *EliasFano.encode(word + filled[parent] * widest)]
            out += [share, share_of, rest, rest_of, filled.astype(np.int32)]
            above = count.astype(float)
            errors += [off, off_rest]
        out.append(np.array([max(errors)]))
        head = np.array([(a.nbytes, np.dtype(a.dtype).num) for a in out], np.int64)
        return np.array([len(out)], np.int64).tobytes() + head.tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in out)

    def __init__(self, data: bytes | np.ndarray):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        mapped = np.memmap(self.file, np.uint8, "r")
        n = int(mapped[:8].view(np.int64)[0])
        head = mapped[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
        kinds = {np.dtype(t).num: t for t in ("u1", "u2", "i4", "i8", "u8", "f4", "f8")}
        kinds[np.dtype(np.int64).num] = kinds[np.dtype("i8").num] = np.int64
        kinds[np.dtype(np.uint64).num] = np.uint64
        parts, at = [], 8 + 16 * n
        for size, kind in head.tolist():
            parts.append(np.asarray(mapped[at : at + size]).view(kinds[kind]))
            at += size + -size % 8
        self.hashes, self.order, self.error = parts[0], parts[1], float(parts[-1][0])
        self.levels = [(EliasFano(*p[:4]), EliasFano(*p[4:8]), *p[8:13]) for p in (parts[i : i + 13] for i in range(2, len(parts) - 1, 13))]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those not held."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1).astype(np.int64)

    def find(self, level: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Child of each node by a word, -1 if absent."""
        pointer, value, *_, filled = self.levels[level]
        child = np.full(len(node), -1, np.int64)
        ask = np.flatnonzero((node >= 0) & (word >= 0))
        if len(ask):
            context = node[ask]
            begin, end = pointer[context], pointer[context + 1]
            target = word[ask] + filled[context].astype(np.int64) * np.int64(len(self.hashes) + 1)
            at = value.find(target, begin, end)
            inside = np.flatnonzero(at < end)
            hit = inside[value[at[inside]] == target[inside]]
            child[ask[hit]] = at[hit]
        return child

    def shares(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Codebook, with 0 for what is absent, and the code of each node below a level."""
        return np.r_[0.0, self.levels[level][2]], self.levels[level][3]

    def rests(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Codebook, with 1 for what is absent, and the code of each context of a level."""
        return np.r_[1.0, self.levels[level][4]], self.levels[level][5]

    def child(self, level: int, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Child node (-1 if absent), its share, and what the context leaves to a shorter one."""
        child = self.find(level, node, word)
        (share, of), (rest, rest_of) = self.shares(level), self.rests(level)
        return child, share[_coded(of, child)], rest[_coded(rest_of, node)]


def _coded(codes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Places in a codebook; -1 is at 0."""
    out, known = np.zeros(len(node), np.uint16), np.flatnonzero(node >= 0)
    out[known] = codes[node[known]] + np.uint16(1)
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    """The lowest bytes of all values, then the next ones: small numbers compress well like that."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.ravel() if len(values) else np.zeros(0, np.uint8)


def _values(planes: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


# --- blocks of texts ---------------------------------------------------------------------------------

_BLOCK = "block bigint, doc_id array<bigint>, tokens bigint, starts binary, codes binary, hashes binary"
_NUMBERED = "block bigint, doc_id array<bigint>, starts binary, codes binary, numbers binary, counts binary"


def _blocks(docs: DataFrame, run: RunFolder, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Texts as numbers into a small dictionary per block, and the buckets they lie in; every text ends in the end token."""

    def encode(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                words, starts = spaced_words(part["text"], True)
                coded = words.dictionary_encode()
                codes = np.asarray(coded.indices).astype(np.int64)
                hashes = word_hashes(coded.dictionary)
                hashes = np.r_[END, np.where(hashes == END, END + END, hashes)]
                count = np.bincount(codes, minlength=len(coded.dictionary))
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(1, len(order) + 1)
                ends = starts[1:] + np.arange(1, len(starts)) - 1
                sequence = np.zeros(len(codes) + part.num_rows, np.int32)
                body = np.ones(len(sequence), bool)
                body[ends] = False
                sequence[body] = rank[codes]
                yield pa.record_batch(
                    {
                        "block": pa.array([(task << 32) + n], pa.int64()),
                        "doc_id": pa.array([part["doc_id"].to_pylist()], pa.list_(pa.int64())),
                        "tokens": pa.array([len(sequence)], pa.int64()),
                        "starts": pa.array([pack(np.r_[0, ends + 1])], pa.binary()),
                        "codes": pa.array([pack(_planes(sequence))], pa.binary()),
                        "hashes": pa.array([pack(np.r_[hashes[:1], hashes[1:][order]])], pa.binary()),
                    }
                )
                n += 1

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    buckets = bucket_count(chosen)
    return bucketed(chosen.mapInArrow(encode, _BLOCK), run, "blocks", "block", buckets), buckets


class _Block:
    def __init__(self, row: dict):
        self.doc_id = row["doc_id"]
        self.starts = unpack(row["starts"], np.int64)
        self.codes = _values(unpack(row["codes"], np.uint8), np.int32)
        self.n = np.diff(self.starts)

    def before(self) -> np.ndarray:
        """The code before each token; the end token stands before a text."""
        before = np.r_[0, self.codes[:-1]][: len(self.codes)]
        before[self.starts[:-1]] = 0
        return before

    def trained(self, fold: int) -> np.ndarray:
        return np.repeat(remainder(self.doc_id, fold) != 0, self.n)


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys by the shard of their hash, the shards that occur, and where each begins in the order."""
    shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    use, starts = np.unique(shard[order], return_index=True)
    return order, use, np.r_[starts, len(order)].astype(np.int64)


class _Grams:
    """The distinct pairs of a block, by shard and number, and its triples, by the pair of their first two words.

    A pair is ``first * width + second`` and a triple ``place of its pair * width + third``, in the numbers of
    the words; ``pair`` and ``triple`` are the places of each token's own (of ``long`` tokens, which have two
    words before them). Words the model does not know share the last number.
    """

    def __init__(self, b: _Block, numbers: np.ndarray, width: int, shards: int):
        self.numbers = np.where(numbers < 0, width - 1, numbers).astype(np.int64)
        w = self.numbers[b.codes]
        pairs, at = np.unique(self.numbers[b.before()] * width + w, return_inverse=True)
        order, self.use, self.cuts = _dealt(pairs, shards)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.pair = pairs[order], place[at]
        inner = np.ones(len(w), bool)
        inner[b.starts[:-1]] = False
        self.long = np.flatnonzero(inner)
        self.triples, self.triple = np.unique(self.pair[self.long - 1] * width + w[self.long], return_inverse=True)
        self.triple_cuts = np.searchsorted(self.triples, self.cuts * width)

    def contexts(self, width: int) -> np.ndarray:
        """The code of each pair's first word, if the model knows it."""
        order = np.argsort(self.numbers, kind="stable")
        return order[np.searchsorted(self.numbers[order], self.pairs // width)]

    def slices(self):
        """Shard, its pairs and its triples, for every shard that occurs."""
        for i, shard in enumerate(self.use.tolist()):
            yield shard, slice(*self.cuts[i : i + 2]), slice(*self.triple_cuts[i : i + 2])


def _pack_rising(values: np.ndarray) -> np.ndarray:
    """Bytes of the steps of a rising sequence, the lowest bytes of all of them first; they compress well."""
    return np.diff(values, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def _unpack_rising(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view(np.int64).ravel())


def _pack_values(*coded: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Values as codebook and codes, each with the part of the codebook that occurs."""
    fields = []
    for book, codes in coded:
        seen = np.zeros(len(book), bool)
        seen[codes] = True
        fields += [book[seen], _planes((np.cumsum(seen) - 1)[codes].astype(np.uint16))]
    return pack_fields(*fields)


def _unpack_values(data: bytes, n: int) -> list[np.ndarray]:
    fields = unpack_fields(data, *[np.float64, np.uint8] * n)
    return [held[_values(at, np.uint16)] for held, at in zip(fields[::2], fields[1::2])]


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


_SENT = "block bigint, shard bigint, data binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, shard, data = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"block": pa.array(block, pa.int64()), "shard": pa.array(shard, pa.int64()), "data": pa.array(data, pa.binary())})


def _send_words(blocks: DataFrame, shards: int, fold: int) -> DataFrame:
    """What each block holds of each shard's words, with their counts in training texts."""

    def send(batches):
        for row in _rows(batches):
            b, hashes = _Block(row), unpack(row["hashes"], np.uint64)
            n = np.bincount(b.codes[b.trained(fold)], minlength=len(hashes))
            order, use, cuts = _dealt(hashes, shards)
            parts = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
            yield _sent([(row["block"], s, pack_fields(hashes[m], n[m])) for s, m in zip(use.tolist(), parts)])

    return blocks.mapInArrow(send, _SENT)


def _number(blocks: DataFrame, replies: DataFrame, shards: int, run: RunFolder, buckets: int) -> DataFrame:
    """Blocks with the number (-1: unknown) and the count of every word of their dictionary."""

    def number(block: pa.Table, replies: pa.Table) -> pa.Table:
        order, use, cuts = _dealt(unpack(block["hashes"][0].as_py(), np.uint64), shards)
        numbers, c = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int64)
        for s, reply in zip(replies["shard"].to_pylist(), replies["data"].to_pylist()):
            i = int(np.searchsorted(use, s))
            mine = order[cuts[i] : cuts[i + 1]]
            small, large = unpack_fields(reply, np.uint8, np.uint8)
            numbers[mine], c[mine] = _values(small, np.int32), _values(large, np.int64)
        out = block.select(["block", "doc_id", "starts", "codes"])
        return out.append_column("numbers", pa.array([pack(_planes(numbers))], pa.binary())).append_column("counts", pa.array([pack(_planes(c))], pa.binary()))

    found = blocks.drop("tokens").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(number, _NUMBERED)
    return bucketed(found, run, "numbered", "block", buckets, dealt=True)


def _send_grams(numbered: DataFrame, width: int, shards: int, fold: int) -> DataFrame:
    """What each block holds of each shard's pairs and triples; a negative ``fold`` sends no counts."""

    def send(batches):
        for row in _rows(batches):
            b, c = _Block(row), _values(unpack(row["counts"], np.uint8), np.int64)
            g = _Grams(b, _values(unpack(row["numbers"], np.uint8), np.int32), width, shards)
            n2 = n3 = c2 = np.zeros(0, np.int32)
            if fold > 0:
                trained = b.trained(fold)
                n2 = np.bincount(g.pair[trained], minlength=len(g.pairs)).astype(np.int32)
                n3 = np.bincount(g.triple[trained[g.long]], minlength=len(g.triples)).astype(np.int32)
                c2 = np.where(n2 > 0, c[g.contexts(width)], 0)
            slices = list(g.slices())
            for i in range(0, len(slices), REPLIES):
                yield _sent(
                    [
                        (
                            row["block"],
                            s,
                            pack_fields(_pack_rising(g.pairs[two]), *map(_planes, (n2[two], c2[two])), _pack_rising(g.triples[three] - two.start * width), _planes(n3[three])),
                        )
                        for s, two, three in slices[i : i + REPLIES]
                    ]
                )

    return numbered.mapInArrow(send, _SENT)


class _Shard:
    """What all blocks sent to one shard: its different pairs and triples, and where each block has them."""

    def __init__(self, sent: list[bytes], width: int):
        opened = [unpack_fields(data, *[np.uint8] * 5) for data in sent]
        pairs, triples = ([_unpack_rising(x[i]) for x in opened] for i in (0, 3))
        self.two, self.three = (np.cumsum([0] + [len(x) for x in y]) for y in (pairs, triples))
        self.n2, self.c, self.n3 = (np.concatenate([_values(x[i], t) for x in opened]) for i, t in ((1, np.int32), (2, np.int64), (4, np.int32)))
        mine = np.concatenate([x // width + begin for x, begin in zip(triples, self.two[:-1])])
        third = np.concatenate([x % width for x in triples])
        pairs, self.pair = np.unique(np.concatenate(pairs), return_inverse=True)
        self.first, self.second = pairs // width, pairs % width
        triples, self.triple = np.unique(self.pair[mine] * width + third, return_inverse=True)
        self.of, self.third = triples // width, triples % width

    def build(self, mass: float) -> bytes:
        """The trie of what occurs in training texts."""
        count2 = np.bincount(self.pair, self.n2, len(self.first)).astype(np.int64)
        count3 = np.bincount(self.triple, self.n3, len(self.of)).astype(np.int64)
        context = np.zeros(len(self.first), np.int64)
        np.maximum.at(context, self.pair, self.c)
        two, three = count2 > 0, count3 > 0
        node = np.cumsum(two) - 1
        words, local = np.unique(np.r_[self.first[two], self.second[two], self.third[three]], return_inverse=True)
        first, second, last = np.split(local, [two.sum(), 2 * two.sum()])
        above = np.zeros(len(words), np.int64)
        above[first] = context[two]
        levels = [(first, second, count2[two]), (node[self.of[three]], last, count3[three])]
        return Trie.build(words.astype(np.uint64), above, levels, mass)

    def answers(self, trie: Trie) -> list[bytes]:
        """For each block the shares and rests of its pairs and the shares of its triples, looked up in the trie."""
        held = lambda numbers: trie.words(numbers.astype(np.uint64))
        node = trie.find(0, held(self.first), held(self.second))
        leaf = trie.find(1, node[self.of], held(self.third))
        (share, of), (rest, rest_of), (longer, longer_of) = trie.shares(0), trie.rests(1), trie.shares(1)
        share_at, rest_at, longer_at = _coded(of, node)[self.pair], _coded(rest_of, node)[self.pair], _coded(longer_of, leaf)[self.triple]
        return [
            _pack_values((share, share_at[a:b]), (rest, rest_at[a:b]), (longer, longer_at[c:d]))
            for a, b, c, d in zip(self.two[:-1], self.two[1:], self.three[:-1], self.three[1:])
        ]


def _scores(numbered: DataFrame, answers: DataFrame, fold: int, shards: int, width: int, total: int, distinct: int, mass: float) -> DataFrame:
    below = total + FLOOR * (distinct + 1)

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        b, c = _Block(row), _values(unpack(row["counts"], np.uint8), np.int64)
        g = _Grams(b, _values(unpack(row["numbers"], np.uint8), np.int32), width, shards)
        share, rest, longer = np.zeros(len(g.pairs)), np.ones(len(g.pairs)), np.zeros(len(g.triples))
        places = {s: (two, three) for s, two, three in g.slices()}
        for s, reply in zip(replies["shard"].to_pylist(), replies["data"].to_pylist()):
            two, three = places[s]
            share[two], rest[two], longer[three] = _unpack_values(reply, 3)
        base = (c + FLOOR) / below
        p = share[g.pair] + mass / (c[b.before()] + mass) * base[b.codes]
        p[g.long] = longer[g.triple] + rest[g.pair[g.long - 1]] * p[g.long]
        add = lambda x: np.add.reduceat(x, b.starts[:-1]) if len(b.n) else x[:0]
        return pa.table(
            {
                "doc_id": pa.array(b.doc_id, pa.int64()),
                "held_out": pa.array(remainder(b.doc_id, fold) == 0),
                "n_tokens": pa.array(b.n),
                "n_known": pa.array(add((c > 0)[b.codes].astype(np.int64))),
                "train_tokens": pa.array(np.full(len(b.n), total, np.int64)),
                "base_score": pa.array(add(np.log10(base)[b.codes])),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return (
        numbered.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            score,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
            " base_score double, score double",
        )
    )


# --- models ------------------------------------------------------------------------------------------


class NgramModel:
    """A model in its folder: ``words`` and ``grams`` hold one packed part per shard, ``totals`` one row of sums."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self.words, self.grams = (spark.read.parquet(f"{self.folder}/{name}") for name in ("words", "grams"))
        self.grams = self.grams.where("block is null")
        self.totals = spark.read.parquet(f"{self.folder}/totals").first().asDict()

    def error(self) -> float:
        """The largest error of a stored share or rest, in log10."""
        return self.grams.agg(F.max("error")).first()[0] or 0.0

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """What :func:`train_and_score` returns, for texts that need not be those the model learnt from."""
        run, t = RunFolder(docs.sparkSession, "lm-score", passing=True), self.totals
        shards, width = t["shards"], t["width"]
        blocks, buckets = _blocks(docs, run, doc_id, text)

        def find_words(asked: pa.Table, held: pa.Table) -> pa.Table:
            hashes, numbers, counts = (np.concatenate(x) for x in zip(*(unpack_fields(d, np.uint64, np.int32, np.int64) for d in [*held["data"].to_pylist(), pack_fields(*[np.zeros(0, np.uint8)] * 3)])))
            out = []
            for data in asked["data"].to_pylist():
                ask = unpack_fields(data, np.uint64, np.int64)[0]
                at = np.minimum(np.searchsorted(hashes, ask), max(len(hashes) - 1, 0))
                hit = hashes[at] == ask if len(hashes) else np.zeros(len(ask), bool)
                number, count = np.full(len(ask), -1, np.int32), np.zeros(len(ask), np.int64)
                number[hit], count[hit] = numbers[at[hit]], counts[at[hit]]
                out.append(pack_fields(_planes(number), _planes(count)))
            return asked.set_column(2, "data", pa.array(out, pa.binary()))

        def find_grams(asked: pa.Table, held: pa.Table) -> pa.Table:
            tries = [Trie(unpack(x, np.uint8)) for x in held["data"].to_pylist()]
            if not tries or not asked.num_rows:
                return asked.slice(0, 0)
            return asked.set_column(2, "data", pa.array(_Shard(asked["data"].to_pylist(), width).answers(tries[0]), pa.binary()))

        found = _send_words(blocks, shards, t["fold"]).groupBy("shard").cogroup(self.words.groupBy("shard")).applyInArrow(find_words, _SENT)
        numbered = _number(blocks, found, shards, run, buckets)
        asked = _send_grams(numbered, width, shards, -1).groupBy("shard")
        answers = asked.cogroup(self.grams.select("shard", "data").groupBy("shard")).applyInArrow(find_grams, _SENT)
        return _scores(numbered, answers, t["fold"], shards, width, t["total"], t["distinct"], t["mass"])


def _learn(docs: DataFrame, folder: str | None, fold: int, mass: float, doc_id: str, text: str, reply: bool):
    """The model, the numbered blocks, and, with ``reply``, what the tries answer to each block."""
    spark = docs.sparkSession
    run = RunFolder(spark, "lm", folder, passing=True)
    blocks, buckets = _blocks(docs, run, doc_id, text)
    shards = max(partitions(spark), -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // SHARD_TOKENS))

    def count_words(table: pa.Table) -> pa.Table:
        sent = [unpack_fields(x, np.uint64, np.int64) for x in table["data"].to_pylist()]
        cuts = np.cumsum([0] + [len(x[0]) for x in sent])
        held, at = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
        c = np.bincount(at, np.concatenate([x[1] for x in sent]), len(held)).astype(np.int64)
        # numbers are small for frequent words, so that they pack well
        number = np.empty(len(held), np.int64)
        number[np.lexsort((held, -c))] = np.arange(len(held)) * shards + table["shard"][0].as_py()
        number[c == 0] = -1
        known = c > 0
        packed = np.minimum(number, (1 << 31) - 1).astype(np.int32)
        data = [pack_fields(_planes(packed[at[a:b]]), _planes(c[at[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
        none = [None] * len(sent)
        return pa.table(
            {
                "block": pa.array([None, *table["block"].to_pylist()], pa.int64()),
                "shard": pa.array([table["shard"][0].as_py()] * (len(sent) + 1), pa.int64()),
                "data": pa.array([pack_fields(held[known], packed[known], c[known]), *data], pa.binary()),
                "total": pa.array([int(c.sum()), *none], pa.int64()),
                "words": pa.array([int(known.sum()), *none], pa.int64()),
                "width": pa.array([int(number.max()) + 1, *none], pa.int64()),
            }
        )

    known = run.write(
        _send_words(blocks, shards, fold).groupBy("shard").applyInArrow(count_words, f"{_SENT}, total bigint, words bigint, width bigint"),
        "replies",
    )
    total, distinct, width = (x or 0 for x in known.agg(F.sum("total"), F.sum("words"), F.max("width")).first())
    width += 1  # the last number is that of all unknown words
    if width >= 1 << 31:
        raise ValueError("more than two thousand million different words")
    run.write(known.where("block is null").select("shard", "data"), "words")
    numbered = _number(blocks, known.where("block is not null").select("block", "shard", "data"), shards, run, buckets)
    run.drop("replies")
    run.drop("blocks")

    def answer(table: pa.Table) -> pa.Table:
        part = _Shard(table["data"].to_pylist(), width)
        data = part.build(mass)
        trie = Trie(data)
        replies = part.answers(trie) if reply else []
        shard, blocks = table["shard"][0].as_py(), table["block"].to_pylist() if reply else []
        parts = [([None], [pack(np.frombuffer(data, np.uint8))], [trie.error])]
        for i in range(0, len(replies), REPLIES):
            some = replies[i : i + REPLIES]
            parts.append((blocks[i : i + REPLIES], some, [None] * len(some)))
        return pa.Table.from_batches(
            [
                pa.record_batch(
                    {
                        "block": pa.array(block, pa.int64()),
                        "shard": pa.array([shard] * len(block), pa.int64()),
                        "data": pa.array(values, pa.binary()),
                        "error": pa.array(error, pa.float64()),
                    }
                )
                for block, values, error in parts
            ]
        )

    grams = run.write(_send_grams(numbered, width, shards, fold).groupBy("shard").applyInArrow(answer, f"{_SENT}, error double"), "grams")
    totals = (total, distinct, width, shards, fold, mass)
    run.write(spark.createDataFrame([totals], "total bigint, distinct bigint, width bigint, shards bigint, fold bigint, mass double"), "totals")
    return NgramModel(spark, run.path), numbered, grams.where("block is not null").select("block", "shard", "data")


def train(docs: DataFrame, folder: str | None = None, fold: int = 10, mass: float = MASS, doc_id: str = "doc_id", text: str = "text") -> NgramModel:
    """Learn from rows whose crc32(id as text) mod ``fold`` is not 0; the model stays in ``folder``."""
    return _learn(docs, folder, fold, mass, doc_id, text, False)[0]


def train_and_score(
    docs: DataFrame, fold: int = 10, mass: float = MASS, doc_id: str = "doc_id", text: str = "text", folder: str | None = None
) -> DataFrame:
    """Learn from rows whose crc32(id as text) mod ``fold`` is not 0 and score every row.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are log10. The model can be
    read from ``folder`` afterwards.
    """
    model, numbered, answers = _learn(docs, folder, fold, mass, doc_id, text, True)
    t = model.totals
    return _scores(numbered, answers, fold, t["shards"], t["width"], t["total"], t["distinct"], mass)

"""Token ids in training order, as binary shards of fixed stride.

Every text is cut into sequences of ``length`` tokens. Sequences get dense numbers from the written token
table (its tasks' running numbers and one start per task), and a keyed Feistel permutation with
cycle-walking turns a number into a global slot: every sequence has one, every slot is used, and either
can be computed from the other. Slots are dealt to shards in ranges, and shards to tasks in ranges; a task
puts a shard's records in order and writes them one after another, so a reader finds slot s at
(s mod shard) * stride of file s // shard.

Token ids travel as ranks by frequency, compressed, many sequences in one value: by the frequencies of the
value in the token table, by those of all texts through the shuffle. The table goes once all shards stand. A file gets its final name when it is whole, and its
bytes follow from the token table alone, so a task that runs again replaces it by the same bytes. With
``folder`` a stopped run is taken up: a written token table is used, and shards that stand are left out.

A record is little-endian: doc_id (int64), part (int32), tokens (int32), then ``length`` token ids
(uint16), padded with ``PAD``.

Defined results: null and empty texts give one sequence without tokens; a null id is written as the
smallest int64 and returned as null; repeated rows are sequences of their own; a text of any length is
tokenised whole; other columns are ignored, whatever their names; an empty table gives no shard and no row.
"""

from __future__ import annotations

import base64
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.tables import pack, pack_fields, partitions, unpack, unpack_fields
from topicloom.llm.text import mix, steps, texts_of
from topicloom.session import RunFolder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 256
SHARD = 16_384
KEY = 20_240_607
PAD = 50_256
ROUNDS = 4
NO_ID = -(1 << 63)
CODES = 1 << 16
LEVEL = 6
# Sequences of one row of the token table, rows dealt together, and shards of one writing task: each bounds
# what a task holds.
BLOCK_SEQUENCES = 4096
DEALT_BLOCKS = 16
TASK_SHARDS = 8
# Bytes of distinct pieces that are encoded at once; their tokens come as a list of numbers.
ENCODED_BYTES = 512 << 10
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _widths(path: str) -> np.ndarray:
    """How many bytes each token id stands for."""
    encoder = _encoder(path)
    out = np.zeros(encoder.n_vocab, np.int64)
    for token in encoder.token_byte_values():
        out[encoder.encode_single_token(token)] = len(token)
    return out


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token ids in a row, and where each text's begin.

    The pattern always cuts before a single space between visible bytes, so texts are cut there first and
    each distinct piece is encoded once.
    """
    texts = texts_of(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
    # only ASCII visible bytes: bytes beyond ASCII may be white space to the pattern
    seen = (raw > 32) & (raw < 127)
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-2] = seen[:-2] & (raw[1:-1] == 32) & seen[2:]
    cut[edges] = True
    places = np.flatnonzero(cut)
    pieces = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw.tobytes()))
    coded = pieces.dictionary_encode()
    found = [_encode_pieces(p["piece"], path) for p in steps(pa.record_batch({"piece": coded.dictionary}), "piece", ENCODED_BYTES)]
    sizes, flat = (np.concatenate(x) for x in zip(*found))
    begins = np.cumsum(sizes) - sizes
    code = np.asarray(coded.indices).astype(np.int64)
    n = sizes[code]
    total = np.r_[0, np.cumsum(n)]
    ids = flat[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(begins[code], n)]
    return ids, total[np.searchsorted(places, edges)]


def _encode_pieces(pieces: pa.LargeStringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The number of tokens of each piece, and all tokens in a row.

    Pieces that begin with a space before a visible byte and end in a visible byte are cut from each other wherever they
    meet, so they are encoded as one text, whose tokens fall to them by their bytes; any other piece is encoded by itself.
    """
    encoder, widths = _encoder(path), _widths(path)
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    raw = np.frombuffer(pieces.buffers()[2], np.uint8)
    first, last = offsets[:-1], offsets[1:] - 1
    seen = lambda at: (raw[at] > 32) & (raw[at] < 127)
    inner = (last > first) & (raw[first] == 32)
    inner[inner] = seen(first[inner] + 1) & seen(last[inner])
    sized = np.diff(offsets)
    text = raw[offsets[0] : offsets[-1]][np.repeat(inner, sized)].tobytes().decode()
    joined = np.array(encoder.encode_ordinary(text), np.uint16)
    ends, bounds = np.r_[0, np.cumsum(widths[joined])], np.r_[0, np.cumsum(sized[inner])]
    others = [encoder.encode_ordinary(p) for p in pieces.filter(pa.array(~inner)).to_pylist()]
    sizes = np.zeros(len(pieces), np.int64)
    sizes[inner] = np.diff(np.searchsorted(ends, bounds))
    sizes[~inner] = [len(x) for x in others]
    flat, mine = np.zeros(sizes.sum(), np.uint16), np.repeat(inner, sizes)
    flat[mine] = joined
    flat[~mine] = np.array([t for x in others for t in x], np.uint16)
    return sizes, flat


def feistel(numbers: np.ndarray, count: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..count-1; values outside are walked on until they fall inside."""
    half = max((max(count - 1, 1).bit_length() + 1) // 2, 1)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key) + np.arange(ROUNDS, dtype=np.uint64))
    out = np.asarray(numbers).astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        out[open_] = left << np.uint64(half) | right
        open_ = open_[out[open_] >= count]
    return out.astype(np.int64)


def record(length: int) -> np.dtype:
    """How a sequence lies in a shard."""
    return np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("ids", "<u2", (length,))])


def stride(length: int) -> int:
    return record(length).itemsize


_FIELDS = ("<i4", "<i8", "<i4", "<i4", "<u2", "<u2")


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Token ids by falling count, then by id; those that do not occur are left out."""
    return np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint16)


def _ranks(order: np.ndarray) -> np.ndarray:
    """The place of each token id in ``order``."""
    rank = np.zeros(CODES, np.uint16)
    rank[order] = np.arange(len(order))
    return rank


def _packed(at: np.ndarray, doc_ids: np.ndarray, parts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, rank=None) -> bytes:
    """Sequences in one value, token ids by their ``rank``; without it, by an order that travels along."""
    own = _by_count(np.bincount(ids, minlength=CODES)) if rank is None else np.zeros(0, np.uint16)
    arrays = (at, doc_ids, parts, sizes, own, (_ranks(own) if rank is None else rank)[ids])
    return pack_fields(*(a.astype(t) for a, t in zip(arrays, _FIELDS)), level=LEVEL)


def _unpacked(data: bytes, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, doc_ids, parts, sizes, own, codes = unpack_fields(data, *_FIELDS)
    return at, doc_ids, parts, sizes, (own if order is None else order)[codes]


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """How often each token id occurs; a sum for each id of the vocabulary reaches the driver."""

    def add(batches):
        total = np.zeros(CODES, np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                total += unpack(counts.as_py(), np.int64)
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used, pa.int64()), "n": pa.array(total[used])})

    summed = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(add, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(CODES, np.int64)
    for r in summed.collect():
        out[r.id] = r.n
    return out


@dataclass(frozen=True)
class Layout:
    """``count`` sequences of ``length`` tokens, ``shard`` to a file, files below ``path``."""

    path: str
    count: int
    length: int
    shard: int
    key: int

    @property
    def files(self) -> int:
        return -(-self.count // self.shard)

    def records(self, number: int) -> int:
        return min(self.shard, self.count - number * self.shard)

    def tasks(self, spark: SparkSession, files: int) -> int:
        """Enough for the session, and none with more than ``TASK_SHARDS`` files."""
        return max(min(files, partitions(spark)), -(-files // TASK_SHARDS), 1)

    def place(self, number: int) -> str:
        return f"{pyarrow.fs.FileSystem.from_uri(self.path)[1]}/shard-{number:08d}.bin"


def build_shards(
    docs: DataFrame,
    length: int = LENGTH,
    shard: int = SHARD,
    key: int = KEY,
    vocabulary: str = VOCABULARY,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> Layout:
    """Writes the shards of ``docs``; the same ``folder`` and arguments take up a run that stopped."""
    spark = docs.sparkSession
    run = RunFolder(spark, "shards", folder)
    asked = (length, shard, key)
    if not run.complete("sizes"):
        if not run.complete("tokens"):
            rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
            cut = _cutter(length, vocabulary)
            run.write(rows.mapInArrow(cut, "task bigint, running bigint, n bigint, data binary, counts binary"), "tokens")
        tokens = spark.read.schema("task bigint, n bigint").parquet(f"{run.path}/tokens")
        sums = tokens.groupBy("task").agg(F.sum("n").alias("n"))
        run.write(sums.select("task", "n", *(F.lit(v).cast("bigint").alias(c) for c, v in zip(("length", "shard", "key"), asked))), "sizes")
    # one row per task of the job that cut the texts
    sizes = spark.read.parquet(f"{run.path}/sizes").orderBy("task").collect()
    if any((r.length, r.shard, r.key) != asked for r in sizes):
        raise ValueError(f"{run.path} holds shards of another layout")
    layout = Layout(f"{run.path}/binary", sum(r.n for r in sizes), *asked)
    if not layout.files:
        return layout
    done = standing(spark, layout) if folder else np.zeros(layout.files, bool)
    if not done.all():
        if not run.complete("tokens"):
            raise ValueError(f"{run.path}: shards are missing and the token table is gone; use another folder")
        starts = dict(zip([r.task for r in sizes], np.r_[0, np.cumsum([r.n for r in sizes])].tolist()))
        tokens = spark.read.schema("task bigint, running bigint, data binary, counts binary").parquet(f"{run.path}/tokens")
        order = _by_count(_frequencies(tokens))
        # a start for each task, a bit for each file, the token ids by frequency
        known = spark.sparkContext.broadcast((starts, np.packbits(done), order))
        blocks = tokens.where("data IS NOT NULL").select("task", "running", "data")
        tasks = layout.tasks(spark, layout.files)
        range_of = F.floor(F.col("shard") * tasks / layout.files).cast("int")
        dealt = blocks.mapInArrow(_dealer(layout, known), "shard bigint, data binary").repartitionById(tasks, range_of)
        written = run.write(dealt.sortWithinPartitions("shard").mapInArrow(_writer(layout, known), "shard bigint, records bigint"), "written")
        missing = int((~done).sum()) - written.select("shard").distinct().count()
        if missing:
            raise RuntimeError(f"{missing} shards were not written")
    run.drop("tokens")
    return layout


def write_shards(docs: DataFrame, *args, **options) -> DataFrame:
    """The shards of :func:`build_shards`, read back from the files."""
    return read_slots(docs.sparkSession, build_shards(docs, *args, **options))


def _cutter(length: int, vocabulary: str):
    def cut(batches):
        task, n, counts = TaskContext.get().partitionId(), 0, np.zeros(CODES, np.int64)

        def row(running, size, data, counts=None):
            numbers = [pa.array([v], pa.int64()) for v in (task, running, size)]
            return pa.RecordBatch.from_arrays(
                [*numbers, pa.array([data], pa.binary()), pa.array([counts], pa.binary())],
                names=["task", "running", "n", "data", "counts"],
            )

        for batch in batches:
            for part in steps(batch, "text", 4 << 20):
                ids, starts = encode(part["text"], vocabulary)
                parts = np.maximum(-(-np.diff(starts) // length), 1)
                owner = np.repeat(np.arange(part.num_rows), parts)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = starts[:-1][owner] + place * length
                end = np.minimum(begin + length, starts[1:][owner])
                doc_ids = np.asarray(pc.fill_null(part["doc_id"], NO_ID))[owner]
                for a in range(0, len(owner), BLOCK_SEQUENCES):
                    b = min(a + BLOCK_SEQUENCES, len(owner))
                    data = _packed(np.arange(b - a), doc_ids[a:b], place[a:b], (end - begin)[a:b], ids[begin[a] : end[b - 1]])
                    yield row(n, b - a, data)
                    n += b - a
                counts += np.bincount(ids, minlength=CODES)
        if n:
            yield row(n, 0, None, pack(counts))

    return cut


def _dealer(layout: Layout, known):
    def deal(batches):
        starts, bits, order = known.value
        done, rank = np.unpackbits(bits, count=layout.files).astype(bool), _ranks(order)
        for batch in batches:
            for a in range(0, batch.num_rows, DEALT_BLOCKS):
                part = batch.slice(a, DEALT_BLOCKS)
                first = [starts[t] + r for t, r in zip(part["task"].to_pylist(), part["running"].to_pylist())]
                blocks = [_unpacked(d) for d in part["data"].to_pylist()]
                number = np.concatenate([n + at for n, (at, *_) in zip(first, blocks)])
                doc_ids, parts, sizes, ids = (np.concatenate([b[i] for b in blocks]) for i in range(1, 5))
                slot = feistel(number, layout.count, layout.key)
                chosen = np.argsort(slot)
                chosen = chosen[~done[slot[chosen] // layout.shard]]
                if not len(chosen):
                    continue
                begins = (np.cumsum(sizes, dtype=np.int64) - sizes)[chosen]
                slot, doc_ids, parts, sizes = slot[chosen], doc_ids[chosen], parts[chosen], sizes[chosen].astype(np.int64)
                ends = np.r_[0, np.cumsum(sizes)]
                ids = ids[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], sizes)]
                shards, at = slot // layout.shard, slot % layout.shard
                cuts = np.r_[np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]), len(shards)]
                values = [
                    _packed(at[a:b], doc_ids[a:b], parts[a:b], sizes[a:b], ids[ends[a] : ends[b]], rank)
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
                ]
                yield pa.record_batch({"shard": pa.array(shards[cuts[:-1]]), "data": pa.array(values, pa.binary())})

    return deal


def _writer(layout: Layout, known):
    def flush(fs, number: int, rows: np.ndarray, filled: int) -> pa.RecordBatch:
        if filled != len(rows):
            raise RuntimeError(f"shard {number} has {filled} of {len(rows)} records")
        target = layout.place(number)
        attempt = f"{target}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            out.write(rows.view(np.uint8).data)
        try:
            fs.move(attempt, target)
        except OSError:
            # another attempt of this task may have put the same bytes there
            if fs.get_file_info(target).size != rows.nbytes:
                raise
            fs.delete_file(attempt)
        return pa.record_batch({"shard": pa.array([number], pa.int64()), "records": pa.array([filled], pa.int64())})

    def write(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(layout.path)
        fs.create_dir(root, recursive=True)
        number, rows, filled = None, None, 0
        for batch in batches:
            for shard, data in zip(batch["shard"].to_pylist(), batch["data"]):
                if shard != number:
                    if rows is not None:
                        yield flush(fs, number, rows, filled)
                    number, filled = shard, 0
                    rows = np.zeros(layout.records(shard), record(layout.length))
                    rows["ids"] = PAD
                at, rows_of, parts, sizes, ids = _unpacked(data.as_py(), known.value[2])
                rows["doc_id"][at], rows["part"][at], rows["n"][at] = rows_of, parts, sizes
                tokens = np.full((len(at), layout.length), PAD, np.uint16)
                tokens[np.arange(layout.length) < sizes[:, None]] = ids
                rows["ids"][at] = tokens
                filled += len(at)
        if rows is not None:
            yield flush(fs, number, rows, filled)

    return write


def standing(spark: SparkSession, layout: Layout) -> np.ndarray:
    """Whether each file stands whole. Tasks look them up; one bit of each reaches the driver."""

    def look(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(layout.path)
        for batch in batches:
            numbers = batch["id"].to_pylist()
            sizes = [i.size for i in fs.get_file_info([layout.place(n) for n in numbers])]
            whole = [s == layout.records(n) * stride(layout.length) for s, n in zip(sizes, numbers)]
            yield pa.record_batch({"first": pa.array(numbers[:1], pa.int64()), "bits": [np.packbits(whole).tobytes()], "n": [len(whole)]})

    out = np.zeros(layout.files, bool)
    files = spark.range(0, layout.files, 1, layout.tasks(spark, layout.files))
    for r in files.mapInArrow(look, "first bigint, bits binary, n bigint").collect():
        out[r.first : r.first + r.n] = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.n)
    return out


def read_slots(spark: SparkSession, layout: Layout, start: int = 0, stop: int | None = None) -> DataFrame:
    """``slot, shard, offset, doc_id, part, n_tokens, token_ids`` of the slots from ``start`` up to ``stop``.

    A training run that stopped at slot s goes on with ``start=s``: a file is opened at the first record
    that is asked for.
    """
    stop = layout.count if stop is None else min(stop, layout.count)
    width, kind = stride(layout.length), record(layout.length)

    def read(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(layout.path)
        for batch in batches:
            for number in batch["id"].to_pylist():
                base = number * layout.shard
                at, last = max(start - base, 0), min(stop - base, layout.records(number))
                with fs.open_input_file(layout.place(number)) as stream:
                    while at < last:
                        n = min(last - at, 4096)
                        x = np.frombuffer(stream.read_at(n * width, at * width), kind)
                        yield _rows(x, base, at, number, width)
                        at += n

    columns = "slot bigint, shard bigint, offset bigint, doc_id bigint, part int, n_tokens int, token_ids binary"
    if start < 0:
        raise ValueError("slots begin at 0")
    first, end = (start // layout.shard, -(-stop // layout.shard)) if start < stop else (0, 0)
    return spark.range(first, end, 1, layout.tasks(spark, end - first)).mapInArrow(read, columns)


def _rows(x: np.ndarray, base: int, at: int, number: int, width: int) -> pa.RecordBatch:
    local = at + np.arange(len(x))
    ids = x["ids"][np.arange(x["ids"].shape[1]) < x["n"][:, None]]
    ends = np.r_[0, 2 * np.cumsum(x["n"], dtype=np.int64)].astype(np.int32)
    return pa.record_batch(
        {
            "slot": pa.array(base + local),
            "shard": pa.array(np.full(len(x), number, np.int64)),
            "offset": pa.array(local * width),
            "doc_id": pa.array(x["doc_id"].copy(), mask=x["doc_id"] == NO_ID),
            "part": pa.array(x["part"].copy()),
            "n_tokens": pa.array(x["n"].copy()),
            "token_ids": pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2").tobytes())]),
        }
    )

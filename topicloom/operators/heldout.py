"""Held-out evaluation steps: the token split, predictive likelihoods and their summaries."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.special import pack
from topicloom.functions.vectors import literal_sql, ratio_sql, sum_vectors, total_sql
from topicloom.operators.blocks import Block, run_blocks
from topicloom.session import RunFolder, shuffle_partitions
from topicloom.sources.prepared import DOC, TERM, Corpus

# Copies of one (document, term) pair are generated in chunks of this many, so that no array grows
# with a count.
COPIES = 10_000
# Tokens a single task should rank. A larger document is cut into slices by the leading bits of the hash.
SLICE_TOKENS = 1_000_000
# Tokens that a task of the split orders at once, more where a document has more.
SPLIT_TOKENS = 1 << 18
# Numbers that the draws of a kernel may hold at once, for documents and for terms.
SAMPLE_BUDGET = 1 << 23
# Samples times topics that one random stream gives; the next samples come from a stream of their own.
STREAM_NUMBERS = 512
# Stream of the draws that stand for all terms that are not scored.
REST = 3
# Below this a product of scaled topics and weights may have lost digits; it is redone in logarithms.
UNDERFLOW = 1e-200
# Documents that a task of a log-mean-exp keeps before it sends their partial values on.
OPEN_DOCUMENTS = 1 << 20


def split_heldout(
    doc_terms: DataFrame,
    stats: DataFrame,
    test_fraction: float = 0.5,
    seed: int = 0,
    slice_tokens: int = SLICE_TOKENS,
) -> DataFrame:
    """``(doc_id, term_id, part, cnt)``: every document's tokens cut into ``test`` and ``train``.

    Tokens are put in the order of md5(seed|doc|term|copy); the first floor(fraction * tokens) are test.
    The pairs move once, by document, and a task draws and orders the tokens of whole documents. Only a document with
    more than ``slice_tokens`` tokens is ranked as a table, in slices of the hash's range. Slices are in hash order, so a
    token's rank is its rank in the slice plus the sizes of the earlier slices.
    """
    # at most one in slice_tokens tokens starts such a document, so the list of them is short
    large = stats.where(F.col("num_words") > slice_tokens)
    lengths = large.select("doc_id", "num_words", F.ceil(F.col("num_words") / slice_tokens).alias("slices"))
    written = doc_terms.where("doc_id IS NOT NULL AND term_id IS NOT NULL AND cnt > 0").select("doc_id", "term_id", F.col("cnt").cast("bigint"))
    usual = written.join(F.broadcast(large.select("doc_id")), "doc_id", "left_anti")
    small = usual.repartition("doc_id").sortWithinPartitions("doc_id")
    parts = small.mapInArrow(_split_documents(seed, float(test_fraction)), "doc_id bigint, term_id bigint, part string, cnt bigint")
    return parts.unionByName(_split_in_slices(written, lengths, float(test_fraction), seed))


def _split_documents(seed: int, fraction: float):
    def table(doc, term, cnt):
        """The parts of some whole documents."""
        head = [b"%d|%d|%d|" % (seed, d, t) for d, t in zip(doc.tolist(), term.tolist())]
        digests = b"".join([md5(b"%b%d" % (h, c)).digest() for h, n in zip(head, cnt.tolist()) for c in range(1, n + 1)])
        key = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
        pair = np.repeat(np.arange(len(doc)), cnt)
        # tokens lie in the order of document and, within a pair, of copy; sorts are stable
        order = np.lexsort((term[pair], key[:, 1], key[:, 0], doc[pair]))
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sizes = np.add.reduceat(cnt, edge)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tests = order[rank < np.repeat(np.floor(sizes * fraction), sizes)]
        in_test = np.bincount(pair[tests], minlength=len(doc))
        rows = []
        for part, n in (("test", in_test), ("train", cnt - in_test)):
            some = n > 0
            rows.append(pa.table({"doc_id": doc[some], "term_id": term[some], "part": pa.array([part] * int(some.sum()), pa.string()), "cnt": n[some]}))
        every = pa.concat_tables(rows)
        if len(doc) > 1 and (np.diff(np.sort(term)) == 0).any():  # a pair may be written in several rows
            every = every.group_by(["doc_id", "term_id", "part"]).aggregate([("cnt", "sum")]).rename_columns(["doc_id", "term_id", "part", "cnt"])
        return every.cast(pa.schema([("doc_id", pa.int64()), ("term_id", pa.int64()), ("part", pa.string()), ("cnt", pa.int64())]))

    def whole(doc, term, cnt):
        """Documents in groups of about SPLIT_TOKENS tokens."""
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ends, reached = np.r_[edge[1:], len(doc)], np.cumsum(cnt)
        begin = 0
        while begin < len(edge):
            done = reached[edge[begin] - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(reached[ends - 1], done + SPLIT_TOKENS, side="right")))
            at = slice(edge[begin], ends[end - 1])
            yield from table(doc[at], term[at], cnt[at]).to_batches()
            begin = end

    def split(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("doc_id", "term_id", "cnt")]
            starts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            if not len(starts) and (not held or held[-1][0][-1] == rows[0][0]):
                held.append(rows)
                continue
            # the last document may go on in the next batch
            if held and held[-1][0][-1] != rows[0][0]:
                yield from whole(*(np.concatenate(c) for c in zip(*held)))
                held = []
            cut = starts[-1] if len(starts) else 0
            if cut:
                yield from whole(*(np.concatenate(c) for c in zip(*held, [c[:cut] for c in rows])))
                held = []
            held.append([c[cut:] for c in rows])
        if held:
            yield from whole(*(np.concatenate(c) for c in zip(*held)))

    return split


def _split_in_slices(doc_terms: DataFrame, lengths: DataFrame, test_fraction: float, seed: int) -> DataFrame:
    """The split of the documents of ``lengths(doc_id, num_words, slices)``."""
    pairs = doc_terms.join(F.broadcast(lengths), "doc_id")
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("cnt") - 1) / COPIES).cast("int")))
    copies = pairs.select("*", chunk.alias("chunk"))
    first = F.col("chunk").cast("bigint") * COPIES + 1
    tokens = copies.withColumn("copy", F.explode(F.sequence(first, F.least("cnt", first + (COPIES - 1)))))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("doc_id", "term_id", "copy")])
    # the first 8 hex digits of the hash, cut into equal ranges
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    keyed = tokens.withColumn("key", F.md5(text)).select(
        "doc_id",
        "term_id",
        "copy",
        "key",
        "num_words",
        "slices",
        F.shiftright(head * F.col("slices"), 32).alias("slice"),
    )
    in_slice = Window.partitionBy("doc_id", "slice").orderBy("key", "term_id", "copy")
    ranked = keyed.withColumn("rank", F.row_number().over(in_slice))
    before = Window.partitionBy("doc_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        keyed.where("slices > 1")
        .groupBy("doc_id", "slice")
        .agg(F.count("*").alias("n"))
        .select("doc_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    rank = F.col("rank") + F.coalesce("earlier", F.lit(0))
    is_test = rank <= F.floor(F.col("num_words") * F.lit(test_fraction))
    return (
        ranked.join(earlier, ["doc_id", "slice"], "left")
        .withColumn("part", F.when(is_test, "test").otherwise("train"))
        .groupBy("doc_id", "term_id", "part")
        .agg(F.count("*").alias("cnt"))
    )


def plugin_loglik(test: Corpus, topic_mean: DataFrame, doc_mean: DataFrame) -> DataFrame:
    """``(doc_id, words, loglik)``: sum of cnt * ln(sum_k E[eta_kw] E[theta_dk]).

    ``topic_mean(term_id, eta)`` and ``doc_mean(doc_id, theta)`` hold posterior means.
    """
    k = len(doc_mean.select("theta").first()["theta"]) if test.num_pairs else 1
    vectors = doc_mean.select(F.lit(DOC).alias("kind"), F.col("doc_id").alias("id"), pack("theta").alias("vec")).unionAll(
        topic_mean.select(F.lit(TERM).alias("kind"), F.col("term_id").alias("id"), pack("eta").alias("vec"))
    )

    def kernel(pairs, vectors):
        block = Block(pairs, vectors, k)
        loglik = np.empty(len(block.segments))
        for i, ((lo, hi), d) in enumerate(zip(block.segments, block.segment_doc)):
            loglik[i] = block.cnt[lo:hi] @ np.log(block.term_vec[block.term[lo:hi]] @ block.doc_vec[d])
        words = block.sums_by_document(block.cnt).astype(np.int64)
        return pa.table({"doc_id": pa.array(block.segment_doc_id), "words": pa.array(words), "loglik": pa.array(loglik)})

    # one row per document and block: only documents spread over blocks have more than one
    shares = run_blocks(test, vectors, kernel, "doc_id bigint, words bigint, loglik double")
    return shares.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("loglik").alias("loglik"))


def mean_topics(gam: DataFrame, totals) -> DataFrame:
    return gam.select("term_id", F.expr(ratio_sql("gam", literal_sql(totals))).alias("eta"))


def mean_weights(docs: DataFrame) -> DataFrame:
    weights = docs.select("doc_id", F.expr(ratio_sql("a", "b")).alias("z"))
    sized = weights.withColumn("size", F.expr(total_sql("z")))
    return sized.select("doc_id", F.expr("transform(z, x -> x / size)").alias("theta"))


def log_mean_exp(values: DataFrame) -> DataFrame:
    """``(doc_id, loglik)`` of ``(doc_id, sample, x)``: ln of the mean of exp(x).

    A task merges its values to one (maximum, scaled sum, count) per document before anything moves, so a
    document with any number of values sends one small row per task, and one shuffle is enough. Values of minus
    infinity have exp 0; a document with no others has minus infinity. Nulls are left out.
    """
    parts = values.where("doc_id IS NOT NULL AND x IS NOT NULL").select("doc_id", F.col("x").cast("double").alias("x"))
    merged = parts.mapInArrow(_partial_means, "doc_id bigint, top double, size double, n bigint")
    found = merged.groupBy("doc_id").agg(
        F.max("top").alias("top"), F.sum("n").alias("n"), F.collect_list(F.struct("top", "size")).alias("parts")
    )
    scaled = F.expr("aggregate(parts, 0D, (s, p) -> s + if(p.top = top, p.size, p.size * exp(p.top - top)))")
    return found.select("doc_id", (F.col("top") + F.ln(scaled) - F.ln(F.col("n"))).alias("loglik"))


def _partial_means(batches):
    """One (doc_id, top, size, n) per document of a task; more where it has too many documents to keep."""

    def merge(rows):
        ids, top, size, n = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(ids, kind="stable")
        ids, top, size, n = ids[order], top[order], size[order], n[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        best = np.maximum.reduceat(top, first)
        at = np.repeat(best, np.diff(np.r_[first, len(ids)]))
        with np.errstate(invalid="ignore"):
            size = np.where(top == at, size, size * np.exp(top - at))
        return ids[first], best, np.add.reduceat(size, first), np.add.reduceat(n, first)

    def batch_of(row):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["doc_id", "top", "size", "n"])

    rows, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column("doc_id").to_numpy(), batch.column("x").to_numpy()
        rows.append(merge([(ids, x, np.ones(len(x)), np.ones(len(x), np.int64))]))
        held += len(rows[-1][0])
        if held > OPEN_DOCUMENTS:
            rows = [merge(rows)]
            held = len(rows[0][0])
            if 2 * held > OPEN_DOCUMENTS:
                yield batch_of(rows[0])
                rows, held = [], 0
    if rows:
        yield batch_of(merge(rows))


def heldout_summary(values: DataFrame) -> DataFrame:
    """One row ``(per_word, doc_mean, doc_std)`` of ``(doc_id, words, loglik)``.

    Total log-likelihood per word, and mean and sample deviation of the documents' values per word.
    """
    per_doc = F.col("loglik") / F.col("words")
    return values.where("words > 0").agg(
        (F.sum("loglik") / F.sum("words")).alias("per_word"),
        F.avg(per_doc).alias("doc_mean"),
        F.stddev_samp(per_doc).alias("doc_std"),
    )


# --- Monte Carlo -------------------------------------------------------------------------------------


class _Streams:
    """The random stream of one term or document; it does not depend on where the row is processed.

    A counter-based generator is set to the place of the stream, which costs less than a tenth of seeding a new one.
    Only the stream asked for last may be drawn from.
    """

    def __init__(self):
        self.bits = np.random.Philox(0)
        self.generator = np.random.Generator(self.bits)
        self.state = self.bits.state

    def __call__(self, seed: int, kind: int, key: int, group: int) -> np.random.Generator:
        place, low = self.state["state"], 0xFFFFFFFFFFFFFFFF
        place["key"][:] = np.array([key & low, seed & low], np.uint64)
        place["counter"][:] = np.array([0, group, kind, 0], np.uint64)
        self.state.update(buffer_pos=4, has_uint32=0, uinteger=0)
        self.bits.state = self.state
        return self.generator


def _stream(seed: int, kind: int, key: int, group: int) -> np.random.Generator:
    return _Streams()(seed, kind, key, group)


def sample_groups(samples: int, k: int) -> list[tuple[int, int]]:
    """``[lo, hi)`` of the samples that come from one stream; a matter of sizes only, so blocks agree on it."""
    size = max(1, STREAM_NUMBERS // k)
    return [(lo, min(lo + size, samples)) for lo in range(0, samples, size)]


def log_gamma_draws(stream: np.random.Generator, shape: np.ndarray, size: int) -> np.ndarray:
    """size x K logarithms of gamma draws.

    Below a shape of 1 a draw is one of shape + 1 times U^(1/shape), which underflows for small shapes; its
    logarithm does not.
    """
    small = shape < 1.0
    if not small.any():
        return np.log(stream.standard_gamma(shape, (size, len(shape))))
    out = np.log(stream.standard_gamma(np.where(small, shape + 1.0, shape), (size, len(shape))))
    out[:, small] += np.log(1.0 - stream.random((size, int(small.sum())))) / shape[small]
    return out


def sampled_topic_norms(gam: DataFrame, totals, samples: int, seed: int) -> np.ndarray:
    """samples x K sums of a gamma draw per vocabulary entry; ``gam`` holds the held-out terms.

    A sum of independent gamma variables is gamma again, so one draw per sample and topic stands for all
    the terms that are not scored. A task adds up its own draws and sends samples x K numbers; terms are dealt to
    all tasks, as their table is small and their draws are not.
    """
    totals = np.asarray(totals, dtype=float)
    k, groups = len(totals), sample_groups(samples, len(totals))

    def add_up(batches):
        table, any_row, stream = np.zeros((samples, k)), False, _Streams()
        for batch in batches:
            shapes = batch.column("gam").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            any_row |= batch.num_rows > 0
            for term, shape in zip(batch.column("term_id").to_pylist(), shapes):
                for g, (lo, hi) in enumerate(groups):
                    table[lo:hi] += np.exp(log_gamma_draws(stream(seed, TERM, term, g), shape, hi - lo))
        if any_row:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(samples * k, dtype=np.int32)), pa.array(table.ravel())], names=["at", "value"]
            )

    tasks = max(gam.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(gam.sparkSession))
    shares = gam.select("term_id", "gam").repartition(tasks, "term_id").mapInArrow(add_up, "at int, value double")
    rows = shares.groupBy("at").agg(F.sum("value").alias("value")).collect()  # samples x K numbers
    table = np.zeros(samples * k)
    for r in rows:
        table[r["at"]] = r["value"]
    used = gam.agg(sum_vectors("gam", k).alias("gam")).first()
    rest = totals - np.array([x or 0.0 for x in used["gam"]])
    table = table.reshape(samples, k)
    some = rest > 0
    for g, (lo, hi) in enumerate(groups):
        table[lo:hi, some] += np.exp(log_gamma_draws(_stream(seed, REST, 0, g), rest[some], hi - lo))
    return np.maximum(table, np.finfo(float).tiny)


def sampled_loglik(
    test: Corpus, gam: DataFrame, docs: DataFrame, totals, samples: int = 500, seed: int = 0
) -> DataFrame:
    """``(doc_id, sample, x)``: log-likelihood of each document's test words under each posterior draw.

    A draw is one set of topics, Dirichlet(Gam), and one set of weights per document, gamma(a, b),
    normalised. ``gam`` has the test terms, ``docs`` the documents' ``a`` and ``b``.
    """
    shares = _sample_shares(test, gam, docs, totals, samples, seed, F.lit(False))
    return shares.groupBy("doc_id", "sample").agg(F.sum("x").alias("x"))


def predictive_loglik(
    test: Corpus, gam: DataFrame, docs: DataFrame, totals, samples: int = 500, seed: int = 0, run: RunFolder | None = None
) -> DataFrame:
    """``(doc_id, loglik)``: ln of the mean likelihood of a document's test words over the draws.

    A block keeps a running maximum and scaled sum for every document it holds whole, and returns one row for
    it. Only documents spread over several blocks return a row per draw, to be added up first.
    """
    run = run or RunFolder(test.spark, "samples")
    whole = F.col("num_unique") <= test.piece
    shares = run.write(_sample_shares(test, gam, docs, totals, samples, seed, whole), "shares")
    spread = shares.where("sample >= 0").groupBy("doc_id", "sample").agg(F.sum("x").alias("x"))
    done = shares.where("sample < 0").select("doc_id", F.col("x").alias("loglik"))
    return done.unionAll(log_mean_exp(spread))


def _sample_shares(test: Corpus, gam: DataFrame, docs: DataFrame, totals, samples: int, seed: int, whole) -> DataFrame:
    """``(doc_id, sample, x)``; sample is -1 where x is already the log-mean over all of them."""
    k = len(np.asarray(totals))
    norms = np.log(sampled_topic_norms(gam, totals, samples, seed))
    # shapes, rates and the mark of a whole document travel as one vector; topics are padded to its width
    marked = docs.join(test.docs.select("doc_id", whole.cast("double").alias("_whole")), "doc_id")
    both = marked.select(
        F.lit(DOC).alias("kind"), F.col("doc_id").alias("id"), pack(F.concat("a", "b", F.array("_whole"))).alias("vec")
    )
    padded = gam.select(
        F.lit(TERM).alias("kind"), F.col("term_id").alias("id"), pack(F.concat("gam", "gam", F.array(F.lit(0.0)))).alias("vec")
    )
    return run_blocks(test, both.unionAll(padded), _sample_kernel(k, norms, seed), "doc_id bigint, sample int, x double")


def _sample_kernel(k: int, ln_norms: np.ndarray, seed: int):
    samples, groups = len(ln_norms), sample_groups(len(ln_norms), k)
    width = max(hi - lo for lo, hi in groups) * k
    docs_at_once, terms_at_once = (max(1, SAMPLE_BUDGET // width),) * 2
    pairs_at_once = max(1, SAMPLE_BUDGET // (4 * width))

    def log_weights(stream, block, docs, g, size):
        """ln theta up to a constant per document and draw, that constant taken out, and the scaled weights."""
        out = np.empty((len(docs), size, k))
        for i, d in enumerate(docs):
            shape, rate = block.doc_vec[d, :k], block.doc_vec[d, k : 2 * k]
            out[i] = log_gamma_draws(stream(seed, DOC, int(block.doc_ids[d]), g), shape, size) - np.log(rate)
        out -= out.max(axis=2, keepdims=True)
        scaled = np.exp(out)
        return out, scaled, np.log(scaled.sum(axis=2))

    def log_topics(stream, block, terms, g, lo, hi):
        out = np.empty((len(terms), hi - lo, k))
        for i, t in enumerate(terms):
            out[i] = log_gamma_draws(stream(seed, TERM, int(block.term_ids[t]), g), block.term_vec[t, :k], hi - lo)
        out -= ln_norms[lo:hi]
        top = out.max(axis=2)
        return out, np.exp(out - top[:, :, None]), top

    def add_group(stream, block, x, at, doc, begin, g, lo, hi):
        """Adds to x (documents x draws) what the pairs ``at`` of documents from ``begin`` on contribute."""
        ln_z, z, ln_size = log_weights(stream, block, block.segment_doc[begin : begin + len(x)], g, hi - lo)
        term = block.term[at]
        terms, cut = np.unique(term, return_inverse=True)
        for first in range(0, len(terms), terms_at_once):
            ln_eta, eta, top = log_topics(stream, block, terms[first : first + terms_at_once], g, lo, hi)
            mine = np.flatnonzero((cut >= first) & (cut < first + terms_at_once))
            for part in np.split(mine, range(pairs_at_once, len(mine), pairs_at_once)):
                t, d = cut[part] - first, doc[part] - begin
                mixed = np.einsum("psk,psk->ps", eta[t], z[d])
                lost = mixed < UNDERFLOW
                with np.errstate(divide="ignore"):
                    value = np.log(mixed) + top[t] - ln_size[d]
                if lost.any():
                    p, s = np.nonzero(lost)
                    both = ln_eta[t[p], s] + ln_z[d[p], s]
                    most = both.max(axis=1)
                    value[p, s] = most + np.log(np.exp(both - most[:, None]).sum(axis=1)) - ln_size[d[p], s]
                value *= block.cnt[at[part], None]
                if len(part):
                    edge = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    x[d[edge]] += np.add.reduceat(value, edge, axis=0)

    def kernel(pairs, vectors):
        block, stream = Block(pairs, vectors, 2 * k + 1), _Streams()
        whole = block.doc_vec[block.segment_doc, 2 * k] > 0
        doc = np.repeat(np.arange(len(block.segments)), [hi - lo for lo, hi in block.segments])
        ids, draws, values = [], [], []
        for begin in range(0, len(block.segments), docs_at_once):
            end = min(begin + docs_at_once, len(block.segments))
            at = np.arange(block.segments[begin][0], block.segments[end - 1][1])
            top, size = np.full(end - begin, -np.inf), np.zeros(end - begin)
            mine = np.flatnonzero(~whole[begin:end])
            for g, (lo, hi) in enumerate(groups):
                x = np.zeros((end - begin, hi - lo))
                add_group(stream, block, x, at, doc[at], begin, g, lo, hi)
                best = np.maximum(top, x.max(axis=1))
                size = size * np.exp(top - best) + np.exp(x - best[:, None]).sum(axis=1)
                top = best
                ids.append(np.repeat(block.segment_doc_id[begin:end][mine], hi - lo))
                draws.append(np.tile(np.arange(lo, hi, dtype=np.int32), len(mine)))
                values.append(x[mine].ravel())
            done = np.flatnonzero(whole[begin:end])
            ids.append(block.segment_doc_id[begin:end][done])
            draws.append(np.full(len(done), -1, np.int32))
            values.append((top + np.log(size) - np.log(samples))[done])
        return pa.table(
            {"doc_id": pa.array(np.concatenate(ids)), "sample": pa.array(np.concatenate(draws)), "x": pa.array(np.concatenate(values))}
        )

    return kernel

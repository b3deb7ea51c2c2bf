"""Fitting a topic model: the driver loop, its state tables, and the fitted model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions.special import digamma_packed, lgamma_array_sum, np_digamma, np_lgamma
from topicloom.functions.vectors import literal, literal_sql, number, ratio_sql, sum_vectors, total_sql
from topicloom.operators.bound import gaussian_value, stick_prior
from topicloom.operators.document_pass import SCHEMA as DOCUMENT_SCHEMA
from topicloom.operators.document_pass import collect_sums, move_documents, moved_documents
from topicloom.operators.kmeans import cluster_sizes, fit_kmeans, initial_topics, relabel
from topicloom.operators.responsibilities import expected_counts, topic_totals
from topicloom.operators.updates import (
    stick_weights,
    uniform_sticks,
    update_alpha,
    update_beta,
    update_sticks,
    SMALLEST_WEIGHT,
)
from topicloom.plans.loop import add_to_trace, iterate_until, newest_slot, note_of
from topicloom.session import RunFolder, wide_expressions
from topicloom.sources.matrix_text import write_matrix, write_vector
from topicloom.sources.prepared import DOC, TERM, Corpus, prepare_corpus

# Starting shape and rate of every document's weights.
START_SHAPE = 10.0
START_RATE = 10.0
COUNT_SCHEMA = "kind int, id bigint, vec array<double>, lng double, psi binary"


@dataclass
class Globals:
    """Everything of the size of the number of topics; the only state the driver holds."""

    v: np.ndarray
    p: np.ndarray
    u: np.ndarray
    cov: np.ndarray
    alpha: float
    beta: float
    totals: np.ndarray

    @property
    def beta_p(self) -> np.ndarray:
        return self.beta * self.p

    def as_note(self) -> dict:
        return {name: np.asarray(value).tolist() for name, value in vars(self).items()}

    @classmethod
    def of_note(cls, note: dict) -> Globals:
        scalars = ("alpha", "beta")
        return cls(**{name: value if name in scalars else np.array(value) for name, value in note.items()})


@dataclass(frozen=True)
class Model:
    """A fitted model as tables; see :meth:`save` for their files."""

    spark: SparkSession
    topic_terms: DataFrame  # term_id, gam; ids that never occurred hold gamma / vocab_size
    doc_topics: DataFrame  # doc_id, num_words, n, a, b, mu, sig
    globals: Globals
    gamma: float
    vocab_size: int
    correlated: bool
    trace_rows: list[tuple] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.globals.p)

    @property
    def topics(self) -> DataFrame:
        g = self.globals
        rows = [(i, float(g.v[i]), float(g.p[i]), float(g.u[i]), float(g.totals[i])) for i in range(self.k)]
        return self.spark.createDataFrame(rows, "k int, v double, p double, u double, total double")

    @property
    def topic_cov(self) -> DataFrame:
        rows = [(i, j, float(x)) for (i, j), x in np.ndenumerate(self.globals.cov)]
        return self.spark.createDataFrame(rows, "i int, j int, value double")

    @property
    def hyper(self) -> DataFrame:
        g = self.globals
        row = (float(g.alpha), float(g.beta), float(self.gamma), int(self.vocab_size), bool(self.correlated))
        return self.spark.createDataFrame(
            [row], "alpha double, beta double, gamma double, vocab_size bigint, correlated boolean"
        )

    @property
    def trace(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.trace_rows, "iter int, bound double, frac_change double, seconds double"
        )

    def topic_weights(self) -> DataFrame:
        """``(k, p, mean_share)``: prior weight of a topic and its mean share of the expected words."""
        words = self.doc_topics.agg(sum_vectors("n", self.k).alias("n"))
        shares = words.select(F.posexplode("n").alias("k", "words"), F.expr(total_sql("n")).alias("all"))
        return self.topics.join(shares, "k").select("k", "p", (F.col("words") / F.col("all")).alias("mean_share"))

    def top_terms(self, limit: int = 10) -> DataFrame:
        """``(k, rank, term_id, weight)``: the terms of highest expected probability in each topic.

        Each input partition keeps its own best rows per topic first, so what is ranked is small.
        """
        weights = F.expr(ratio_sql("gam", literal_sql(self.globals.totals)))
        long = self.topic_terms.select("term_id", F.posexplode(weights).alias("k", "weight"))
        best = [F.desc("weight"), F.col("term_id")]
        local = long.withColumn("_part", F.spark_partition_id())
        local_rank = F.row_number().over(Window.partitionBy("k", "_part").orderBy(*best))
        rank = F.row_number().over(Window.partitionBy("k").orderBy(*best))
        kept = local.withColumn("_r", local_rank).where(F.col("_r") <= limit)
        return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("k", "rank", "term_id", "weight")

    def save(self, path: str) -> None:
        """Parquet tables below ``path``; the Gaussian parts only for the correlated model."""
        docs = self.doc_topics if self.correlated else self.doc_topics.drop("mu", "sig")
        tables = {"topic_terms": self.topic_terms, "doc_topics": docs, "hyper": self.hyper, "trace": self.trace}
        tables["topics"] = self.topics if self.correlated else self.topics.drop("u")
        if self.correlated:
            tables["topic_cov"] = self.topic_cov
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    def export_text(self, path: str) -> None:
        """The model as text files of six decimals below ``path``, for programs that do not read Parquet.

        A document or a term is a row and a topic a column (``a``, ``b``, ``mu``, ``sig``, ``gam``; rows by id, an id
        without words holding the prior); ``cov`` is a matrix, ``v``, ``u`` and ``bound`` are vectors, ``alpha`` and
        ``beta`` single values. ``mu``, ``sig``, ``u`` and ``cov`` only for the correlated model.
        """
        g = self.globals
        long = lambda df, key, column: df.select(F.col(key).alias("i"), F.posexplode(column).alias("j", "value")).select(
            "i", F.col("j").cast("bigint").alias("j"), "value"
        )
        unseen = self.spark.range(self.vocab_size).withColumnRenamed("id", "term_id").join(self.topic_terms, "term_id", "left")
        flat = literal(np.full(self.k, self.gamma / self.vocab_size))
        terms = unseen.select("term_id", F.coalesce("gam", flat).alias("gam"))
        write_matrix(long(terms, "term_id", "gam"), f"{path}/gam", (self.vocab_size, self.k))
        for name in ("a", "b", "mu", "sig") if self.correlated else ("a", "b"):
            write_matrix(long(self.doc_topics, "doc_id", name), f"{path}/{name}")
        vectors = {"v": g.v, "alpha": [g.alpha], "beta": [g.beta], "bound": [t[1] for t in self.trace_rows]}
        if self.correlated:
            vectors["u"] = g.u
            write_matrix(self.topic_cov.selectExpr("bigint(i) AS i", "bigint(j) AS j", "value"), f"{path}/cov", (self.k, self.k))
        for name, values in vectors.items():
            rows = [(i, float(x)) for i, x in enumerate(values)]
            write_vector(self.spark.createDataFrame(rows, "i bigint, value double"), f"{path}/{name}", len(rows))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        hyper = read("hyper").first()
        topics = sorted(read("topics").collect(), key=lambda r: r["k"])  # K rows
        k = len(topics)
        docs, cov, u = read("doc_topics"), np.eye(k), np.zeros(k)
        if hyper["correlated"]:
            u = np.array([r["u"] for r in topics])
            for r in read("topic_cov").collect():  # K x K rows
                cov[r["i"], r["j"]] = r["value"]
        else:
            zeros = literal(np.zeros(k))
            docs = docs.select("*", zeros.alias("mu"), zeros.alias("sig"))
        column = lambda name: np.array([r[name] for r in topics])
        state = Globals(column("v"), column("p"), u, cov, hyper["alpha"], hyper["beta"], column("total"))
        trace = [tuple(r) for r in read("trace").orderBy("iter").collect()]  # one row per iteration
        return cls(
            spark, read("topic_terms"), docs, state, hyper["gamma"], hyper["vocab_size"], hyper["correlated"], trace
        )


def fit_topics(
    corpus: Corpus | DataFrame,
    k: int,
    correlated: bool = True,
    max_iter: int = 100,
    tol: float | None = None,
    min_iter: int = 1,
    gamma: float | None = None,
    alpha: float = 20.0,
    beta: float = 5.0,
    learn_alpha: bool = True,
    learn_beta: bool = False,
    kmeans_iter: int = 1,
    seed: int = 0,
    sort_topics: bool = True,
    folder: str | None = None,
) -> Model:
    """Fit k topics by coordinate ascent on one evidence bound.

    ``correlated=False`` gives the hierarchical Dirichlet process. The loop stops after ``max_iter``
    iterations, or once the fractional change of the bound is below ``tol`` and ``min_iter`` are done.

    With ``folder`` the run keeps its tables there. If an earlier run of the same corpus and model was cut off (or
    stopped sooner), the loop goes on after its last complete iteration.
    """
    _check_arguments(k, max_iter, tol, gamma, kmeans_iter)
    if isinstance(corpus, DataFrame):
        corpus = prepare_corpus(corpus)
    spark, run = corpus.spark, RunFolder(corpus.spark, "fit", folder)
    gamma = gamma if gamma is not None else 0.5 * corpus.vocab_size
    about = [k, correlated, float(gamma), corpus.num_docs, corpus.num_words, corpus.vocab_size]
    flat, trace = gamma / corpus.vocab_size, []

    def settle(at, state, step) -> float:
        """The arithmetic after the tables of an iteration are written; needs one action."""
        slot, counts = at
        sums = collect_sums(slot, counts, k)
        center, bp_made = state.u, state.beta_p
        update_globals(state, sums, sums["moments"] if correlated else None, corpus.num_docs, gamma, learn_alpha, learn_beta)
        return coherent_bound(corpus, state, sums, sums["moments"] if correlated else None, center, bp_made, gamma)

    with wide_expressions(spark):
        found = newest_slot(run, ("docs", "counts")) if folder else None
        if found:
            at, note = found
            if note["about"] != about:
                raise ValueError("the folder holds a run of another corpus or model")
            state, trace = Globals.of_note(note["state"]), [tuple(row) for row in note["trace"]]
            written = run.read_slot("docs", at, DOCUMENT_SCHEMA), run.read_slot("counts", at, COUNT_SCHEMA)
            add_to_trace(trace, settle(written, state, at), None)
            docs, terms = moved_documents(written[0]), topics_of(written[1], flat)
        else:
            terms = start_topics(corpus, k, gamma, kmeans_iter, seed, sort_topics, run)
            terms = terms.withColumn("psi", digamma_packed("gam"))
            docs = start_documents(corpus.docs, k, correlated)
            v = uniform_sticks(k)
            totals = topic_totals(terms, k, corpus.seen_terms, corpus.vocab_size, flat)
            state = Globals(v, stick_weights(v), np.zeros(k), np.eye(k), alpha, beta, totals)

        def step(number: int) -> float:
            nonlocal docs, terms
            note = note_of(number, trace, state=state.as_note(), about=about)
            written = write_iteration(corpus, terms, docs, state, gamma, correlated, run, number, note)
            docs, terms = moved_documents(written[0]), topics_of(written[1], flat)
            return settle(written, state, number)

        iterate_until(step, trace, max_iter, tol, min_iter)
    return Model(spark, terms.select("term_id", "gam"), docs.drop("lnz"), state, gamma, corpus.vocab_size, correlated, trace)


def _check_arguments(k, max_iter, tol, gamma, kmeans_iter) -> None:
    if k < 2:
        raise ValueError("k must be at least 2")
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    if tol is not None and tol <= 0:
        raise ValueError("tol must be above 0, or None")
    if gamma is not None and gamma <= 0:
        raise ValueError("gamma must be above 0")
    if kmeans_iter < 1:
        raise ValueError("kmeans_iter must be at least 1")


def start_topics(corpus, k, gamma, kmeans_iter, seed, sort_topics, run) -> DataFrame:
    centroids, assigned = fit_kmeans(corpus, k, kmeans_iter, seed, run=run)
    order = list(range(k))
    if sort_topics:
        ranked = relabel(cluster_sizes(assigned), k).orderBy("rank").collect()  # k rows
        order = [r["k"] for r in ranked]
    return run.write(initial_topics(corpus, centroids, order, gamma), "start_topics")


def start_documents(stats: DataFrame, k: int, correlated: bool) -> DataFrame:
    log_weight = float(np_digamma(START_SHAPE) - np.log(START_RATE))
    fill = lambda x: literal(np.full(k, x))
    return stats.select(
        "doc_id",
        "num_words",
        fill(0.0).alias("n"),
        fill(START_SHAPE).alias("a"),
        fill(START_RATE).alias("b"),
        fill(0.0).alias("mu"),
        fill(1.0 if correlated else 0.0).alias("sig"),
        F.lit(bytearray(np.full(k, log_weight).tobytes())).alias("lnz"),
    )


def with_counts(docs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``n`` replaced by the counts of kind DOC; documents without words get zeros."""
    n = counts.where(F.col("kind") == DOC).select(F.col("id").alias("doc_id"), F.col("vec").alias("n"))
    joined = docs.drop("n").join(n, "doc_id", "left")
    return joined.withColumn("n", F.coalesce("n", literal(np.zeros(k)))).select(*docs.columns)


def settled_documents_value(sums, num_docs: int, bp_made, bp_now) -> float:
    """The documents' part of the bound right after their update under ``bp_made``, priced at ``bp_now``.

    With a = n + bp_made the assignments, the gamma prior and the gamma entropy share (a - 1) digamma(a),
    which is huge for topics of almost no weight. It cancels; written out it would cost digits.
    """
    lnz, mu = np.array(sums["elnz"]), np.array(sums["mu"])
    prior = bp_now @ mu - num_docs * float(np_lgamma(bp_now).sum()) + (bp_now - bp_made) @ lnz
    return sums["settled"] + sums["normaliser"] + sums["rate"] + float(prior)


def write_iteration(corpus, terms, docs, state: Globals, gamma, correlated, run, step, note):
    """The two tables of an iteration, each written by one action: counts and topics, then documents and sums."""
    k, flat = len(state.p), gamma / corpus.vocab_size
    counted = expected_counts(corpus, packed_logs(terms, docs), k, np_digamma(state.totals))
    counts = run.write_slot(with_topic_logs(counted, flat), "counts", step, partition_by="kind")
    precision = np.linalg.inv(state.cov) if correlated else None
    moved = move_documents(with_counts(docs, counts, k), state.beta_p, state.u, precision, 1, note)
    return run.write_slot(moved, "docs", step, partition_by="part"), counts


def topics_of(counts: DataFrame, flat: float) -> DataFrame:
    """``(term_id, gam, psi)`` of written counts."""
    gam = F.expr(f"transform(vec, x -> x + {number(flat)})")
    return counts.where(F.col("kind") == TERM).select(F.col("id").alias("term_id"), gam.alias("gam"), "psi")


def packed_logs(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """The vectors of a token pass from ``terms(term_id, psi)`` and documents, both with packed logs at hand."""
    side = lambda df, kind, key, vec: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(vec).alias("vec"))
    return side(docs, DOC, "doc_id", "lnz").unionAll(side(terms, TERM, "term_id", "psi"))


def with_topic_logs(counted: DataFrame, flat: float) -> DataFrame:
    """Counts with the sum of log-gamma (for the bound) and packed digamma (for the next token pass).

    Both come from one trip through Arrow. Rows of other kinds get a harmless argument.
    """
    gam = F.expr(f"transform(vec, x -> if(kind = {TERM}, x + {number(flat)}, 1D))")
    ready = counted.select("kind", "id", "vec", gam.alias("gam"))
    return ready.select("kind", "id", "vec", lgamma_array_sum("gam").alias("lng"), digamma_packed("gam").alias("psi"))


def update_globals(state: Globals, sums, moments, num_docs, gamma, learn_alpha, learn_beta) -> None:
    k = len(state.p)
    pull = sums["mu"] + sums["elnz"]
    state.totals = gamma + sums["n"]
    state.v = update_sticks(state.v, state.alpha, state.beta, pull, num_docs)
    state.p = np.maximum(stick_weights(state.v), SMALLEST_WEIGHT)
    if learn_alpha:
        state.alpha = update_alpha(state.v)
    if learn_beta:
        state.beta = update_beta(state.beta, state.p, pull, num_docs)
    if moments is not None:
        delta = moments[:, k] / num_docs
        state.u = state.u + delta
        state.cov = moments[:, :k] / num_docs - np.outer(delta, delta) + np.diag(moments[:, k + 1] / num_docs)


def coherent_bound(corpus, state: Globals, sums, moments, center, bp_made, gamma) -> float:
    """The bound at the end of an iteration, from sums that are already there.

    The topics were just set to prior + counts, so their expected log-probabilities cancel between the
    words, the prior and the entropy; what is left is log-gamma of the parameters.
    """
    k, flat = len(state.p), gamma / corpus.vocab_size
    unseen = corpus.vocab_size - corpus.seen_terms
    topics = (
        k * float(np_lgamma(gamma) - corpus.vocab_size * np_lgamma(flat))
        - float(np_lgamma(state.totals).sum())
        + sums["lng"]
        + unseen * k * float(np_lgamma(flat))
    )
    docs = settled_documents_value(sums, corpus.num_docs, bp_made, state.beta_p)
    sticks = stick_prior(state.v, state.alpha)
    gaussian = 0.0
    if moments is not None:
        gaussian = gaussian_value(moments, center, state.u, state.cov, corpus.num_docs)
    return topics + sums["token_entropy"] + docs + sticks + gaussian

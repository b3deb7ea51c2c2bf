"""Evaluating a fitted model on documents it has not seen."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import digamma_packed, np_digamma
from topicloom.functions.vectors import literal
from topicloom.operators.bound import bound_topics, gaussian_value
from topicloom.operators.document_pass import SCHEMA as DOCUMENT_SCHEMA
from topicloom.operators.document_pass import collect_sums, move_documents, moved_documents, named_sums
from topicloom.operators.blocks import VECTOR_SCHEMA
from topicloom.operators.fold_pass import collect_fold_sums, fold_blocks
from topicloom.operators.heldout import heldout_summary, predictive_loglik, split_heldout
from topicloom.operators.responsibilities import expected_counts
from topicloom.plans.fit import START_RATE, START_SHAPE, Model, packed_logs, settled_documents_value, start_documents, with_counts
from topicloom.plans.loop import add_to_trace, iterate_until, newest_slot, note_of, settled
from topicloom.session import RunFolder, wide_expressions
from topicloom.sources.corpus import doc_stats
from topicloom.sources.prepared import TERM, Corpus, prepare_corpus

FOLD_IN_STEPS = 5


@dataclass(frozen=True)
class FoldIn:
    docs: DataFrame  # doc_id, num_words, n, a, b, mu, sig
    trace: list[tuple]


@dataclass(frozen=True)
class Heldout:
    docs: DataFrame  # doc_id, words, loglik, per_word
    summary: DataFrame  # per_word, doc_mean, doc_std
    fold: FoldIn


def model_topics(model: Model, corpus: Corpus) -> DataFrame:
    """``(term_id, gam)`` of the terms of a corpus; terms the model never saw hold the flat prior."""
    if corpus.vocab_size > model.vocab_size:
        raise ValueError("the corpus has term ids beyond the model's vocabulary")
    flat = literal(np.full(model.k, model.gamma / model.vocab_size))
    seen = corpus.needed.where(F.col("kind") == TERM).select(F.col("id").alias("term_id")).distinct()
    return seen.join(model.topic_terms, "term_id", "left").select("term_id", F.coalesce("gam", flat).alias("gam"))


def fold_in(
    model: Model,
    corpus: Corpus,
    max_iter: int = 100,
    tol: float | None = 1e-3,
    min_iter: int = 26,
    normal_steps: int = FOLD_IN_STEPS,
    folder: str | None = None,
) -> FoldIn:
    """Posteriors of new documents with topics, sticks, scale, mean and covariance held fixed.

    With ``folder`` the run keeps its tables there, one state for each iteration, and goes on where an earlier one was
    cut off. Without it, and where every document lies whole in a block, all iterations up to the first at which the loop
    may stop are one pass; should it not stop there, a longer pass starts anew.
    """
    k, g, run = model.k, model.globals, RunFolder(corpus.spark, "fold_in", folder)
    precision = np.linalg.inv(g.cov) if model.correlated else None
    about = [k, model.correlated, float(model.gamma), corpus.num_docs, corpus.num_words]
    trace: list[tuple] = []
    with wide_expressions(corpus.spark):
        terms = run.write(
            model_topics(model, corpus).select("term_id", digamma_packed("gam").alias("psi")), "topics"
        )
        docs = start_documents(corpus.docs, k, model.correlated)
        fixed = frozen_topics_bound(model)
        if not folder and corpus.docs.where(F.col("num_unique") > corpus.piece).isEmpty():
            return _fold_in_at_once(model, corpus, terms, fixed, max_iter, tol, min_iter, normal_steps, run)
        found = newest_slot(run, ("docs", "counts")) if folder else None
        if found:
            at, note = found
            if note["about"] != about:
                raise ValueError("the folder holds a run of other documents or another model")
            slot, trace = run.read_slot("docs", at, DOCUMENT_SCHEMA), [tuple(row) for row in note["trace"]]
            bound = fixed + _document_bound(model, corpus, run.read_slot("counts", at, VECTOR_SCHEMA), slot)
            add_to_trace(trace, bound, None)
            docs = moved_documents(slot)

        def step(number: int) -> float:
            nonlocal docs
            counted = expected_counts(corpus, packed_logs(terms, docs), k, np_digamma(g.totals))
            counts = run.write_slot(counted, "counts", number, partition_by="kind")
            note = note_of(number, trace, about=about)
            moved = move_documents(with_counts(docs, counts, k), g.beta_p, g.u, precision, normal_steps, note)
            slot = run.write_slot(moved, "docs", number, partition_by="part")
            docs = moved_documents(slot)
            return fixed + _document_bound(model, corpus, counts, slot)

        iterate_until(step, trace, max_iter, tol, min_iter)
    return FoldIn(docs.drop("lnz"), trace)


def _fold_in_at_once(model, corpus, terms, fixed, max_iter, tol, min_iter, normal_steps, run) -> FoldIn:
    k, g = model.k, model.globals
    precision = np.linalg.inv(g.cov) if model.correlated else None
    start = (START_SHAPE, START_RATE, 0.0, 1.0 if model.correlated else 0.0)
    upto, number = max_iter if tol is None else min(max_iter, max(min_iter, 2)), 0
    while True:
        began = time.monotonic()
        moved = fold_blocks(corpus, terms, np_digamma(g.totals), start, g.beta_p, g.u, precision, normal_steps, upto)
        slot = run.write_slot(moved, "docs", number, partition_by="part")
        trace: list[tuple] = []
        for row in collect_fold_sums(slot, upto):
            value = fixed + _folded_bound(model, corpus, row[0], named_sums(row[1:], k))
            add_to_trace(trace, value, (time.monotonic() - began) / upto)
            if settled(trace, tol, min_iter):
                break
        # a pass that went too far is done again up to where the loop stops
        if len(trace) == upto and (upto == max_iter or settled(trace, tol, min_iter)):
            return FoldIn(moved_documents(slot).drop("lnz"), trace)
        upto, number = (min(max_iter, 2 * upto) if len(trace) == upto else len(trace)), number + 1


def frozen_topics_bound(model: Model) -> float:
    """The topics' part of the bound, a constant during fold-in; unseen ids in closed form."""
    seen = model.topic_terms.count()
    row = bound_topics(model.topic_terms, model.globals.totals, seen, model.vocab_size, model.gamma).first()
    return row["topic_prior"] + row["topic_entropy"]


def _document_bound(model: Model, corpus: Corpus, counts: DataFrame, slot: DataFrame) -> float:
    sums = collect_sums(slot, counts, model.k)
    # the block rows carry the entropy of the responsibilities and the expected log-probability of the words
    return _folded_bound(model, corpus, sums["token_entropy"] + sums["token_words"], sums)


def _folded_bound(model: Model, corpus: Corpus, tokens: float, sums: dict) -> float:
    g = model.globals
    value = tokens + settled_documents_value(sums, corpus.num_docs, g.beta_p, g.beta_p)
    if model.correlated:
        value += gaussian_value(sums["moments"], g.u, g.u, g.cov, corpus.num_docs)
    return value


def evaluate_heldout(
    model: Model,
    doc_terms: DataFrame,
    test_fraction: float = 0.5,
    num_samples: int = 500,
    seed: int = 0,
    per: str = "test",
    doc_ids: DataFrame | None = None,
    **fold_args,
) -> Heldout:
    """Split the documents' tokens, fold in the train part, score the test part by Monte Carlo.

    ``per`` names the part whose number of words divides a document's log-likelihood. Every document of
    ``doc_terms`` and ``doc_ids`` is returned; one without test words has a log-likelihood of 0, no value
    per word, and is left out of the summary.
    """
    if per not in ("test", "train"):
        raise ValueError("per must be 'test' or 'train'")
    run = RunFolder(doc_terms.sparkSession, "heldout")
    ids = doc_terms.select("doc_id")
    ids = (ids if doc_ids is None else ids.unionAll(doc_ids.select("doc_id"))).distinct()
    parts = run.write(
        split_heldout(doc_terms, doc_stats(doc_terms), test_fraction, seed), "parts", partition_by="part"
    )
    train, test = (
        prepare_corpus(parts.where(F.col("part") == part).drop("part"), ids, model.vocab_size, unique=True)
        for part in ("train", "test")
    )
    fold = fold_in(model, train, **fold_args)
    gam = run.write(model_topics(model, test), "test_topics")
    values = predictive_loglik(test, gam, fold.docs, model.globals.totals, num_samples, seed, run)
    words = (test if per == "test" else train).docs.select("doc_id", F.col("num_words").alias("words"))
    scored = words.join(values, "doc_id", "left")
    per_word = F.when(F.col("words") > 0, F.col("loglik") / F.col("words"))
    docs = run.write(
        scored.select("doc_id", "words", F.coalesce("loglik", F.lit(0.0)).alias("loglik"), per_word.alias("per_word")),
        "docs",
    )
    train.release()
    test.release()
    return Heldout(docs, heldout_summary(docs.where("per_word IS NOT NULL")), fold)

"""One query per operator, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.special import digamma, lgamma
from topicloom.functions.vectors import per_topic
from topicloom.operators import bound, heldout, kmeans, matrix, updates
from topicloom.operators.responsibilities import (
    expected_counts,
    expected_log_topics,
    expected_log_weights,
    log_vectors,
    responsibilities,
    token_scores,
)
from topicloom.plans.fit import Globals, Model, fit_topics, start_topics
from topicloom.plans.heldout import evaluate_heldout, fold_in
from topicloom.registry import inputs
from topicloom.registry.inputs import ALPHA, BETA, COVARIANCE, K, MEAN, STICKS, WEIGHTS, table, text_corpus
from topicloom.session import RunFolder
from topicloom.sources import corpus as source
from topicloom.sources import matrix_text

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def rounded(column, digits: int = 6):
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return F.round(column, digits) + F.lit(0.0)


def spread(df: DataFrame, keep: list[str], digits: int = 6, **vectors: str) -> DataFrame:
    """``keep`` plus one rounded column per entry of the named vectors: ``a="x"`` gives x0, x1, ..."""
    values = [
        rounded(F.col(column)[i], digits).alias(f"{name}{i}") for column, name in vectors.items() for i in range(K)
    ]
    return df.select(*keep, *values)


# --- sources and sinks -------------------------------------------------------------------------------


@query
def corpus_from_text(spark, folder):
    return source.corpus_from_text(table(spark, folder, "documents"))


@query
def corpus_vocabulary(spark, folder):
    pairs = source.corpus_from_text(table(spark, folder, "documents"))
    return source.vocabulary(pairs, RunFolder(spark, "query"))


@query
def corpus_read_counts(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    path = f"{RunFolder(spark, 'query').path}/counts"
    source.write_counts(corpus.doc_terms, corpus.docs, path)
    return source.read_counts(spark, path)


@query
def corpus_stats(spark, folder):
    documents = table(spark, folder, "documents")
    doc_terms = text_corpus(spark, folder).corpus.doc_terms
    return source.corpus_stats(source.doc_stats(doc_terms, documents), doc_terms)


@query
def corpus_doc_stats(spark, folder):
    return source.doc_stats(text_corpus(spark, folder).corpus.doc_terms, table(spark, folder, "documents"))


@query
def corpus_check(spark, folder):
    """Pairs made faulty on the way: halved ids collide, small ids turn negative, single counts turn zero."""
    corpus = text_corpus(spark, folder).corpus
    doc = F.col("doc_id") * 2 + F.col("term_id") % 2
    faulty = corpus.doc_terms.select(
        doc.alias("doc_id"),
        F.col("term_id").alias("position"),
        F.expr("term_id div 4 - 3").alias("term_id"),
        (F.col("cnt") - 1).alias("cnt"),
    )
    declared = corpus.docs.select(
        F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("doc_id"),
        F.expr("num_unique div 2").alias("declared"),
    )
    found = source.check_pairs(declared.join(faulty, "doc_id", "left"))
    return found.na.fill(-1000000, ["term_id"])  # rows about whole documents have no term


@query
def matrix_read(spark, folder):
    path = f"{RunFolder(spark, 'query').path}/matrix"
    matrix_text.write_matrix(inputs.embedding_matrix(spark, folder), path)
    return matrix_text.read_matrix(spark, path)


@query
def matrix_export(spark, folder):
    return matrix_text.matrix_lines(inputs.embedding_matrix(spark, folder))


@query
def model_save_load(spark, folder):
    """The topics after one iteration, written and read back."""
    model = fit_topics(text_corpus(spark, folder).corpus, K, correlated=False, max_iter=1)
    path = f"{RunFolder(spark, 'query').path}/model"
    model.save(path)
    return spread(Model.load(spark, path).topic_terms, ["term_id"], gam="gam")


# --- projections -------------------------------------------------------------------------------------


@query
def doc_term_freq(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    return source.term_frequencies(corpus.doc_terms, corpus.docs)


def _arguments(spark, folder):
    x = F.col("cnt") * 0.25 + (F.col("term_id") % 97) / 10 + 0.05
    return text_corpus(spark, folder).corpus.doc_terms.select("doc_id", "term_id", x.alias("x"))


@query
def fn_digamma(spark, folder):
    return _arguments(spark, folder).select("doc_id", "term_id", rounded(digamma("x")).alias("value"))


@query
def fn_lgamma(spark, folder):
    return _arguments(spark, folder).select("doc_id", "term_id", rounded(lgamma("x")).alias("value"))


@query
def doc_elnz(spark, folder):
    docs = inputs.document_state(text_corpus(spark, folder).corpus)
    return spread(expected_log_weights(docs), ["doc_id"], elnz="elnz")


def _topic_logs(corpus):
    return expected_log_topics(inputs.topic_state(corpus), inputs.topic_state_totals(corpus))


@query
def topic_elneta(spark, folder):
    return spread(_topic_logs(text_corpus(spark, folder).corpus), ["term_id"], elneta="elneta")


# --- joins and responsibilities ----------------------------------------------------------------------


def _scores(corpus):
    return token_scores(corpus, _topic_logs(corpus), expected_log_weights(inputs.document_state(corpus)), K)


@query
def token_scores_(spark, folder):
    return spread(_scores(text_corpus(spark, folder).corpus), ["doc_id", "term_id", "cnt"], score="score")


@query
def token_responsibilities(spark, folder):
    scores = _scores(text_corpus(spark, folder).corpus)
    return spread(responsibilities(scores, K), ["doc_id", "term_id", "cnt"], r="r")


def _counts(corpus):
    elnz = expected_log_weights(inputs.document_state(corpus))
    return expected_counts(corpus, log_vectors(_topic_logs(corpus), elnz), K)


@query
def topic_term_update(spark, folder):
    counts = _counts(text_corpus(spark, folder).corpus).where("kind = 1")
    gam = counts.select(F.col("id").alias("term_id"), per_topic(K, lambda i: f"vec[{i}] + 0.5D").alias("gam"))
    return spread(gam, ["term_id"], gam="gam")


@query
def doc_topic_counts(spark, folder):
    counts = _counts(text_corpus(spark, folder).corpus).where("kind = 0")
    return spread(counts.select(F.col("id").alias("doc_id"), "vec"), ["doc_id"], vec="n")


# --- k-means -----------------------------------------------------------------------------------------


def _first_pass(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    run = RunFolder(spark, "query")
    seeds = run.write(kmeans.seed_documents(corpus.docs, K), "seeds")
    centroids = run.write(kmeans.seed_centroids(corpus, seeds, K), "centroids")
    return corpus, kmeans.distances(corpus, centroids, K)


@query
def kmeans_seed_docs(spark, folder):
    return kmeans.seed_documents(text_corpus(spark, folder).corpus.docs, K)


@query
def kmeans_distance(spark, folder):
    return spread(_first_pass(spark, folder)[1], ["doc_id"], dist="d")


@query
def kmeans_assign(spark, folder):
    return kmeans.assign(_first_pass(spark, folder)[1])


@query
def kmeans_centroids(spark, folder):
    corpus, dist = _first_pass(spark, folder)
    assigned = RunFolder(spark, "query").write(kmeans.assign(dist), "assigned")
    centroids = kmeans.centroid_rows(kmeans.mean_centroids(corpus, assigned, K))
    return centroids.select("k", "term_id", rounded("value", 9).alias("value"))


@query
def kmeans_relabel(spark, folder):
    return kmeans.relabel(kmeans.cluster_sizes(kmeans.assign(_first_pass(spark, folder)[1])), K)


@query
def kmeans_fit(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    centroids, _ = kmeans.fit_kmeans(corpus, K, passes=2, run=RunFolder(spark, "query"))
    return spread(centroids, ["term_id"], 9, vec="c")


@query
def topic_init(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    gam = start_topics(corpus, K, 0.5 * corpus.vocab_size, 1, 0, True, RunFolder(spark, "query"))
    return spread(gam, ["term_id"], gam="gam")


# --- document and global updates ---------------------------------------------------------------------


@query
def doc_gamma_update(spark, folder):
    docs = updates.gamma_posterior(inputs.document_state(text_corpus(spark, folder).corpus), BETA * WEIGHTS)
    return spread(docs, ["doc_id"], a="a", b="b")


@query
def doc_normal_update(spark, folder):
    docs = inputs.document_state(text_corpus(spark, folder).corpus)
    moved = updates.normal_update(docs, BETA * WEIGHTS, MEAN, np.linalg.inv(COVARIANCE))
    return spread(moved, ["doc_id"], mu="mu", sig="sig")


@query
def topic_global_stats(spark, folder):
    sums = updates.global_sums(inputs.document_state(text_corpus(spark, folder).corpus), K)
    return spread(sums, ["num_docs"], mu="mu", lnz="lnz")


@query
def topic_global_update(spark, folder):
    """Sticks, weights and both scales after one update from the corpus sums."""
    sums = updates.global_sums(inputs.document_state(text_corpus(spark, folder).corpus), K).first()
    pull = np.array(sums["mu"]) + np.array(sums["lnz"])
    v = updates.update_sticks(STICKS, ALPHA, BETA, pull, sums["num_docs"])
    p = updates.stick_weights(v)
    alpha, beta = updates.update_alpha(v), updates.update_beta(BETA, p, pull, sums["num_docs"])
    rows = [(i, float(v[i]), float(p[i]), float(alpha), float(beta)) for i in range(K)]
    return spark.createDataFrame(rows, "k int, v double, p double, alpha double, beta double")


@query
def topic_mean(spark, folder):
    means = updates.topic_mean(inputs.document_state(text_corpus(spark, folder).corpus), K)
    return means.select("k", rounded("u", 8).alias("u"))


@query
def topic_covariance(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    cov = updates.topic_covariance(inputs.document_state(corpus), K, corpus.num_docs)
    return cov.select("i", "j", rounded("value", 8).alias("value"))


@query
def stick_weights(spark, folder):
    """One stick set per document, from its closed-form shapes."""
    docs = inputs.document_state(text_corpus(spark, folder).corpus)
    v = F.expr("if(k < 2, x / (x + 3D), 0.9D)")
    sticks = docs.select(F.col("doc_id").alias("group_id"), F.posexplode("a").alias("k", "x"))
    out = updates.stick_table(sticks.select("group_id", "k", v.alias("v")))
    return out.select("group_id", "k", *[rounded(c).alias(c) for c in ("v", "left", "p")])


# --- bound -------------------------------------------------------------------------------------------


def _bound_parts(corpus) -> dict[str, DataFrame]:
    docs, topics = inputs.document_state(corpus), inputs.topic_state(corpus)
    totals, gamma = inputs.topic_state_totals(corpus), 0.5 * corpus.vocab_size
    return {
        "tokens": bound.bound_tokens(_counts(corpus)),
        "topics": bound.bound_topics(topics, totals, corpus.seen_terms, corpus.vocab_size, gamma),
        "docs": bound.bound_docs(docs),
        "global": bound.bound_global(updates.global_sums(docs, K), WEIGHTS, STICKS, ALPHA, BETA),
        "gaussian": bound.bound_gaussian(docs, MEAN, COVARIANCE),
    }


def _part(spark, folder, name):
    part = _bound_parts(text_corpus(spark, folder).corpus)[name]
    return part.select(*[rounded(c, 2).alias(c) for c in part.columns])


@query
def bound_tokens(spark, folder):
    return _part(spark, folder, "tokens")


@query
def bound_topics(spark, folder):
    return _part(spark, folder, "topics")


@query
def bound_docs(spark, folder):
    return _part(spark, folder, "docs")


@query
def bound_global(spark, folder):
    return _part(spark, folder, "global")


@query
def bound_gaussian(spark, folder):
    return _part(spark, folder, "gaussian")


@query
def bound_total(spark, folder):
    total = bound.bound_total(*_bound_parts(text_corpus(spark, folder).corpus).values())
    return total.select(*[rounded(c, 2).alias(c) for c in total.columns])


# --- fits --------------------------------------------------------------------------------------------


@query
def topics_hdp_fit(spark, folder):
    model = fit_topics(text_corpus(spark, folder).corpus, K, correlated=False, max_iter=1)
    return spread(model.doc_topics, ["doc_id"], n="n", a="a", b="b")


@query
def topics_correlated_fit(spark, folder):
    model = fit_topics(text_corpus(spark, folder).corpus, 5, correlated=True, max_iter=4, learn_beta=True)
    return model.topic_cov.join(model.topics.withColumnRenamed("k", "i"), "i")


@query
def fit_trace(spark, folder):
    model = fit_topics(text_corpus(spark, folder).corpus, 5, correlated=False, max_iter=20, tol=5e-3)
    return model.trace.drop("seconds")


# --- held-out evaluation -----------------------------------------------------------------------------


def _state_model(corpus) -> Model:
    state = Globals(
        STICKS, WEIGHTS, np.zeros(K), np.eye(K), ALPHA, BETA, inputs.topic_state_totals(corpus)
    )
    docs = inputs.document_state(corpus)
    return Model(
        corpus.spark, inputs.topic_state(corpus), docs, state, 0.5 * corpus.vocab_size, corpus.vocab_size, False
    )


@query
def heldout_split(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    return heldout.split_heldout(corpus.doc_terms, corpus.docs)


@query
def fold_in_(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    docs = fold_in(_state_model(corpus), corpus, max_iter=1).docs
    return spread(docs, ["doc_id"], n="n", a="a", b="b")


@query
def heldout_loglik(spark, folder):
    corpus = text_corpus(spark, folder).corpus
    return evaluate_heldout(_state_model(corpus), corpus.doc_terms, doc_ids=corpus.docs).docs


def _plugin(corpus):
    topics = heldout.mean_topics(inputs.topic_state(corpus), inputs.topic_state_totals(corpus))
    return heldout.plugin_loglik(corpus, topics, heldout.mean_weights(inputs.document_state(corpus)))


@query
def heldout_loglik_plugin(spark, folder):
    values = _plugin(text_corpus(spark, folder).corpus)
    return values.select("doc_id", "words", rounded("loglik", 5).alias("loglik"))


@query
def heldout_summary(spark, folder):
    summary = heldout.heldout_summary(_plugin(text_corpus(spark, folder).corpus))
    return summary.select(*[rounded(c, 8).alias(c) for c in summary.columns])


@query
def log_mean_exp(spark, folder):
    """Over the log frequencies of a document's terms."""
    corpus = text_corpus(spark, folder).corpus
    freq = source.term_frequencies(corpus.doc_terms, corpus.docs)
    values = freq.select("doc_id", F.col("term_id").alias("sample"), F.ln("freq").alias("x"))
    return heldout.log_mean_exp(values).select("doc_id", rounded("loglik", 8).alias("loglik"))


# --- matrices ----------------------------------------------------------------------------------------


@query
def matrix_vector(spark, folder):
    """A x and, from the result, A' (A x)."""
    a = inputs.embedding_matrix(spark, folder)
    ax = matrix.matrix_vector(a, inputs.embedding_weights(a))
    back = matrix.matrix_vector(a, ax, transpose=True)
    named = lambda df, name: df.select(F.lit(name).alias("op"), "i", rounded("value").alias("value"))
    return named(ax, "ax").unionAll(named(back, "atax"))


@query
def matrix_multiply(spark, folder):
    """Vectors times the per-label column sums."""
    a = inputs.embedding_matrix(spark, folder)
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("bigint").alias("label"))
    b = a.join(labels, "i").groupBy(F.col("j").alias("i"), F.col("label").alias("j")).agg(F.sum("value").alias("value"))
    return matrix.matrix_multiply(a, b).select("i", "j", rounded("value", 5).alias("value"))


@query
def matrix_gram(spark, folder):
    return matrix.gram(inputs.embedding_matrix(spark, folder)).select("i", "j", rounded("value").alias("value"))


@query
def matrix_multiply_terms(spark, folder):
    """Documents x terms times terms x languages: a sparse product with common and rare inner indices."""
    corpus = text_corpus(spark, folder).corpus
    lang = table(spark, folder, "documents").select("doc_id", F.ascii(F.col("lang")).cast("bigint").alias("j"))
    terms = corpus.doc_terms.select(F.col("doc_id").alias("i"), F.col("term_id").alias("j"), F.col("cnt").cast("double").alias("value"))
    by_lang = corpus.doc_terms.join(lang.hint("shuffle_hash"), "doc_id").groupBy(F.col("term_id").alias("i"), "j").agg(F.sum("cnt").cast("double").alias("value"))
    run = RunFolder(spark, "query")
    product = matrix.matrix_multiply(terms, run.write(by_lang, "languages"))
    return product.select("i", "j", rounded("value", 3).alias("value"))


@query
def matrix_gram_terms(spark, folder):
    """What documents share: products of their term counts, for all pairs with a term in common."""
    corpus = text_corpus(spark, folder).corpus
    terms = corpus.doc_terms.select(F.col("term_id").alias("i"), F.col("doc_id").alias("j"), F.col("cnt").cast("double").alias("value"))
    return matrix.gram(RunFolder(spark, "query").write(terms, "terms")).select("i", "j", rounded("value", 3).alias("value"))


@query
def matrix_sums(spark, folder):
    a = inputs.embedding_matrix(spark, folder)
    named = lambda dim: matrix.matrix_sums(a, dim).select(
        F.lit(dim).alias("dim"), "i", rounded("value").alias("value")
    )
    return named(1).unionAll(named(2))


@query
def matrix_normalize(spark, folder):
    a = inputs.embedding_matrix(spark, folder)
    named = lambda dim: matrix.normalize(a, dim).select(
        F.lit(dim).alias("dim"), "i", "j", rounded("value").alias("value")
    )
    return named(1).unionAll(named(2))


@query
def matrix_elementwise(spark, folder):
    a = inputs.embedding_matrix(spark, folder)
    b = a.select("i", "j", F.abs("value").alias("value")).where("value > 0.05")
    x = inputs.embedding_weights(a)
    low = a.groupBy(F.col("j").alias("i")).agg(F.min("value").alias("value"))
    flat = F.lit(0).cast("bigint").alias("j")
    parts = {
        "product": matrix.elementwise_product(a, b),
        "difference": matrix.difference(a, b),
        "scaled": a.select("i", "j", (F.col("value") * 2.5).alias("value")),
        "absolute": a.select("i", "j", F.abs("value").alias("value")),
        "column": a.where("j = 7"),
        "vector_product": matrix.elementwise_product(x, low).select("i", flat, "value"),
        "vector_difference": matrix.difference(x, low).select("i", flat, "value"),
        "vector_norm": matrix.normalize_vector(x).select("i", flat, "value"),
        "dot": matrix.dot_product(x, low).select(F.lit(0).cast("bigint").alias("i"), flat, "value"),
    }
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("op"), "i", "j", rounded("value").alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


# two names are also the names of the functions they call
_queries["token_scores"] = _queries.pop("token_scores_")
_queries["fold_in"] = _queries.pop("fold_in_")

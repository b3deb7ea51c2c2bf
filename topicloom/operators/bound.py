"""The terms of the evidence lower bound, each a sum over one table.

Every function returns a one-row DataFrame, so a bound is a handful of aggregates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.special import (
    digamma_array,
    lgamma_array_sum,
    np_digamma,
    np_lgamma,
)
from topicloom.functions.vectors import (
    dot_sql,
    expected_rate_sql,
    literal_sql,
    number,
    ratio_sql,
    total_sql,
)
from topicloom.operators.responsibilities import LOG_WEIGHT
from topicloom.operators.updates import normal_moments
from topicloom.sources.prepared import ASSIGN, BLOCK


def bound_tokens(counts: DataFrame) -> DataFrame:
    """``(token_entropy, token_loglik)`` from the expected counts of a token pass.

    The log-likelihood covers words and topic assignments. Both were summed in the blocks of the pass.
    """
    part = lambda kind, i: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("vec")[i])), F.lit(0.0))
    return counts.where(F.col("kind").isin(BLOCK, ASSIGN)).agg(
        part(BLOCK, 0).alias("token_entropy"), (part(BLOCK, 1) + part(ASSIGN, 0)).alias("token_loglik")
    )


def bound_topics(gam: DataFrame, totals, seen_terms: int, vocab_size: int, gamma: float) -> DataFrame:
    """``(topic_prior, topic_entropy)``; ids that never occur hold gamma/D and are added in closed form."""
    totals = np.asarray(totals, dtype=float)
    k, flat, unseen = len(totals), gamma / vocab_size, vocab_size - seen_terms
    psi_total = np_digamma(totals)
    elneta = f"zip_with(psi, {literal_sql(psi_total)}, (x, s) -> x - s)"
    rows = gam.select("gam", digamma_array("gam").alias("psi"), lgamma_array_sum("gam").alias("lng"))
    sums = rows.select(
        F.expr(total_sql(elneta)).alias("elneta"),
        F.expr(total_sql(f"zip_with(gam, {elneta}, (g, e) -> (g - 1D) * e)")).alias("weighted"),
        "lng",
    ).agg(F.sum("elneta").alias("elneta"), F.sum("weighted").alias("weighted"), F.sum("lng").alias("lng"))
    flat_elneta = float((np_digamma(flat) - psi_total).sum()) * unseen
    const_prior = k * float(np_lgamma(gamma) - vocab_size * np_lgamma(flat))
    const_entropy = unseen * k * float(np_lgamma(flat)) - float(np_lgamma(totals).sum()) - (flat - 1.0) * flat_elneta
    return sums.select(
        (const_prior + (flat - 1.0) * (F.col("elneta") + flat_elneta)).alias("topic_prior"),
        (const_entropy + F.col("lng") - F.col("weighted")).alias("topic_entropy"),
    )


def with_logs(docs: DataFrame) -> DataFrame:
    """``docs`` with digamma of the shapes and the sum of their log-gamma."""
    return docs.select("*", digamma_array("a").alias("psi_a"), lgamma_array_sum("a").alias("lng_a"))


def doc_terms_of_bound(docs: DataFrame) -> DataFrame:
    """Per document of ``with_logs``: ``elnz`` and the gamma entropy, normaliser and rate terms.

    ``settled`` is the entropy plus (a - 1) E[ln Z]: what is left where a is the prior plus the counts.
    """
    mean = ratio_sql("a", "b")
    entropy = total_sql("zip_with(zip_with(a, psi_a, (x, s) -> x + (1D - x) * s), b, (x, y) -> x - ln(y))")
    return docs.select(
        "doc_id",
        "num_words",
        "n",
        "mu",
        "sig",
        F.expr(LOG_WEIGHT).alias("elnz"),
        F.expr(f"{entropy} + lng_a").alias("entropy"),
        F.expr(f"{total_sql('zip_with(a, b, (x, y) -> x - x * ln(y))')} + lng_a").alias("settled"),
        F.expr(f"-num_words * ln({total_sql(mean)})").alias("normaliser"),
        F.expr(f"-{dot_sql(mean, expected_rate_sql('mu', 'sig'))}").alias("rate"),
    )


def bound_docs(docs: DataFrame) -> DataFrame:
    """``(weight_entropy, normaliser, weight_rate)``: gamma entropy, the bound on the log normaliser of each
    document at its tightest point, and minus the expected weight times rate."""
    return doc_terms_of_bound(with_logs(docs)).agg(
        F.sum("entropy").alias("weight_entropy"),
        F.sum("normaliser").alias("normaliser"),
        F.sum("rate").alias("weight_rate"),
    )


def stick_prior(v, alpha: float) -> float:
    v = np.asarray(v, dtype=float)
    return float((len(v) - 1) * np.log(alpha) + (alpha - 1.0) * np.log1p(-v[:-1]).sum())


def bound_global(sums: DataFrame, p, v, alpha: float, beta: float) -> DataFrame:
    """``(weight_prior, stick_prior)`` over the one row of corpus sums."""
    bp = [beta * float(x) for x in p]
    constant = number(float(np_lgamma(np.array(bp)).sum()))
    weight_prior = (
        f"{dot_sql('mu', literal_sql(bp))} - num_docs * {constant}"
        f" + {dot_sql('lnz', literal_sql([x - 1.0 for x in bp]))}"
    )
    return sums.select(F.expr(weight_prior).alias("weight_prior"), F.lit(stick_prior(v, alpha)).alias("stick_prior"))


def gaussian_value(m: np.ndarray, center, u, cov, num_docs: int) -> float:
    """The Gaussian term from the K x (K + 3) sums of ``normal_moments`` around ``center``."""
    u, center = np.asarray(u, dtype=float), np.asarray(center, dtype=float)
    k = len(u)
    inv = np.linalg.inv(cov)
    delta, off = u - center, m[:, k]
    scatter = m[:, :k] - np.outer(off, delta) - np.outer(delta, off) + num_docs * np.outer(delta, delta)
    return float(
        -0.5 * num_docs * np.linalg.slogdet(cov)[1]
        - 0.5 * (inv * scatter).sum()
        - 0.5 * np.diag(inv) @ m[:, k + 1]
        + 0.5 * m[:, k + 2].sum()
        + 0.5 * num_docs * k
    )


def bound_gaussian(docs: DataFrame, u, cov) -> DataFrame:
    """``(gaussian)`` of the documents' mu and sig under the normal (u, cov).

    One pass leaves sums over i, j; the K x K precision turns them into the quadratic form.
    """
    u, cov = np.asarray(u, dtype=float), np.asarray(cov, dtype=float)
    k, inv = len(u), np.linalg.inv(np.asarray(cov, dtype=float))
    sums = normal_moments(docs, u)
    precision = literal_sql(inv.ravel())
    part = F.expr(
        f"CASE WHEN j < {k} THEN -0.5D * {precision}[i * {k} + j] * value"
        f" WHEN j = {k + 1} THEN -0.5D * {precision}[i * {k + 1}] * value"
        f" WHEN j = {k + 2} THEN 0.5D * value ELSE 0D END"
    )
    count = docs.agg(F.count("*").alias("c")).scalar()
    const = 0.5 * k - 0.5 * float(np.linalg.slogdet(cov)[1])
    return sums.agg((F.sum(part) + count * const).alias("gaussian"))


def bound_total(*parts: DataFrame) -> DataFrame:
    """One row with every named term and their sum as ``bound``; each part is one row."""
    named = None
    for part in parts:
        terms = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("value")) for c in part.columns])
        rows = part.select(F.explode(terms).alias("t")).select("t.*")
        named = rows if named is None else named.unionAll(rows)
    names = [c for part in parts for c in part.columns]
    return named.agg(
        *[F.sum(F.when(F.col("term") == c, F.col("value"))).alias(c) for c in names], F.sum("value").alias("bound")
    )

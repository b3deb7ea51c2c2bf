"""Per-document posterior updates and the corpus sums behind the global ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.special import digamma_array, np_digamma, np_lgamma, np_trigamma
from topicloom.functions.vectors import (
    expected_rate_sql,
    literal_sql,
    per_topic,
    ratio_sql,
    sum_vectors,
    total_sql,
)
from topicloom.operators.responsibilities import LOG_WEIGHT

# Bounds that keep digamma and log-gamma of beta * p finite.
SMALLEST_WEIGHT = 1e-12
LARGEST_STICK = 1.0 - 1e-12
STICK_STEPS = 20
BETA_STEPS = 20



# --- documents ---------------------------------------------------------------------------------------


def gamma_posterior(docs: DataFrame, beta_p) -> DataFrame:
    """New ``a`` and ``b`` of documents ``(doc_id, num_words, n, a, b, mu, sig)``.

    The old a and b only enter through xi, the expected sum of the weights. A document without words
    keeps its prior: a = beta p, b = exp(mu + sig / 2).
    """
    per_word = docs.withColumn("_pull", F.expr(f"num_words / {total_sql(ratio_sql('a', 'b'))}"))
    return per_word.select(
        "doc_id",
        "num_words",
        "n",
        F.expr(f"zip_with(n, {literal_sql(beta_p)}, (x, y) -> x + y)").alias("a"),
        F.expr(f"transform({expected_rate_sql('mu', 'sig')}, e -> e + _pull)").alias("b"),
        "mu",
        "sig",
    )


def normal_update(docs: DataFrame, beta_p, u, inv_cov, steps: int = 1) -> DataFrame:
    """``docs`` with ``mu`` and ``sig`` moved ``steps`` times uphill on the per-document objective.

    Narrow: each Arrow batch is one matrix problem, batch x K against the K x K precision.
    """
    beta_p, u, inv_cov = (np.asarray(x, dtype=float) for x in (beta_p, u, inv_cov))
    k = len(u)

    def update(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b, mu, sig = (_matrix(batch, name, k) for name in ("a", "b", "mu", "sig"))
            for _ in range(steps):
                mu, sig = ascend(mu, sig, a / b, beta_p, u, inv_cov)
            columns = [
                _lists(mu) if name == "mu" else _lists(sig) if name == "sig" else batch.column(name)
                for name in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(update, docs.schema)


def ascend(mu, sig, weight, beta_p, u, inv_cov):
    """One gradient step per document in (mu, ln sig); the step is the best of a ladder, or none.

    A step is taken only if it raises the document's objective. Lengths 4, 2, 1, 1/2, ... are tried; a
    document leaves the search when a shorter step does worse than its best so far.
    """
    diag = np.diag(inv_cov)
    s = np.log(sig)

    def value(rows, m, ln_v):
        v = np.exp(ln_v)
        off = m - u
        with np.errstate(over="ignore", invalid="ignore"):
            return (
                (m * beta_p - weight[rows] * np.exp(m + 0.5 * v) - 0.5 * v * diag + 0.5 * ln_v).sum(axis=1)
                - 0.5 * ((off @ inv_cov) * off).sum(axis=1)
            )

    pull = weight * np.exp(mu + 0.5 * sig)
    d_mu = beta_p - pull - (mu - u) @ inv_cov
    d_s = 0.5 - 0.5 * sig * (pull + diag)
    active = np.arange(len(mu))
    best = value(active, mu, s)
    best_step = np.zeros(len(mu))
    for power in range(2, -40, -1):
        step = 2.0**power
        with np.errstate(over="ignore", invalid="ignore"):
            now = value(active, mu[active] + step * d_mu[active], np.minimum(s[active] + step * d_s[active], 700.0))
        better = now > best[active]
        best[active[better]] = now[better]
        best_step[active[better]] = step
        active = active[better | (best_step[active] == 0.0)]
        if len(active) == 0:
            break
    return mu + best_step[:, None] * d_mu, np.exp(s + best_step[:, None] * d_s)


def _matrix(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(rows.ravel()))


# --- corpus sums -------------------------------------------------------------------------------------


def global_sums(docs: DataFrame, k: int) -> DataFrame:
    """One row: ``num_docs``, and per topic the sums of mu and of E[ln Z] as vectors ``mu`` and ``lnz``."""
    logs = docs.select("mu", "b", digamma_array("a").alias("psi_a"))
    return logs.select("mu", F.expr(LOG_WEIGHT).alias("elnz")).agg(
        F.count("*").alias("num_docs"), sum_vectors("mu", k).alias("mu"), sum_vectors("elnz", k).alias("lnz")
    )


def topic_mean(docs: DataFrame, k: int) -> DataFrame:
    """``(k, u)``: the mean of mu over the documents."""
    row = docs.agg(per_topic(k, lambda i: f"avg(mu[{i}])").alias("u"))
    return row.select(F.posexplode("u").alias("k", "u"))


def normal_moments(docs: DataFrame, center) -> DataFrame:
    """``(i, j, value)`` sums over the documents, taken around ``center`` so that no digits are lost.

    i, j < K: (mu_i - c_i)(mu_j - c_j); j = K: mu_i - c_i; j = K + 1: sig_i; j = K + 2: ln sig_i.
    Each Arrow batch is reduced to K x (K + 3) numbers before anything is shuffled.
    """
    center = np.asarray(center, dtype=float)
    k = len(center)

    def reduce(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            off, sig = _matrix(batch, "mu", k) - center, _matrix(batch, "sig", k)
            sums = [off.sum(axis=0), sig.sum(axis=0), np.log(np.where(sig > 0, sig, 1.0)).sum(axis=0)]
            table = np.column_stack([off.T @ off, *sums])
            i, j = np.indices(table.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(table.ravel())], names=["i", "j", "value"]
            )

    shares = docs.select("mu", "sig").mapInArrow(reduce, "i int, j int, value double")
    return shares.groupBy("i", "j").agg(F.sum("value").alias("value"))


def topic_covariance(docs: DataFrame, k: int, num_docs: int) -> DataFrame:
    """``(i, j, value)``: covariance of mu over the documents, plus the mean of sig on the diagonal."""
    center = np.array([r.u for r in topic_mean(docs, k).orderBy("k").collect()])  # K numbers
    sums = normal_moments(docs, center)
    main = sums.where(F.col("j") < k)
    sig = sums.where(F.col("j") == k + 1).select("i", F.col("i").alias("j"), "value")
    return (
        main.unionByName(sig).groupBy("i", "j").agg((F.sum("value") / num_docs).alias("value"))
    )


# --- sticks ------------------------------------------------------------------------------------------


def uniform_sticks(k: int) -> np.ndarray:
    """Stick proportions under which every one of k weights is 1/k."""
    return 1.0 / np.arange(k, 0, -1)


def stick_table(sticks: DataFrame) -> DataFrame:
    """``(group_id, k, v, left, p)`` of many stick sets ``(group_id, k, v)`` at once.

    ``left`` is what earlier breaks leave over, a running product. It is taken in logarithms; where a break took
    all (v = 1, or above it by rounding), nothing is left for later sticks.
    """
    before = Window.partitionBy("group_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    product = F.exp(F.coalesce(F.sum(F.ln(1.0 - F.col("v"))).over(before), F.lit(0.0)))
    gone = F.coalesce(F.max(F.col("v") >= 1.0).over(before), F.lit(False))
    left = F.when(gone, F.lit(0.0)).otherwise(product)
    return sticks.select("group_id", "k", "v", left.alias("left")).withColumn("p", F.col("v") * F.col("left"))


def stick_weights(v: np.ndarray) -> np.ndarray:
    return v * np.r_[1.0, np.cumprod(1.0 - v[:-1])]


# --- global parameters: arithmetic on K numbers ---------------------------------------------------------


def stick_objective(v, alpha, beta, sums, num_docs) -> float:
    bp = beta * np.maximum(stick_weights(v), SMALLEST_WEIGHT)
    return bp @ sums - num_docs * np_lgamma(bp).sum() + (alpha - 1.0) * np.log1p(-v[:-1]).sum()


def stick_gradient(v, alpha, beta, sums, num_docs) -> np.ndarray:
    left = np.r_[1.0, np.cumprod(1.0 - v[:-1])]
    p = np.maximum(v * left, SMALLEST_WEIGHT)
    slope = beta * (sums - num_docs * np_digamma(beta * p))
    after = np.r_[np.cumsum((slope * p)[::-1])[::-1][1:], 0.0]
    open_ = np.maximum(1.0 - v, 1.0 - LARGEST_STICK)
    gradient = left * slope - (after + alpha - 1.0) / open_
    gradient[-1] = 0.0
    return gradient


def update_sticks(v, alpha, beta, sums, num_docs) -> np.ndarray:
    """Quasi-Newton ascent on the stick objective; ``sums`` is the corpus sum of mu + E[ln Z] per topic.

    In u = logit(v) every real vector is a valid set of sticks, so no step needs a limit. A step is taken
    only if it raises the objective by a share of what the slope promises.
    """

    def sticks(u):
        return np.r_[np.clip(1.0 / (1.0 + np.exp(-np.clip(u, -700, 700))), 1.0 - LARGEST_STICK, LARGEST_STICK), 1.0]

    def value_at(u):
        return stick_objective(sticks(u), alpha, beta, sums, num_docs)

    def slope_at(u):
        x = sticks(u)
        return stick_gradient(x, alpha, beta, sums, num_docs)[:-1] * x[:-1] * (1.0 - x[:-1])

    def first_scale(slope):
        return np.eye(len(slope)) / max(np.abs(slope).max(initial=0.0), 1e-12)

    free = np.clip(v[:-1], 1.0 - LARGEST_STICK, LARGEST_STICK)
    u = np.log(free) - np.log1p(-free)
    value, slope = value_at(u), slope_at(u)
    inverse = first_scale(slope)
    for _ in range(STICK_STEPS):
        move = inverse @ slope
        if not np.isfinite(move).all() or slope @ move <= 0:
            inverse = first_scale(slope)
            move = inverse @ slope
        length = 1.0
        while length > 1e-10 and not value_at(u + length * move) >= value + 1e-4 * length * (slope @ move):
            length /= 2
        if length <= 1e-10:
            break
        before, moved = slope, length * move
        u = u + moved
        value, slope = value_at(u), slope_at(u)
        bend = before - slope
        if moved @ bend > 1e-12:
            keep = np.eye(len(u)) - np.outer(moved, bend) / (moved @ bend)
            inverse = keep @ inverse @ keep.T + np.outer(moved, moved) / (moved @ bend)
    return sticks(u) if value > stick_objective(v, alpha, beta, sums, num_docs) else v.copy()


def update_alpha(v) -> float:
    return -(len(v) - 1) / np.log1p(-np.minimum(v[:-1], LARGEST_STICK)).sum()


def beta_objective(beta, p, sums, num_docs) -> float:
    return beta * (p @ sums) - num_docs * np_lgamma(beta * p).sum()


def update_beta(beta, p, sums, num_docs) -> float:
    """Newton steps on the (concave) objective of the scale; a step is halved until it helps."""
    value = beta_objective(beta, p, sums, num_docs)
    for _ in range(BETA_STEPS):
        slope = p @ sums - num_docs * (p @ np_digamma(beta * p))
        move = slope / (num_docs * (p * p) @ np_trigamma(beta * p))
        step = 1.0
        while step > 1e-9:
            trial = beta + step * move
            now = beta_objective(trial, p, sums, num_docs) if trial > 0 else -np.inf
            if now > value:
                break
            step *= 0.5
        else:
            return beta
        beta, value = trial, now
    return beta

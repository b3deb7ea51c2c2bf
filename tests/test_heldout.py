import numpy as np
import pyarrow as pa
import pytest
from conftest import TINY, counts_matrix, doc_ids, doc_terms
from pyspark.sql import functions as F
from test_fit import matrix

from topicloom import evaluate_heldout, fit_topics, fold_in, prepare_corpus
from topicloom.operators import heldout
from topicloom.sources.corpus import doc_stats


def parts(df):
    return {(r["doc_id"], r["term_id"], r["part"]): r["cnt"] for r in df.collect()}


def test_split_keeps_every_token_and_cuts_at_the_half(spark, sampled):
    data, m, d = sampled
    table = doc_terms(spark, data)
    got = parts(heldout.split_heldout(table, doc_stats(table), 0.5, seed=9))
    total, test = np.zeros((m, d)), np.zeros((m, d))
    for (doc, term, part), n in got.items():
        total[doc, term] += n
        test[doc, term] += n * (part == "test")
    x = counts_matrix(data, m, d)
    assert np.array_equal(total, x)
    assert np.array_equal(test.sum(1), np.floor(x.sum(1) * 0.5))
    assert got != parts(heldout.split_heldout(table, doc_stats(table), 0.5, seed=10))


def test_slicing_large_documents_changes_nothing(spark):
    rows = [(0, t, 1 + 37 * (t % 5)) for t in range(60)] + [(1, 3, 4)]
    table = doc_terms(spark, rows)
    whole = parts(heldout.split_heldout(table, doc_stats(table)))
    assert parts(heldout.split_heldout(table, doc_stats(table), slice_tokens=50)) == whole


def test_counts_beyond_one_chunk_of_copies(spark):
    table = doc_terms(spark, [(0, 0, 25_001), (0, 1, 3)])
    got = parts(heldout.split_heldout(table, doc_stats(table)))
    assert sum(n for (_, _, part), n in got.items() if part == "test") == 12_502
    assert sum(n for (_, term, _), n in got.items() if term == 0) == 25_001


def test_fold_in_of_the_training_documents_matches_dense_updates(spark, tiny):
    model = fit_topics(tiny, 3, correlated=False, max_iter=3)
    docs = fold_in(model, tiny, max_iter=8, tol=1e-12).docs
    from twin import psi

    x = counts_matrix(TINY, 6, 8)
    gam = matrix(model.topic_terms, "term_id", "gam", 8, model.gamma / 8)
    eln = psi(gam) - psi(gam.sum(0))
    a, b = np.full((6, 3), 10.0), np.full((6, 3), 10.0)
    for _ in range(8):
        s = eln[None] + (psi(a) - np.log(b))[:, None]
        r = np.exp(s - s.max(2, keepdims=True))
        n = (x[:, :, None] * (r / r.sum(2, keepdims=True))).sum(1)
        xi = (a / b).sum(1)
        a, b = n + model.globals.beta_p, (x.sum(1) / xi)[:, None] + 1.0 + np.zeros((6, 3))
    assert np.allclose(matrix(docs, "doc_id", "a", 6), a, atol=1e-5)
    assert np.allclose(matrix(docs, "doc_id", "b", 6), b, atol=1e-5)


def test_fold_in_bound_rises_and_stops(spark, sampled):
    data, m, d = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), vocab_size=d)
    model = fit_topics(corpus, 4, max_iter=3)
    trace = fold_in(model, corpus, max_iter=4, tol=1e-3, min_iter=3).trace
    bounds = np.array([t[1] for t in trace])
    assert (np.diff(bounds) > -1e-8 * np.abs(bounds[1:])).all()
    other = prepare_corpus(doc_terms(spark, [(0, d + 5, 1)]))
    with pytest.raises(ValueError):
        fold_in(model, other, max_iter=1)


def test_monte_carlo_matches_dense_sampling(spark, tiny):
    model = fit_topics(tiny, 3, correlated=False, max_iter=4)
    gam, docs = model.topic_terms, model.doc_topics
    samples = 3000
    got = heldout.sampled_loglik(tiny, gam, docs, model.globals.totals, samples, seed=5)
    logs = {r["doc_id"]: r["loglik"] for r in heldout.log_mean_exp(got).collect()}
    x, rng = counts_matrix(TINY, 6, 8), np.random.default_rng(0)
    g = matrix(gam, "term_id", "gam", 8, model.gamma / 8)
    a, b = matrix(docs, "doc_id", "a", 6), matrix(docs, "doc_id", "b", 6)
    draws = np.empty((samples, 6))
    for s in range(samples):
        eta = np.array([rng.dirichlet(g[:, k]) for k in range(3)])
        z = rng.gamma(a) / b
        draws[s] = (x * np.log((z / z.sum(1, keepdims=True)) @ eta)).sum(1)
    top = draws.max(0)
    expected = top + np.log(np.exp(draws - top).mean(0))
    assert np.allclose([logs[d] for d in range(5)], expected[:5], atol=0.25)


def test_draws_do_not_depend_on_the_blocks(spark, sampled):
    data, m, d = sampled
    values = []
    for size in (100, 100_000):
        corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), vocab_size=d, block_pairs=size)
        model = fit_topics(corpus, 3, correlated=False, max_iter=1)
        got = heldout.sampled_loglik(corpus, model.topic_terms, model.doc_topics, model.globals.totals, 6, seed=2)
        values.append([r["x"] for r in got.orderBy("doc_id", "sample").collect()])
    assert np.allclose(values[0], values[1], rtol=1e-7)


def test_log_mean_exp_survives_large_negative_values(spark):
    rows = [(0, 0, -5000.0), (0, 1, -5001.0), (1, 0, 3.0)]
    got = {r["doc_id"]: r["loglik"] for r in heldout.log_mean_exp(spark.createDataFrame(rows, "doc_id bigint, sample int, x double")).collect()}
    assert got[0] == pytest.approx(-5000 + np.log((1 + np.exp(-1)) / 2)) and got[1] == pytest.approx(3.0)


def test_evaluation_end_to_end(spark, sampled):
    data, m, d = sampled
    train = [r for r in data if r[0] < 90]
    new = [r for r in data if r[0] >= 90]
    model = fit_topics(prepare_corpus(doc_terms(spark, train), vocab_size=d), 4, max_iter=5, kmeans_iter=2)
    result = evaluate_heldout(model, doc_terms(spark, new), num_samples=20, max_iter=4)
    summary = result.summary.first()
    assert result.docs.count() == 30
    assert -np.log(d) < summary["per_word"] < 0  # better than guessing uniformly
    by_train = evaluate_heldout(model, doc_terms(spark, new), num_samples=20, max_iter=4, per="train")
    assert by_train.docs.agg(F.sum("loglik")).first()[0] == pytest.approx(result.docs.agg(F.sum("loglik")).first()[0])


def test_documents_without_test_words_are_returned(spark, tiny):
    model = fit_topics(tiny, 3, correlated=False, max_iter=1)
    new = doc_terms(spark, [(0, 0, 4), (1, 3, 1)])
    result = evaluate_heldout(model, new, num_samples=5, doc_ids=doc_ids(spark, 3), max_iter=1)
    rows = {r["doc_id"]: r for r in result.docs.collect()}
    assert set(rows) == {0, 1, 2} and rows[0]["loglik"] < 0
    assert all((rows[d]["words"], rows[d]["loglik"], rows[d]["per_word"]) == (0, 0.0, None) for d in (1, 2))
    assert result.summary.first()["per_word"] == rows[0]["per_word"]


def test_log_mean_exp_merges_in_one_shuffle(spark):
    rng = np.random.default_rng(6)
    rows = [(d, s, float(x)) for d in range(7) for s, x in enumerate(rng.normal(-3000, 400, 50 * (d + 1)))]
    rows += [(20, s, -np.inf) for s in range(3)] + [(21, 0, -np.inf), (21, 1, 2.0), (22, 0, None), (22, 1, 5.0), (23, 0, None)]
    values = spark.createDataFrame(rows, "doc_id bigint, sample int, x double").repartition(6)
    found = heldout.log_mean_exp(values)
    got = {r["doc_id"]: r["loglik"] for r in found.collect()}
    for d in range(7):
        x = np.array([v for i, _, v in rows if i == d])
        assert got[d] == pytest.approx(x.max() + np.log(np.exp(x - x.max()).mean()))
    assert got[20] == -np.inf and got[21] == pytest.approx(2 - np.log(2)) and got[22] == 5.0 and 23 not in got
    plain = heldout.log_mean_exp(spark.createDataFrame(rows, "doc_id bigint, sample int, x double"))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1
    assert heldout.log_mean_exp(values.limit(0)).count() == 0


def test_partial_means_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(heldout, "OPEN_DOCUMENTS", 10)
    batches = [pa.record_batch({"doc_id": pa.array(range(i, i + 8)), "x": pa.array([float(i)] * 8)}) for i in range(6)]
    out = list(heldout._partial_means(iter(batches)))
    assert len(out) > 1 and sum(sum(b["n"].to_pylist()) for b in out) == 48


def test_small_shapes_stay_finite_and_whole_documents_leave_one_row(spark, sampled):
    """Shapes of 1e-6 underflow as plain draws; long documents are spread over blocks, others are not."""
    data, m, d = sampled
    long = [(m, t, 1 + t % 2) for t in range(d)]
    corpus = prepare_corpus(doc_terms(spark, data + long), doc_ids(spark, m + 1), vocab_size=d, block_pairs=160)
    assert corpus.tokens.where(F.col("doc_id") == m).select("block").distinct().count() > 1
    k = 3
    tiny_shape = lambda column: F.array(*[F.lit(1e-6) if i else F.lit(2.0) for i in range(k)]).alias(column)
    gam = corpus.needed.where("kind = 1").select(F.col("id").alias("term_id")).distinct().select("term_id", tiny_shape("gam"))
    docs = corpus.docs.select("doc_id", F.array(*[F.lit(1e-6)] * k).alias("a"), F.array(*[F.lit(1.0)] * k).alias("b"))
    totals = np.array([2.0 * d + 5, 1e-6 * d + 0.5, 1e-6 * d + 0.5])
    rows = heldout.sampled_loglik(corpus, gam, docs, totals, 8, seed=3)
    assert rows.count() == 8 * corpus.docs.where("num_words > 0").count()
    assert all(np.isfinite(r["x"]) for r in rows.collect())
    merged = {r["doc_id"]: r["loglik"] for r in heldout.log_mean_exp(rows).collect()}
    direct = {r["doc_id"]: r["loglik"] for r in heldout.predictive_loglik(corpus, gam, docs, totals, 8, seed=3).collect()}
    assert merged.keys() == direct.keys()
    assert np.allclose([direct[i] for i in merged], [merged[i] for i in merged], rtol=1e-9)


def test_logarithms_of_gamma_draws():
    for shape in (0.05, 0.7, 3.0):
        draws = heldout.log_gamma_draws(heldout._stream(1, 2, 3, 0), np.full(4, shape), 40_000)
        assert np.exp(draws).mean() == pytest.approx(shape, rel=0.05)
        from twin import psi

        assert draws.mean() == pytest.approx(float(psi(np.array(shape))), rel=0.05, abs=0.02)
    assert np.isfinite(heldout.log_gamma_draws(heldout._stream(1, 2, 3, 0), np.full(4, 1e-9), 1000)).all()


def test_an_interrupted_fold_in_goes_on(spark, sampled, tmp_path):
    data, m, d = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), vocab_size=d)
    model = fit_topics(corpus, 3, max_iter=1)
    straight = fold_in(model, corpus, max_iter=3, tol=None)
    fold_in(model, corpus, max_iter=2, tol=None, folder=str(tmp_path / "f"))
    again = fold_in(model, corpus, max_iter=3, tol=None, folder=str(tmp_path / "f"))
    assert np.allclose([t[1] for t in again.trace], [t[1] for t in straight.trace], rtol=1e-10)
    assert np.allclose(matrix(again.docs, "doc_id", "a", m), matrix(straight.docs, "doc_id", "a", m), rtol=1e-8)


@pytest.mark.parametrize("correlated", [False, True])
def test_all_iterations_at_once_are_those_one_by_one(spark, sampled, tmp_path, monkeypatch, correlated):
    """A fold-in with a folder keeps every iteration; without one they are a single pass. Two documents have no words."""
    from topicloom.operators import fold_pass
    from topicloom.plans import heldout as plan

    data, m, d = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m + 2), vocab_size=d, block_pairs=1500)
    model = fit_topics(corpus, 3, correlated=correlated, max_iter=2)
    monkeypatch.setattr(fold_pass, "AT_ONCE", 400)
    made = []
    monkeypatch.setattr(plan, "fold_blocks", lambda *args: made.append(args[-1]) or fold_pass.fold_blocks(*args))
    for number, (stop, passes) in enumerate(((dict(max_iter=5, tol=None), [5]), (dict(max_iter=9, tol=2e-3, min_iter=2), None))):
        made.clear()
        slow = fold_in(model, corpus, folder=str(tmp_path / f"f{number}"), **stop)
        assert not made
        fast = fold_in(model, corpus, **stop)
        assert made[-1] == len(fast.trace) and (passes is None or made == passes)
        assert len(fast.trace) == len(slow.trace)
        assert np.allclose([t[1] for t in fast.trace], [t[1] for t in slow.trace], rtol=1e-10)
        assert fast.docs.columns == slow.docs.columns and fast.docs.count() == m + 2
        for name in ("n", "a", "b", "mu", "sig"):
            assert np.allclose(matrix(fast.docs, "doc_id", name, m + 2), matrix(slow.docs, "doc_id", name, m + 2), rtol=1e-8)


def test_streams_are_apart_and_come_again():
    draw = lambda *at: heldout._stream(*at).standard_gamma(2.0, 3).tolist()
    places = [(s, kind, key, g) for s in (0, 1) for kind in (1, 3) for key in (-1, 0, 5) for g in (0, 1)]
    assert len({tuple(draw(*at)) for at in places}) == len(places)
    shared = heldout._Streams()
    shared(1, 1, 5, 0).integers(0, 9, 3, dtype=np.int32)
    assert [shared(*at).standard_gamma(2.0, 3).tolist() for at in places] == [draw(*at) for at in places]


def test_topic_norms_are_drawn_by_all_tasks(spark):
    """The table of terms is one file, so it used to be one task."""
    gam = spark.range(40).coalesce(1).select(F.col("id").alias("term_id"), F.array(F.lit(2.0), F.lit(0.5)).alias("gam"))
    seen, collect = [], type(gam).mapInArrow

    def watched(df, *args):
        seen.append(df.rdd.getNumPartitions())
        return collect(df, *args)

    type(gam).mapInArrow = watched
    try:
        norms = heldout.sampled_topic_norms(gam, [80.0, 20.0], 4, 0)
    finally:
        type(gam).mapInArrow = collect
    assert seen and seen[0] >= spark.sparkContext.defaultParallelism
    direct = sum(np.exp(heldout.log_gamma_draws(heldout._stream(0, 1, t, 0), np.array([2.0, 0.5]), 4)) for t in range(40))
    assert np.allclose(norms, direct)


def test_split_moves_pairs_and_not_tokens(spark, monkeypatch):
    """Batches that end within documents, repeated pairs, counts of many tokens; the same as by slices."""
    rng = np.random.default_rng(4)
    rows = [(d, int(t), int(n)) for d in range(30) for t, n in zip(rng.integers(0, 50, 40), rng.integers(0, 6, 40))] + [(40, 1, 3000)]
    table = doc_terms(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = heldout.split_heldout(table, doc_stats(table), 0.3, seed=2)
        assert got.count() == len(parts(got))
        assert parts(got) == parts(heldout.split_heldout(table, doc_stats(table), 0.3, seed=2, slice_tokens=20))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    usual = plan[plan.index("MapInArrow") : plan.index("Window")]
    assert "Window" not in plan[: plan.index("MapInArrow")] and usual.index("hashpartitioning(doc_id") > 0
    split = heldout._split_documents(0, 0.5)
    assert list(split([])) == []
    one = pa.record_batch({"doc_id": [7], "term_id": [3], "cnt": [1]})
    assert [r for b in split([one]) for r in b.to_pylist()] == [{"doc_id": 7, "term_id": 3, "part": "train", "cnt": 1}]

import itertools

import numpy as np
import pytest
from conftest import TINY, counts_matrix, doc_ids, doc_terms
from pyspark.sql import functions as F
from twin import Twin, psi

from topicloom import Model, RunFolder, fit_topics, prepare_corpus
from topicloom.operators import bound, updates
from topicloom.operators.responsibilities import (
    expected_counts,
    expected_log_topics,
    expected_log_weights,
    log_vectors,
    responsibilities,
    token_scores,
)
from topicloom.plans.fit import start_topics


def matrix(df, key, column, size, fill=0.0):
    rows = df.select(key, column).collect()
    out = np.full((size, len(rows[0][1])), fill)
    for r in rows:
        out[r[0]] = r[1]
    return out


def same_start(spark, corpus, k, gamma, vocab):
    gam = start_topics(corpus, k, gamma, 1, 0, True, RunFolder(spark, "twin"))
    return matrix(gam, "term_id", "gam", vocab, gamma / corpus.vocab_size).T


def run_twin(twin, corpus, iterations, learn_beta):
    """The same order of updates as the Spark loop; global steps use the library's K-sized arithmetic,
    which has its own tests below."""
    bounds, m = [], len(twin.x)
    for _ in range(iterations):
        twin.tokens_and_gamma()
        if twin.correlated:
            inv = np.linalg.inv(twin.cov)
            twin.mu, twin.sig = updates.ascend(twin.mu, twin.sig, twin.a / twin.b, twin.beta * twin.p, twin.u, inv)
        pull = twin.mu.sum(0) + (psi(twin.a) - np.log(twin.b)).sum(0)
        twin.v = updates.update_sticks(twin.v, twin.alpha, twin.beta, pull, m)
        twin.p = updates.stick_weights(twin.v)
        twin.alpha = updates.update_alpha(twin.v)
        if learn_beta:
            twin.beta = updates.update_beta(twin.beta, twin.p, pull, m)
        if twin.correlated:
            twin.u = twin.mu.mean(0)
            twin.cov = np.cov(twin.mu.T, bias=True) + np.diag(twin.sig.mean(0))
        bounds.append(twin.bound())
    return bounds


@pytest.mark.parametrize("correlated,learn_beta", [(False, False), (False, True), (True, True)])
def test_three_iterations_match_the_dense_twin(spark, tiny, correlated, learn_beta):
    x = counts_matrix(TINY, 6, 8)
    twin = Twin(x, 3, 4.0, same_start(spark, tiny, 3, 4.0, 8), correlated)
    bounds = run_twin(twin, tiny, 3, learn_beta)
    model = fit_topics(tiny, 3, correlated=correlated, max_iter=3, learn_beta=learn_beta)
    # the twin's plain sums hold terms of 1e11 that cancel, for topics of almost no weight
    assert np.allclose([r[1] for r in model.trace_rows], bounds, rtol=1e-7)
    for column in ("n", "a", "b", "mu", "sig"):
        assert np.allclose(matrix(model.doc_topics, "doc_id", column, 6), getattr(twin, column), atol=1e-8), column
    assert np.allclose(matrix(model.topic_terms, "term_id", "gam", 8, 0.5).T, twin.gam, atol=1e-8)
    assert np.allclose(model.globals.p, twin.p) and model.globals.alpha == pytest.approx(twin.alpha)
    assert model.globals.beta == pytest.approx(twin.beta)
    assert np.allclose(model.globals.cov, twin.cov, atol=1e-8)


@pytest.mark.parametrize("correlated", [False, True])
def test_bound_never_falls_and_counts_add_up(spark, sampled, correlated):
    data, m, d = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m))
    model = fit_topics(corpus, 5, correlated=correlated, max_iter=4, learn_beta=True)
    bounds = np.array([r[1] for r in model.trace_rows])
    assert (np.diff(bounds) > -1e-7 * np.abs(bounds[1:])).all()
    n = matrix(model.doc_topics, "doc_id", "n", m)
    assert np.allclose(n.sum(1), counts_matrix(data, m, d).sum(1))
    gam = matrix(model.topic_terms, "term_id", "gam", d, model.gamma / d)
    assert gam.sum() == pytest.approx(5 * model.gamma + corpus.num_words)
    assert np.allclose(gam.sum(0), model.globals.totals)
    assert model.globals.p.sum() == pytest.approx(1.0)
    if correlated:
        assert np.linalg.eigvalsh(model.globals.cov).min() > 0


def test_short_cut_bound_equals_the_sum_of_all_terms(spark, tiny):
    """The loop's bound uses cancellations; the bound operators add up every term."""
    model = fit_topics(tiny, 3, correlated=True, max_iter=2)
    before = fit_topics(tiny, 3, correlated=True, max_iter=1)
    g, docs = model.globals, model.doc_topics
    seen, size = tiny.seen_terms, tiny.vocab_size
    # entropy comes from the responsibilities of the pass that made this state, the rest from the state
    logs = expected_log_topics(before.topic_terms, before.globals.totals)
    old = bound.bound_tokens(expected_counts(tiny, log_vectors(logs, expected_log_weights(before.doc_topics)), 3)).first()
    words = expected_log_topics(model.topic_terms, g.totals).join(model.topic_terms, "term_id")
    flat = model.gamma / size
    loglik = words.select(
        F.expr(f"aggregate(zip_with(gam, elneta, (x, y) -> (x - {flat}D) * y), 0D, (s, x) -> s + x)").alias("x")
    ).agg(F.sum("x")).first()[0]
    weights = expected_log_weights(docs).join(docs, "doc_id").select(
        F.expr("aggregate(zip_with(n, elnz, (x, y) -> x * y), 0D, (s, x) -> s + x)").alias("x")
    ).agg(F.sum("x")).first()[0]
    rest = bound.bound_total(
        bound.bound_topics(model.topic_terms, g.totals, seen, size, model.gamma),
        bound.bound_docs(docs),
        bound.bound_global(updates.global_sums(docs, 3), g.p, g.v, g.alpha, g.beta),
        bound.bound_gaussian(docs, g.u, g.cov),
    ).first()["bound"]
    assert model.trace_rows[-1][1] == pytest.approx(rest + loglik + weights + old["token_entropy"], rel=1e-10)


def test_token_pass_matches_plain_softmax_also_where_products_underflow(spark):
    rng = np.random.default_rng(1)
    rows = [(d, t, int(rng.integers(1, 4))) for d in range(12) for t in range(9) if rng.random() < 0.6]
    corpus = prepare_corpus(doc_terms(spark, rows), doc_ids(spark, 12), block_pairs=7)
    x, k = counts_matrix(rows, 12, 9), 3
    elz, eln = rng.normal(0, 3, (12, k)), rng.normal(0, 3, (9, k))
    elz[3], eln[4] = [0.0, -900.0, -2e6], [-1500.0, 0.0, -5.0]
    table = lambda a, key, value: spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(a)], f"{key} bigint, {value} array<double>"
    )
    docs, terms = table(elz, "doc_id", "elnz"), table(eln, "term_id", "elneta")
    s = elz[:, None] + eln[None]
    r = np.exp(s - s.max(2, keepdims=True))
    r /= r.sum(2, keepdims=True)
    counts = expected_counts(corpus, log_vectors(terms, docs), k).persist()
    w = x[:, :, None] * r
    assert np.allclose(matrix(counts.where("kind = 0"), "id", "vec", 12), w.sum(1))
    assert np.allclose(matrix(counts.where("kind = 1"), "id", "vec", 9), w.sum(0))
    entropy, words = np.array([q["vec"][:2] for q in counts.where("kind = 2").collect()]).sum(0)
    assert entropy == pytest.approx(-(w * np.log(np.where(r > 0, r, 1))).sum())
    assert words == pytest.approx((w * eln[None]).sum())
    plain = responsibilities(token_scores(corpus, terms, docs, k), k).collect()
    assert len(plain) == len(rows)
    for q in plain:
        assert np.allclose(q["r"], r[q["doc_id"], q["term_id"]])


@pytest.mark.parametrize("partitions", [16])
def test_results_do_not_depend_on_the_partitioning(spark, sampled, partitions):
    data, m, _ = sampled
    reference = fit_topics(prepare_corpus(doc_terms(spark, data), doc_ids(spark, m)), 4, max_iter=2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        corpus = prepare_corpus(doc_terms(spark, data).repartition(partitions), doc_ids(spark, m), block_pairs=200)
        model = fit_topics(corpus, 4, max_iter=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose([r[1] for r in model.trace_rows], [r[1] for r in reference.trace_rows], rtol=1e-10)


def test_known_topics_and_the_sign_of_their_correlation_are_found(spark, sampled):
    data, m, d = sampled
    model = fit_topics(prepare_corpus(doc_terms(spark, data), doc_ids(spark, m)), 4, max_iter=12, kmeans_iter=3, seed=1)
    gam = matrix(model.topic_terms, "term_id", "gam", d)
    share = (gam / gam.sum(0)).reshape(4, d // 4, 4).sum(1)  # true topic x found topic
    best = max(itertools.permutations(range(4)), key=lambda q: sum(share[i, q[i]] for i in range(4)))
    assert min(share[i, best[i]] for i in range(4)) > 0.6
    mu = matrix(model.doc_topics, "doc_id", "mu", m)[:, list(best)]
    c = np.corrcoef(mu.T)
    assert c[0, 1] > max(c[0, 2], c[0, 3]) and c[2, 3] > max(c[0, 2], c[1, 3])


def test_stop_rule_and_arguments(spark, tiny):
    model = fit_topics(tiny, 2, correlated=False, max_iter=12, tol=2e-2, min_iter=3)
    changes = [r[2] for r in model.trace_rows]
    assert 3 <= len(changes) < 12 and changes[-1] < 2e-2
    for bad in ({"k": 1}, {"k": 2, "tol": 0.0}, {"k": 2, "gamma": -1.0}, {"k": 2, "max_iter": 0}):
        with pytest.raises(ValueError):
            fit_topics(tiny, **bad)


@pytest.mark.parametrize("correlated", [False, True])
def test_save_and_load(spark, tiny, tmp_path, correlated):
    model = fit_topics(tiny, 3, correlated=correlated, max_iter=2)
    model.save(str(tmp_path / "model"))
    back = Model.load(spark, str(tmp_path / "model"))
    assert (tmp_path / "model" / "topic_cov").exists() == correlated
    for name in ("topic_terms", "doc_topics", "topics", "topic_cov", "hyper", "trace"):
        key = lambda r: str(r)
        a, b = getattr(model, name), getattr(back, name)
        assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)
    assert model.top_terms(2).count() == 6


def test_few_jobs_per_iteration(spark, tiny):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one", "one")
    fit_topics(tiny, 3, correlated=True, max_iter=1)
    spark.sparkContext.setJobGroup("two", "two")
    fit_topics(tiny, 3, correlated=True, max_iter=2)
    extra = len(tracker.getJobIdsForGroup("two")) - len(tracker.getJobIdsForGroup("one"))
    spark.sparkContext.setJobGroup("rest", "rest")
    # three actions an iteration; adaptive execution turns each into a few jobs, one per shuffle
    print("jobs", extra)
    assert extra <= 14


# --- arithmetic on K numbers --------------------------------------------------------------------------


def test_stick_gradient_and_ascent():
    rng = np.random.default_rng(2)
    v = np.r_[rng.uniform(0.2, 0.7, 4), 1.0]
    sums = rng.normal(-200, 30, 5)
    args = (7.0, 5.0, sums, 40)
    gradient = updates.stick_gradient(v, *args)
    for i in range(4):
        h = np.eye(5)[i] * 1e-6
        numeric = (updates.stick_objective(v + h, *args) - updates.stick_objective(v - h, *args)) / 2e-6
        assert gradient[i] == pytest.approx(numeric, rel=1e-6)
    better = updates.update_sticks(v, *args)
    assert updates.stick_objective(better, *args) > updates.stick_objective(v, *args)
    assert np.abs(updates.stick_gradient(better, *args)).max() < np.abs(gradient).max()
    assert ((better > 0) & (better <= 1)).all() and better[-1] == 1.0
    assert np.allclose(updates.stick_weights(updates.uniform_sticks(6)), 1 / 6)
    alpha = updates.update_alpha(v)
    assert alpha == pytest.approx(-4 / np.log(1 - v[:-1]).sum())


def test_beta_reaches_the_top_of_its_objective():
    p, sums = np.array([0.5, 0.3, 0.2]), np.array([-60.0, -90.0, -120.0])
    beta = updates.update_beta(5.0, p, sums, 40)
    top = updates.beta_objective(beta, p, sums, 40)
    for other in (beta * 0.99, beta * 1.01):
        assert updates.beta_objective(other, p, sums, 40) < top


def test_normal_ascent_follows_the_gradient_and_never_loses():
    rng = np.random.default_rng(4)
    k, m = 4, 50
    cov = np.cov(rng.normal(size=(k, 20))) + np.eye(k)
    inv, u, bp = np.linalg.inv(cov), rng.normal(size=k), rng.uniform(0.1, 3, k)
    mu, sig, w = rng.normal(size=(m, k)), rng.uniform(0.2, 2, (m, k)), rng.gamma(1.0, 5.0, (m, k))

    def value(mu, sig):
        off = mu - u
        return (
            (bp * mu - w * np.exp(mu + sig / 2) - 0.5 * np.diag(inv) * sig + 0.5 * np.log(sig)).sum(1)
            - 0.5 * (off @ inv * off).sum(1)
        )

    new_mu, new_sig = updates.ascend(mu, sig, w, bp, u, inv)
    assert (value(new_mu, new_sig) > value(mu, sig)).all()
    # the move in mu and in ln sig is the gradient times one step per document
    moved = np.c_[new_mu - mu, np.log(new_sig) - np.log(sig)]
    for i in range(2 * k):
        h = np.zeros((m, 2 * k))
        h[:, i] = 1e-6
        up = value(mu + h[:, :k], sig * np.exp(h[:, k:]))
        down = value(mu - h[:, :k], sig * np.exp(-h[:, k:]))
        step = moved[:, i] / ((up - down) / 2e-6)
        base = moved[:, 0] if i == 0 else base
        first = step if i == 0 else first
        assert np.allclose(step, first, rtol=1e-4)


def test_moments_and_covariance(spark):
    rng = np.random.default_rng(5)
    mu, sig = rng.normal(50, 1, (40, 3)), rng.uniform(0.1, 1, (40, 3))
    rows = [(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(zip(mu, sig))]
    docs = spark.createDataFrame(rows, "doc_id bigint, mu array<double>, sig array<double>").repartition(3)
    cov = np.zeros((3, 3))
    for r in updates.topic_covariance(docs, 3, 40).collect():
        cov[r["i"], r["j"]] = r["value"]
    assert np.allclose(cov, np.cov(mu.T, bias=True) + np.diag(sig.mean(0)))
    assert np.allclose([r["u"] for r in updates.topic_mean(docs, 3).orderBy("k").collect()], mu.mean(0))


def test_pairs_are_not_moved_by_a_token_pass(spark, sampled):
    data, m, _ = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), block_pairs=500)
    vectors = corpus.needed.select("kind", "id", F.lit(b"\0" * 24).alias("vec")).distinct()
    plan = expected_counts(corpus, vectors, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapCoGroupsInArrow") :].splitlines()
    assert "InMemoryTableScan" in below[1], below[1]  # the cached pairs feed the pass without an exchange


def test_sums_through_a_tree_are_the_same(spark, sampled):
    from topicloom.operators import blocks

    data, m, _ = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), block_pairs=60)
    shares = corpus.tokens.selectExpr("1 AS kind", "term_id AS id", "array(double(cnt), 1D) AS vec")
    plain, tree = (blocks.add_shares(corpus, shares, 2, tree=t) for t in (10**6, 1))
    as_dict = lambda df: {r["id"]: tuple(r["vec"]) for r in df.collect()}
    assert corpus.partitions > 4 and as_dict(plain) == as_dict(tree)


def test_blocks_list_their_ids_without_moving_pairs(spark, sampled):
    data, m, _ = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), block_pairs=300)
    for kind, column in ((0, "doc_id"), (1, "term_id")):
        listed = corpus.needed.where(F.col("kind") == kind).select("block", "id")
        assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, corpus.tokens.select("block", column).distinct().collect()))
    assert corpus.needed_rows == corpus.needed.count()


def test_nothing_is_left_after_a_full_stick(spark):
    rows = [(0, 0, 0.5), (0, 1, 1.0), (0, 2, 0.5), (0, 3, 1.0), (1, 0, 0.25), (1, 1, 1.0)]
    got = updates.stick_table(spark.createDataFrame(rows, "group_id int, k int, v double")).orderBy("group_id", "k").collect()
    assert [r["p"] for r in got] == pytest.approx([0.5, 0.5, 0.0, 0.0, 0.25, 0.75])
    assert [r["left"] for r in got] == pytest.approx([1.0, 0.5, 0.0, 0.0, 1.0, 0.75])


def test_pair_results_leave_the_pairs_in_place(spark, sampled):
    data, m, _ = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), block_pairs=500)
    from topicloom.operators import heldout, kmeans

    seen = corpus.needed.where("kind = 1").selectExpr("id AS term_id").distinct()
    vec = F.array(F.lit(0.5), F.lit(0.5))
    docs, terms = corpus.docs.select("doc_id", vec.alias("theta")), seen.select("term_id", vec.alias("eta"))
    label = corpus.docs.selectExpr("doc_id", "int(doc_id % 2) AS k")
    scores = token_scores(corpus, terms.withColumnRenamed("eta", "elneta"), docs.withColumnRenamed("theta", "elnz"), 2)
    for frame in (scores, heldout.plugin_loglik(corpus, terms, docs), kmeans.mean_centroids(corpus, label, 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("FlatMapCoGroupsInArrow") :].splitlines()
        assert "InMemoryTableScan" in below[1], below[1]


@pytest.mark.parametrize("correlated", [False, True])
def test_an_interrupted_run_goes_on_as_a_straight_one(spark, tiny, tmp_path, correlated):
    straight = fit_topics(tiny, 3, correlated=correlated, max_iter=4, learn_beta=True)
    folder = str(tmp_path / "run")
    fit_topics(tiny, 3, correlated=correlated, max_iter=2, learn_beta=True, folder=folder)
    # the third iteration was cut off: its slot is there, but not complete
    (tmp_path / "run" / "docs-1" / "_SUCCESS").unlink()
    again = fit_topics(tiny, 3, correlated=correlated, max_iter=4, learn_beta=True, folder=folder)
    assert [t[0] for t in again.trace_rows] == [1, 2, 3, 4]
    assert np.allclose([t[1] for t in again.trace_rows], [t[1] for t in straight.trace_rows], rtol=1e-12)
    for name in ("v", "p", "u", "cov", "alpha", "beta", "totals"):
        assert np.allclose(getattr(again.globals, name), getattr(straight.globals, name), rtol=1e-9)
    a, b = (matrix(m.doc_topics, "doc_id", "a", 6) for m in (again, straight))
    assert np.allclose(a, b, rtol=1e-9)
    with pytest.raises(ValueError, match="another"):
        fit_topics(tiny, 4, correlated=correlated, max_iter=4, folder=folder)


def test_stop_rule_is_shared_and_looks_at_the_last_change():
    from topicloom.plans.loop import iterate_until, settled

    bounds = iter([-100.0, -50.0, -49.99, -49.98, -49.97])
    trace = iterate_until(lambda i: next(bounds), [], 10, 1e-2, 1)
    assert [t[0] for t in trace] == [1, 2, 3] and trace[0][2] is None
    assert not settled(trace, 1e-2, 5) and settled(trace, 1e-2, 3) and not settled(trace, None, 1)


def test_document_pass_is_the_plain_steps_with_their_sums(spark):
    """One fused pass against the operators that do each step by itself."""
    from topicloom.operators import document_pass as dp

    rng = np.random.default_rng(3)
    k, m = 3, 40
    rows = [
        (d, int(rng.integers(0, 50)) if d else 0, *[[float(x) for x in rng.uniform(0.5, 3, k)] for _ in range(5)]) for d in range(m)
    ]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, num_words bigint, n array<double>, a array<double>, b array<double>, mu array<double>, sig array<double>"
    ).repartition(3)
    bp, u, inv = np.array([1.0, 0.5, 2.0]), np.array([0.2, -0.1, 0.4]), np.eye(3) * 1.5 + 0.2
    slot = dp.move_documents(docs, bp, u, inv, 2, "n").persist()
    plain = updates.normal_update(updates.gamma_posterior(docs, bp), bp, u, inv, 2)
    for name in ("a", "b", "mu", "sig"):
        assert np.allclose(matrix(dp.moved_documents(slot), "doc_id", name, m), matrix(plain, "doc_id", name, m), rtol=1e-12)
    counts = spark.createDataFrame(
        [(1, 0, [1.0, 2.0, 0.0], 0.5), (2, 0, [3.0, 4.0, 0.0], 9.0), (2, 1, [5.0, 6.0, 0.0], 9.0), (3, 0, [7.0, 0.0, 0.0], 9.0), (0, 0, [8.0, 8.0, 8.0], 9.0)],
        "kind int, id bigint, vec array<double>, lng double",
    )
    sums = dp.collect_sums(slot, counts, k)
    assert (sums["lng"], sums["token_entropy"], sums["token_words"]) == (0.5, 8.0, 10.0)
    terms = bound.doc_terms_of_bound(bound.with_logs(plain)).agg(
        *[F.sum(c).alias(c) for c in ("settled", "normaliser", "rate")], *[F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c in ("n", "mu", "elnz")]
    ).first()
    for name in ("settled", "normaliser", "rate", "n", "mu", "elnz"):
        assert np.allclose(sums[name], terms[name], rtol=1e-10)
    for r in updates.normal_moments(plain, u).collect():
        assert sums["moments"][r["i"], r["j"]] == pytest.approx(r["value"], rel=1e-9)
    assert slot.where("part = 1 AND note = 'n'").count() == 1


def test_a_model_is_exported_as_text(spark, tiny, tmp_path):
    from topicloom.sources.matrix_text import read_matrix, read_vector

    model = fit_topics(tiny, 3, correlated=True, max_iter=2)
    model.export_text(str(tmp_path))

    def read(name, shape):
        out = np.full(shape, np.nan)
        for r in read_matrix(spark, f"{tmp_path}/{name}").collect():
            out[r["i"], r["j"]] = r["value"]
        return out

    assert np.allclose(read("gam", (8, 3)), matrix(model.topic_terms, "term_id", "gam", 8, model.gamma / 8), atol=1e-6)
    for name in ("a", "b", "mu", "sig"):
        assert np.allclose(read(name, (6, 3)), matrix(model.doc_topics, "doc_id", name, 6), atol=1e-6)
    assert np.allclose(read("cov", (3, 3)), model.globals.cov, atol=1e-6)
    vector = lambda name: [r["value"] for r in read_vector(spark, f"{tmp_path}/{name}").orderBy("i").collect()]
    assert np.allclose(vector("u"), model.globals.u, atol=1e-6) and np.allclose(vector("v"), model.globals.v, atol=1e-6)
    assert np.allclose(vector("bound"), [t[1] for t in model.trace_rows], atol=1e-6)
    assert np.allclose([vector("alpha")[0], vector("beta")[0]], [model.globals.alpha, model.globals.beta], atol=1e-6)

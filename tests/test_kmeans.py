import numpy as np
from conftest import counts_matrix, doc_ids, doc_terms

from topicloom import prepare_corpus
from topicloom.operators import kmeans


def vectors(df, size, column="vec"):
    rows = df.collect()
    out = np.zeros((size, len(rows[0][column])))
    for r in rows:
        out[r[0]] = r[column]
    return out


def test_distances_match_dense_ones(spark, sampled):
    data, m, d = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m), block_pairs=300)
    x = counts_matrix(data, m, d)
    freq = x / x.sum(1, keepdims=True)
    seeds = kmeans.seed_documents(corpus.docs, 5, seed=3)
    chosen = [r["doc_id"] for r in seeds.orderBy("k").collect()]
    assert len(set(chosen)) == 5
    cent = kmeans.seed_centroids(corpus, seeds, 5)
    assert np.allclose(vectors(cent, d).T, freq[chosen])
    for p in (1.0, 2.0):
        dist = vectors(kmeans.distances(corpus, cent, 5, p), m, "dist")
        assert np.allclose(dist, (np.abs(freq[:, None] - freq[chosen][None]) ** p).sum(2))


def test_fit_matches_dense_passes(spark, sampled):
    data, m, d = sampled
    corpus = prepare_corpus(doc_terms(spark, data), doc_ids(spark, m))
    x = counts_matrix(data, m, d)
    freq = x / x.sum(1, keepdims=True)
    chosen = [r["doc_id"] for r in kmeans.seed_documents(corpus.docs, 4).orderBy("k").collect()]
    cent = freq[chosen]
    for _ in range(2):
        near = np.round(np.abs(freq[:, None] - cent[None]).sum(2), 9).argmin(1)
        cent = np.array([freq[near == k].mean(0) if (near == k).any() else np.zeros(d) for k in range(4)])
    got, assigned = kmeans.fit_kmeans(corpus, 4, passes=2)
    assert [r["k"] for r in assigned.orderBy("doc_id").collect()] == near.tolist()
    assert np.allclose(vectors(got, d).T, cent)


def test_more_clusters_than_documents(spark, tiny):
    cent, assigned = kmeans.fit_kmeans(tiny, 8)
    assert assigned.count() == 5  # the empty document is left out
    ranks = kmeans.relabel(kmeans.cluster_sizes(assigned), 8).orderBy("rank").collect()
    assert [r["size"] for r in ranks] == sorted((r["size"] for r in ranks), reverse=True)
    gam = vectors(kmeans.initial_topics(tiny, cent, [r["k"] for r in ranks], 4.0), 8, "gam")
    assert np.allclose(gam[[0, 1, 2, 3, 4, 5, 7]][:, -1], 0.5)  # an empty cluster gives a flat topic
    totals = gam.sum(0) + 0.5  # one id never occurs
    assert np.allclose(totals[: len([r for r in ranks if r["size"]])], 8.0)

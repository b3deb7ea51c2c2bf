import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicloom import build_session, prepare_corpus  # noqa: E402

# six documents over eight terms; document 5 is empty, term 6 never occurs
TINY = [
    (0, 0, 3), (0, 1, 2), (0, 2, 1),
    (1, 0, 2), (1, 1, 4),
    (2, 3, 5), (2, 4, 2), (2, 7, 1),
    (3, 3, 1), (3, 4, 6), (3, 5, 1),
    (4, 0, 1), (4, 4, 1), (4, 7, 2),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "topicloom-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def doc_terms(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, term_id bigint, cnt bigint")


def doc_ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def counts_matrix(rows, num_docs, vocab):
    x = np.zeros((num_docs, vocab))
    for d, t, c in rows:
        x[d, t] += c
    return x


@pytest.fixture(scope="session")
def tiny(spark):
    return prepare_corpus(doc_terms(spark, TINY), doc_ids(spark, 6))


@pytest.fixture(scope="session")
def sampled(spark):
    """120 documents from four topics whose log-rates are correlated: 0 and 1 together, 2 and 3 against."""
    rng = np.random.default_rng(7)
    k, vocab = 4, 60
    topics = rng.dirichlet(np.full(vocab // k, 0.5), k)
    cov = np.array([[2.0, 1.6, -1.2, -1.2], [1.6, 2.0, -1.2, -1.2], [-1.2, -1.2, 2.0, 1.6], [-1.2, -1.2, 1.6, 2.0]])
    rows = []
    for d in range(120):
        z = rng.gamma(1.5, np.exp(-rng.multivariate_normal(np.zeros(k), cov)))
        words = {}
        for topic in rng.choice(k, 80, p=z / z.sum()):
            term = int(topic * (vocab // k) + rng.choice(vocab // k, p=topics[topic]))
            words[term] = words.get(term, 0) + 1
        rows += [(d, t, c) for t, c in sorted(words.items())]
    return rows, 120, vocab

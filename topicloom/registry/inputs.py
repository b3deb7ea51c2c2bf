"""Tables the registered queries start from, derived by Spark from the given data.

The prepared corpus of a data folder is written once per session and shared by the queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.vectors import per_topic
from topicloom.session import RunFolder
from topicloom.sources.corpus import corpus_from_text, encode_terms, vocabulary
from topicloom.sources.matrix_text import array_matrix
from topicloom.sources.prepared import Corpus, prepare_corpus

# Fixed values shared with the SQL twins: topics, scales, sticks, mean and covariance of the state from
# which single steps are checked, and the concentration of the topics.
K = 3
ALPHA, BETA = 20.0, 5.0
STICKS = np.array([0.5, 0.4, 1.0])
WEIGHTS = np.array([0.5, 0.2, 0.3])
MEAN = np.array([0.1, -0.2, 0.05])
COVARIANCE = np.array([[1.0, 0.3, 0.1], [0.3, 0.8, -0.2], [0.1, -0.2, 1.2]])


@dataclass(frozen=True)
class TextCorpus:
    pairs: DataFrame  # doc_id, term, cnt
    vocab: DataFrame  # term, term_id, n
    corpus: Corpus


_shared: dict[tuple[str, str], TextCorpus] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_corpus(spark: SparkSession, folder: str) -> TextCorpus:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _shared:
        documents = table(spark, folder, "documents")
        run = RunFolder(spark, "text")
        pairs = run.write(corpus_from_text(documents), "pairs")
        vocab = run.write(vocabulary(pairs, run), "vocabulary")
        corpus = prepare_corpus(encode_terms(pairs, vocab), documents.select("doc_id"), unique=True, sizes_of=pairs)
        _shared[key] = TextCorpus(pairs, vocab, corpus)
    return _shared[key]


def topic_state(corpus: Corpus) -> DataFrame:
    """``(term_id, gam)`` with Gam = 1 + (7 term + 3 k) mod 5 for every term in use."""
    terms = corpus.needed.where("kind = 1").select(F.col("id").alias("term_id")).distinct()
    return terms.select("term_id", per_topic(K, lambda i: f"double(1 + (term_id * 7 + {3 * i}) % 5)").alias("gam"))


def topic_state_totals(corpus: Corpus) -> np.ndarray:
    row = topic_state(corpus).agg(per_topic(K, lambda i: f"sum(gam[{i}])").alias("t")).first()
    return np.array(row["t"])


def document_state(corpus: Corpus) -> DataFrame:
    """Every document with closed-form counts, shapes, rates, means and variances."""
    vector = lambda text: per_topic(K, lambda i: text.format(k=i))
    return corpus.docs.select(
        "doc_id",
        "num_words",
        vector("double((doc_id + 2 * {k}) % 5)").alias("n"),
        vector("double(1 + (doc_id + {k}) % 4)").alias("a"),
        vector("1.5D + ((doc_id + {k}) % 3) / 2D").alias("b"),
        vector("ln(double(1 + (doc_id * 3 + {k} * 5 + doc_id % (11 + {k})) % 7)) - 1D").alias("mu"),
        vector("1D / (1.5D + (doc_id + 2 * {k}) % 3)").alias("sig"),
    )


def embedding_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return array_matrix(table(spark, folder, "embeddings"), "vec_id", "embedding")


def embedding_weights(matrix: DataFrame) -> DataFrame:
    """A vector over the columns of a matrix, from the matrix itself: its largest value per column."""
    return matrix.groupBy(F.col("j").alias("i")).agg(F.max("value").alias("value"))

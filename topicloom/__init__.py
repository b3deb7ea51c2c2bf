"""Nonparametric topic models as Spark jobs.

The public surface is re-exported here: read or build a corpus, fit a model, score held-out text.
"""

import sys

from pyspark import cloudpickle

from topicloom.plans.fit import Model, fit_topics
from topicloom.plans.heldout import evaluate_heldout, fold_in
from topicloom.session import RunFolder, build_session
from topicloom.sources.corpus import corpus_from_text, read_counts
from topicloom.sources.prepared import Corpus, prepare_corpus

__all__ = [
    "Corpus",
    "Model",
    "RunFolder",
    "build_session",
    "corpus_from_text",
    "evaluate_heldout",
    "fit_topics",
    "fold_in",
    "prepare_corpus",
    "read_counts",
]

# Task functions travel with the job, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

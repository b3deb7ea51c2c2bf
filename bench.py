"""Times the headline jobs and prints one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the local cores. Per-iteration times are the mean over
the iterations after the first, which also pays for compiling.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from topicloom import RunFolder, build_session, corpus_from_text, fit_topics, fold_in, prepare_corpus  # noqa: E402
from topicloom.operators import heldout, kmeans  # noqa: E402
from topicloom.registry.inputs import embedding_matrix  # noqa: E402
from topicloom.operators.matrix import gram  # noqa: E402
from topicloom.sources.corpus import doc_stats, encode_terms, spread_few_files, vocabulary  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "topicloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, job):
        began = time.monotonic()
        result = job()
        times[name] = round(time.monotonic() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        return result

    run = RunFolder(spark, "bench")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = timed("corpus_from_text", lambda: run.write(corpus_from_text(spread_few_files(documents)), "pairs"))
    vocab = timed("vocabulary", lambda: run.write(vocabulary(pairs, run), "vocabulary"))
    doc_terms = run.write(encode_terms(pairs, vocab), "doc_terms")
    corpus = timed("prepare_corpus", lambda: prepare_corpus(doc_terms, documents.select("doc_id")))
    timed("kmeans_pass_k10", lambda: kmeans.fit_kmeans(corpus, 10))
    models = {}
    for name, k, correlated, iterations in (
        ("hdp_k10", 10, False, 3),
        ("hdp_k50", 50, False, 2),
        ("correlated_k10", 10, True, 2),
        ("correlated_k50", 50, True, 2),
    ):
        model = timed(f"fit_{name}", lambda: fit_topics(corpus, k, correlated, max_iter=iterations))
        later = [row[3] for row in model.trace_rows[1:]]
        times[f"iteration_{name}"] = round(sum(later) / len(later), 3)
        models[name] = model
    split = timed(
        "heldout_split",
        lambda: run.write(
            heldout.split_heldout(doc_terms, doc_stats(doc_terms)), "split", partition_by="part"
        ),
    )
    train = prepare_corpus(split.where("part = 'train'").drop("part"), documents.select("doc_id"), corpus.vocab_size)
    fold = timed("fold_in_k10", lambda: fold_in(models["correlated_k10"], train, max_iter=3, tol=None))
    times["iteration_fold_in_k10"] = round(sum(t[3] for t in fold.trace[1:]) / 2, 3)
    timed("matrix_gram", lambda: gram(embedding_matrix(spark, folder)).agg(F.sum("value")).first())

    jobs = {name: t for name, t in times.items() if not name.startswith("iteration_")}
    print(
        json.dumps(
            {
                "metric": "topic_model_jobs_total",
                "value": round(sum(jobs.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

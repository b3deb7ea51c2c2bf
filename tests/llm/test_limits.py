"""What an operator holds, moves or writes stays in proportion: peaks and row counts, with the same results."""

import glob
import tempfile
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from topicloom.llm import ngram_jaccard, ngram_lm, quality
from topicloom.session import RunFolder


def test_quality_holds_a_small_step_of_a_batch():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 9999, 350)) for _ in range(3000)]
    batch = pa.record_batch({"doc_id": pa.array(range(3000)), "text": pa.array(texts)})
    weights = rng.normal(size=(1 << 12) + 1).astype(np.float32)
    tracemalloc.start()
    parts = [values for _, values in quality._scored(batch, weights)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    assert np.allclose(np.concatenate(parts), quality._scores(batch["text"], weights), rtol=1e-12)


def written_rows(monkeypatch):
    """The rows of every table that a run writes, by name."""
    rows, write = {}, RunFolder.write

    def counted(self, df, name, partition_by=None):
        out = write(self, df, name, partition_by)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(RunFolder, "write", counted)
    return rows


def test_near_copies_are_compared_once_for_each_pair(spark, monkeypatch):
    """Texts over one long passage, each with words of its own: similar, but most of them not enough."""
    rng = np.random.default_rng(4)
    passage = [f"p{j}" for j in range(150)]
    texts = []
    for i in range(60):
        words = list(passage)
        for at in rng.choice(150, int(rng.integers(2, 6)), replace=False):
            words[at] = f"x{i}"
        texts.append(" ".join(words))

    def linked(a, b):
        a, b = ({tuple(t.split()[k : k + 5]) for k in range(146)} for t in (a, b))
        return 100 * len(a & b) >= 80 * len(a | b)

    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if linked(texts[i], texts[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {x: min(i for i in range(60) if label[i] == x) for x in label}
    rows = written_rows(monkeypatch)
    found = ngram_jaccard.shingle_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: first[label[i]] for i in range(60)}
    assert 1 < len(set(label)) < 60
    assert rows["rest-compared"] == rows["rest-pairs"] > 0


def shuffle_files():
    return set(glob.glob(f"{tempfile.gettempdir()}/**/blockmgr-*/*/shuffle_*", recursive=True))


def test_shuffles_go_once_a_table_is_written(spark):
    frame = spark.range(20000).repartition(4, "id")
    before = shuffle_files()
    RunFolder(spark, "held").write(frame.selectExpr("id", "id + 1 AS x"), "table")
    held = shuffle_files() - before
    assert held
    table = RunFolder(spark, "passing", passing=True).write(frame.selectExpr("id", "id + 2 AS x"), "table")
    for _ in range(50):
        left = shuffle_files() - before - held
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.count() == 20000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_language_model_and_join_pass_their_shuffles(spark, monkeypatch):
    seen, init = {}, RunFolder.__init__

    def noted(self, spark, name, path=None, passing=False):
        seen[name] = passing
        init(self, spark, name, path, passing)

    monkeypatch.setattr(RunFolder, "__init__", noted)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    ngram_lm.train_and_score(docs).collect()
    ngram_jaccard.shingle_components(docs).collect()
    assert seen == {"lm": True, "jaccard": True}

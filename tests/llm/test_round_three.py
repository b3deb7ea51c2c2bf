"""Filter audit, toxicity and periodic runs against brute force, with null, empty, long, repeated and clashing input."""

import hashlib
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from topicloom.llm import filter_audit, periodic_runs, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, mask int, n int, id string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def clashing(rows):
    """Rows of documents with further columns named like helpers of the operators."""
    return [(i, t, lang, "s", 3, 4, "x") for i, t, lang in rows]


# --- filter audit ------------------------------------------------------------------------------------


def audit_rows():
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long, long + " #", "A B C", "", None, "a " * 150, "é" * 5 + " Ω", long.upper(), "a\x1fb\x0bc", "x" * 50_000]
    texts += [" ".join(rng.choice([f"v{i}" for i in range(90)], int(n))) for n in rng.integers(50, 260, 20)]
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [(3, "A B C", "en"), (100, long, "de"), (100, long, "de"), (None, long, "en"), (None, None, None), (7, "another", "")]
    labels = [(i, i % 2, (i // 2) % 2, "p") for i in range(25)] + [(3, 0, 1, None), (100, None, 1, "q"), (None, 1, 1, "q"), (999, 1, 1, "q")]
    return rows, labels


def audit_by_hand(rows, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    failing = []
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and smallest[t] < i,
        }
        failing.append((i, lang or "", {f for f in fails if fails[f]}))
    out = {}
    for part in {p for _, p, _ in failing}:
        mine, removed = [(i, f) for i, p, f in failing if p == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                removed[c] += len(gone)
                fails = sum(c in f for _, f in mine)
                out[part, order, step] = [
                    len(left), len(gone), fails - len(gone), sum(f == {c} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c,
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row[6] = removed[order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


def as_audit(frame):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in frame.collect()}


def test_audit_is_the_audit_by_hand(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(clashing(rows), DOCS).repartition(3)
    got = as_audit(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == audit_by_hand(rows, labels)
    assert len(got) == 600 * 3


def test_audit_sql_gives_the_same(spark, tmp_path):
    rows, labels = audit_rows()
    rows = [r for r in rows if r[0] is not None]
    docs, marks = spark.createDataFrame(clashing(rows), DOCS), spark.createDataFrame(labels, LABELS)
    con = duckdb.connect()
    for name, frame in (("documents", docs), ("labels", marks)):
        frame.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    found = con.execute(filter_audit.SQL)
    assert [c[0] for c in found.description] == filter_audit.audit(docs, marks).columns
    assert {r[:3]: r[3:] for r in found.fetchall()} == as_audit(filter_audit.audit(docs, marks))


def test_audit_of_nothing_and_without_labels(spark):
    rows, labels = audit_rows()
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty, spark.createDataFrame(labels, LABELS)).count() == 0
    got = as_audit(filter_audit.audit(spark.createDataFrame(clashing(rows), DOCS), none))
    assert all(v[4] == v[5] == 0 for v in got.values())


def test_audit_of_other_filters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(clashing([(1, "ab", "x"), (2, "b", "x"), (3, None, "x")]), DOCS)
    filters = {"P": F.contains("text", F.lit("a")), "Q": F.contains("text", F.lit("b"))}
    got = as_audit(filter_audit.audit(docs, spark.createDataFrame([], LABELS), filters, copies=None))
    assert got["x", "PQ", 1][:4] == (2, 1, 0, 0) and got["x", "PQ", 2][:4] == (1, 1, 1, 1)
    assert got["x", "QP", 1][:4] == (1, 2, 0, 1) and got["x", "QP", 2][:4] == (1, 0, 1, 0)
    assert got["x", "PQ", 1][6] == 1 and got["x", "PQ", 2][6] == 3


def test_hot_text_is_combined_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(clashing([(1, "t", "x")]), DOCS)
    rows = filter_audit.masks(docs, filter_audit.text_filters(F.col("text")), "lang", "doc_id", "text")
    plan = filter_audit.mark_copies(rows, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") == 1 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


# --- periodic runs -----------------------------------------------------------------------------------


def runs_by_hand(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def planted_by_hand(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_by_hand(doc_id, text):
    words = planted_by_hand(doc_id, WORD.findall(text or ""))
    runs = runs_by_hand(words)
    dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(kept))


def test_runs_of_random_words():
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = []
        for _ in range(4):
            n, x = int(rng.integers(0, 80)), None
            x = rng.integers(0, rng.integers(1, 8), n)
            if n > 20 and rng.random() < 0.6:
                p, a = rng.integers(1, 14), rng.integers(0, n - 10)
                x[a:] = x[a + np.arange(n - a) % p]
            texts.append(x.astype(np.int64))
        starts = np.r_[0, np.cumsum([len(t) for t in texts])]
        runs, owner = periodic_runs.find_runs(np.concatenate(texts), starts)
        for i, t in enumerate(texts):
            got = [(s - starts[i], q, n) for s, n, q in runs[owner == i].tolist()]
            assert got == runs_by_hand(t)


def test_digest_is_the_digest_by_hand(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["W1", "é", "w1,"]
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 220, 60)]
    texts += [None, "", " \t\n", "one", "x " * 1000, "a b " * 6, "a b " * 5 + "a", ("p q r\x0b" * 30) + "z", "Aa aA " * 9]
    texts += [" ".join(rng.choice(vocabulary[:2], 400)), " ".join(rng.choice(vocabulary, 3000))]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "a b " * 20, None), (0, texts[0], "en"), (0, texts[0], "en")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    docs = spark.createDataFrame(clashing(rows), DOCS).repartition(4)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, periodic_runs.run_digest(docs).collect()), key=key)
    assert got == sorted((digest_by_hand(i, t) for i, t, _ in rows), key=key)


def test_runs_are_listed_and_cut_out(spark):
    docs = spark.createDataFrame(clashing([(5, "s " + "a b c " * 5 + "t t t", "en"), (6, None, "en")]), DOCS)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert (got[5].starts, got[5].lengths, got[5].periods) == ([1], [15], [3])
    assert (got[5].collapsed, got[5].n_words, got[5].n_kept) == ("s a b c t t t", 19, 7)
    assert (got[6].starts, got[6].collapsed, got[6].n_words) == ([], "", 0)
    assert periodic_runs.run_digest(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_texts_stay_near_linear():
    for x in (np.zeros(60_000, np.int64), np.arange(60_000) % 777, np.random.default_rng(0).integers(0, 2, 60_000)):
        runs, _ = periodic_runs.find_runs(x.astype(np.int64), np.array([0, len(x)]))
        assert len(runs) >= 1


# --- toxicity ----------------------------------------------------------------------------------------

INSULTS = ["blockhead", "nitwit", "dimwit", "numbskull"]


@pytest.fixture(scope="module")
def talk():
    """Texts of invented words; a toxic one holds an insult in one of its sentences."""
    rng = np.random.default_rng(11)
    syllables = ["ra", "to", "min", "sel", "vo", "kar", "ne", "lu", "pa", "shi", "dor", "em", "tis", "ga"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(700):
        toxic = int(rng.random() < 0.3)
        said = [[word() for _ in range(rng.integers(4, 12))] for _ in range(rng.integers(1, 8))]
        if toxic:
            for _ in range(rng.integers(1, 3)):
                s = said[rng.integers(len(said))]
                s[rng.integers(len(s))] = str(rng.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(s) for s in said) + ".", "en"))
        labels.append((i, 1, toxic, "p"))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_model(spark, talk):
    rows, labels = talk
    return toxicity.train(spark.createDataFrame(clashing(rows), DOCS).repartition(3), spark.createDataFrame(labels, LABELS))


def test_kernel_is_the_kernel_by_hand():
    def features(word):
        out = {}
        for a in range(len(word)):
            for b in range(a + 1, len(word)):
                for c in range(b + 1, min(a + toxicity.SPAN, len(word))):
                    key, weight = word[a] + word[b] + word[c], toxicity.DECAY ** (c - a + 1)
                    out[key] = max(out.get(key, 0), weight)
        return out

    words = ["idiot", "idxiot", "banana", "ab", "nanaban", "quququququ", "t" * 200, "abcdefgh" * 20]
    marks = ["idiot", "banana", "abcd"]
    held = toxicity.Landmarks.of(marks, 3).held_by(pa.array(words, pa.large_string()))
    for j, m in enumerate(marks):
        fm = features(m)
        size = sum(v * v for v in fm.values())
        for i, w in enumerate(words):
            fw = features(w)
            whole = min(1.0, sum(v * fw.get(k, 0) for k, v in fm.items()) / size)
            assert held[i, j] == pytest.approx(whole**toxicity.POWER, abs=1e-5), (w, m)


def test_long_words_lose_no_subsequence():
    word = "x" * 57 + "idiot" + "y" * 100
    for shift in range(0, 70, 3):
        held = toxicity.Landmarks.of(["idiot"], 1).held_by(pa.array(["z" * shift + word], pa.large_string()))
        assert held[0, 0] == pytest.approx(1.0, abs=1e-5)


def test_held_out_texts_are_told_apart(spark, talk, toxic_model):
    rows, labels = talk
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(clashing(rows), DOCS), toxic_model).collect()}
    assert set(toxic_model.landmarks.words[: toxic_model.landmarks.toxic]) == set(INSULTS)
    hit = miss = false = clean = 0
    for i, _, toxic, _ in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == (got[i].score >= 0.7) and 0 <= got[i].score <= 1
        if got[i].held_out:
            hit += toxic and got[i].predicted
            miss += toxic and not got[i].predicted
            false += (not toxic) and got[i].predicted
            clean += not toxic
    assert hit >= 40 and miss <= 1 and false <= 1 and clean > 100


def test_hidden_insults_are_found(toxic_model):
    score = lambda *t: toxic_model.text_scores(pa.array(t, pa.string()))
    hidden = ["ra blockhead to", "BLOCKHEAD", "you bl.ock-he.ad", "b l o c k h e a d", "bloockhead", "nit*wit", "n1tw1t", "numbxskull", "dimm-witt"]
    assert (score(*hidden) >= 0.7).all(), list(zip(hidden, score(*hidden)))
    harmless = ["", None, " ", "block the head of the nit", "ra to min sel", "a b c d e f g", "0 1 2", "é è ß"]
    assert (score(*harmless) < 0.3).all(), list(zip(harmless, score(*harmless)))


def test_whole_texts_and_odd_rows_are_scored(spark, toxic_model):
    far = "ra to min " * 20_000
    rows = [(1, far, "en"), (2, far + "nitwit", "en"), (3, None, None), (4, "", "en"), (None, "nitwit", "en"), (5, "w" * 30_000, "en"), (5, "dimwit", "en"), (5, "dimwit", "en")]
    got = toxicity.score(spark.createDataFrame(clashing(rows), DOCS).repartition(2), toxic_model).collect()
    assert sorted((r.doc_id or -1, r.predicted) for r in got) == [(-1, 1), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (5, 1), (5, 1)]
    assert not next(r for r in got if r.doc_id is None).held_out


def test_toxicity_without_labels_or_rows(spark, talk):
    rows, labels = talk
    docs = spark.createDataFrame(clashing(rows[:20]), DOCS)
    nothing = toxicity.train(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    one_kind = toxicity.train(docs, spark.createDataFrame([(i, 1, 0, "p") for i in range(20)], LABELS))
    assert {r.predicted for r in toxicity.score(docs, one_kind).collect()} == {0}
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.train(empty, spark.createDataFrame(labels, LABELS))).count() == 0


def test_texts_outside_the_training_part_do_not_matter(spark, talk, toxic_model):
    rows, labels = talk
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = [(i, q, 1 - t if held(i) else t, p) for i, q, t, p in labels]
    again = toxicity.train(spark.createDataFrame(clashing(rows), DOCS), spark.createDataFrame(turned, LABELS))
    assert again.landmarks.words == toxic_model.landmarks.words
    assert np.allclose(again.weights, toxic_model.weights) and again.shift == pytest.approx(toxic_model.shift)

"""Toxicity: a support vector machine over a subsequence string kernel, with Nystrom landmarks.

The kernel goes through the common subsequences of ORDER letters of two strings; one that spans s letters weighs
DECAY ** s, up to SPAN letters, and counts once, where it is tightest. Letters between the matching ones cost weight, not the match, so
``idxiot`` still meets ``idiot``. Marks inside a word are passed over, digits and signs that stand for letters are
read as such, and letters spelled out one by one (``i d i o t``) also count as one word.

Landmarks are a bounded number of stems and words of labelled texts: those that together cover the toxic texts, and
those common in clean texts that resemble them most. The kernel is scaled to 1 and raised to a POWER (which keeps it a kernel),
so that many half matches do not add up to a whole one. A sentence (at most SENTENCE_WORDS words) is described by how
much of each landmark its best word holds, mapped by K^(-1/2) of the landmarks. Sentences carry the label of their
text; a toxic text needs only one toxic sentence, so the machine is fitted on the sentence of each that it finds most toxic,
found anew until nothing changes, against all sentences of clean texts. A text scores by its worst
sentence, turned into a probability by a logistic curve fitted on the same sample.

The sample is bounded (``sample_rows`` labelled rows, the smallest by hash of the id, and the ``BAG`` sentences of
each nearest to a toxic landmark); the model is of fixed size. Scoring reads every row once, whole, and moves nothing.

Defined results: null and empty texts have no sentence and score as the bias alone; labels that are null are not
learnt from; a text that stands on several rows is one example of each of its labels; without a label of each kind every score is the
share of toxic labels, with none at all 0.5; a null id is not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.tables import pack, remainder, unpack
from topicloom.llm.text import split, steps, texts_of
from topicloom.session import RunFolder

ORDER, SPAN, DECAY, POWER = 3, 5, 0.7, 2
SYMBOLS = 32
LANDMARKS, TOXIC_LANDMARKS, CANDIDATES = 48, 32, 600
SAMPLE_ROWS = 8_000
BAG = 16
SENTENCE_WORDS = 40
# A longer word counts as pieces of this many letters; they overlap, so that no subsequence is lost.
PIECE = 64
STEP = 4 << 20
THRESHOLD = 0.7
# A landmark explains this many texts, and this share of the toxic ones, weighed down by AGAIN for each earlier one.
LEAST_TEXTS, LEAST_SHARE, AGAIN = 5, 0.01, 0.4
PREFIXES = (4, 5, 6)
ROUNDS = 6

# Signs read as the letters they resemble.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _letter_table() -> np.ndarray:
    table = np.full(128, -1, np.int16)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    for sign, letter in LOOKALIKES.items():
        table[ord(sign)] = ord(letter) - ord("a")
    return table


_LETTERS = _letter_table()


# --- the kernel --------------------------------------------------------------------------------------


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all (lower-cased) words as numbers below SYMBOLS, and the word of each."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar("\n", pa.large_string()))[0].as_py()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    owner = np.cumsum(points == 10)
    letter = np.where(points < 128, _LETTERS[np.minimum(points, 127)], 26 + points % (SYMBOLS - 26)).astype(np.int64)
    real = letter >= 0
    return letter[real], owner[real]


def _pieces(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters piece by piece, the piece of each, and the word of every piece."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(owner)])
    step = PIECE - SPAN + 1
    count = np.maximum(-(-(size - SPAN + 1) // step), 1)
    piece_word = np.repeat(np.arange(len(first)), count)
    begin = first[piece_word] + (np.arange(len(piece_word)) - np.repeat(np.cumsum(count) - count, count)) * step
    end = np.minimum(begin + PIECE, (first + size)[piece_word])
    length = end - begin
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    return at, np.repeat(np.arange(len(piece_word)), length), owner[first][piece_word]


def subsequences(letter: np.ndarray, piece: np.ndarray):
    """For every shape of a subsequence: positions of its first letter, its number, and its weight."""
    for c in range(ORDER - 1, SPAN):
        inside = np.flatnonzero(piece[c:] == piece[:-c]) if len(piece) > c else np.zeros(0, np.int64)
        for b in range(1, c):
            code = (letter[inside] * SYMBOLS + letter[inside + b]) * SYMBOLS + letter[inside + c]
            yield inside, code, DECAY ** (c + 1)


def explicit_features(words: list[str]) -> np.ndarray:
    """words x SYMBOLS^ORDER weights of all subsequences: the kernel's own space, for a few strings."""
    out = np.zeros((len(words), SYMBOLS**ORDER), np.float32)
    letter, owner = letters_of(pa.array(words, pa.large_string()))
    for at, code, weight in subsequences(letter, owner):
        np.maximum.at(out, (owner[at], code), np.float32(weight))
    return out


@dataclass(frozen=True)
class Landmarks:
    """Rows of ``table`` hold a subsequence's weight in every landmark, scaled so that a landmark holds itself once."""

    words: list[str]
    toxic: int  # how many of them, the first ones, tell toxic texts
    row: np.ndarray  # subsequence number to row of the table, -1 where no landmark has it
    table: np.ndarray
    gram: np.ndarray  # the kernel between landmarks, scaled to 1 on its diagonal

    @classmethod
    def of(cls, words: list[str], toxic: int) -> Landmarks:
        features = explicit_features(words)
        size = np.maximum((features**2).sum(axis=1), 1e-12)
        used = np.flatnonzero(features.any(axis=0))
        row = np.full(SYMBOLS**ORDER, -1, np.int32)
        row[used] = np.arange(len(used))
        gram = ((features @ features.T) / np.sqrt(np.outer(size, size))) ** POWER
        return cls(words, toxic, row, np.ascontiguousarray((features[:, used] / size[:, None]).T), gram)

    def held_by(self, words: pa.Array) -> np.ndarray:
        """words x landmarks: how much of each landmark a word holds, between 0 and 1."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        letter, owner = letters_of(words)
        at, piece, piece_word = _pieces(owner)
        letter = letter[at]
        sums = np.zeros((len(piece_word), len(self.words)), np.float32)
        for lo in range(0, len(piece_word), 1 << 14):
            hi = min(lo + (1 << 14), len(piece_word))
            a, b = np.searchsorted(piece, [lo, hi])
            keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            for where, code, weight in subsequences(letter[a:b], piece[a:b]):  # tightest shapes first
                row = self.row[code]
                known = row >= 0
                keys.append(piece[a:b][where[known]] * len(self.table) + row[known])
                weights.append(np.full(known.sum(), weight, np.float32))
            key, first = np.unique(np.concatenate(keys), return_index=True)
            if not len(key):
                continue
            owners, row = np.divmod(key, len(self.table))
            edge = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            sums[owners[edge]] = np.add.reduceat(self.table[row] * np.concatenate(weights)[first][:, None], edge, axis=0)
        if len(piece_word):
            edge = np.flatnonzero(np.r_[True, piece_word[1:] != piece_word[:-1]])
            out[piece_word[edge]] = np.maximum.reduceat(sums, edge, axis=0)
        return np.minimum(out, 1.0) ** POWER


# --- sentences ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sentences:
    """The words of a batch: distinct ones, and for each sentence the numbers of its words."""

    distinct: pa.Array
    number: np.ndarray
    begin: np.ndarray  # first word of every sentence
    text: np.ndarray  # the text of every sentence
    texts: int


def sentences(column: pa.Array) -> Sentences:
    words, starts = split(pc.utf8_lower(texts_of(column)))
    coded = words.dictionary_encode()
    distinct, number = coded.dictionary.cast(pa.large_string()), np.asarray(coded.indices).astype(np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    stops = np.asarray(pc.match_substring_regex(distinct, r"[.!?]$"), dtype=bool) if len(distinct) else np.zeros(0, bool)
    opens = np.r_[True, stops[number[:-1]] | (owner[1:] != owner[:-1])] if len(number) else np.zeros(0, bool)
    # a sentence without an end is cut after SENTENCE_WORDS words
    since = np.arange(len(number)) - np.maximum.accumulate(np.where(opens, np.arange(len(number)), 0))
    opens |= since % SENTENCE_WORDS == 0
    # letters spelled out one by one also count as one word, in the sentence where they begin
    brief = np.flatnonzero(np.asarray(pc.less_equal(pc.utf8_length(distinct), 3))) if len(distinct) else np.zeros(0, np.int64)
    _, word_of = letters_of(distinct.take(pa.array(brief)))
    alone = np.zeros(len(distinct), bool)
    alone[brief] = np.bincount(word_of, minlength=len(brief)) == 1
    single = alone[number] if len(number) else np.zeros(0, bool)
    edge = np.diff(np.r_[0, (single & ~np.r_[False, owner[1:] != owner[:-1]]).astype(np.int8), 0]) if len(number) else np.zeros(0)
    spelled = [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if b - a >= ORDER]
    if spelled:
        glued = pa.array(["".join(words.slice(a, b - a).to_pylist()) for a, b in spelled], pa.large_string())
        at = np.array([b for _, b in spelled])
        number = np.insert(number, at, len(distinct) + np.arange(len(glued)))
        owner = np.insert(owner, at, owner[[a for a, _ in spelled]])
        opens = np.insert(opens, at, False)
        distinct = pa.concat_arrays([distinct, glued])
    begin = np.flatnonzero(opens)
    return Sentences(distinct, number, begin, owner[begin], len(starts) - 1)


def pooled(found: Sentences, landmarks: Landmarks) -> np.ndarray:
    """sentences x landmarks: how much of each landmark the best word of the sentence holds."""
    held = landmarks.held_by(found.distinct)
    out = np.zeros((len(found.begin), len(landmarks.words)), np.float32)
    for lo in range(0, len(found.begin), 4096):
        hi = min(lo + 4096, len(found.begin))
        a = found.begin[lo]
        b = found.begin[hi] if hi < len(found.begin) else len(found.number)
        out[lo:hi] = np.maximum.reduceat(held[found.number[a:b]], found.begin[lo:hi] - a, axis=0)
    return out


# --- learning ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray  # of the pooled values, the map by K^(-1/2) multiplied in
    bias: float
    slope: float  # of the logistic curve over a text's margin
    shift: float

    def text_scores(self, column: pa.Array) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(column), _sigmoid(self.shift))
        found = sentences(column)
        margin = np.full(found.texts, self.bias)
        if len(found.begin):
            values = pooled(found, self.landmarks) @ self.weights + self.bias
            edge = np.flatnonzero(np.r_[True, found.text[1:] != found.text[:-1]])
            margin[found.text[edge]] = np.maximum.reduceat(values, edge)
        return _sigmoid(self.slope * margin + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """``label, text`` of the sample: labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    learn = F.expr("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) <> 1")
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col(label) == 1).cast("int").alias("label"))
        .where(learn & F.col("label").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample_rows)
    )
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # at most sample_rows pairs of numbers travel to the tasks that hold the texts
    sample = text.join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    return RunFolder(docs.sparkSession, "toxicity").write(sample.dropDuplicates(), "sample")


def _bare_words(column: pa.Array) -> tuple[Sentences, np.ndarray, pa.Array]:
    """Sentences, their numbers of words, and the distinct words without the marks around them."""
    found = sentences(column)
    bare = pc.replace_substring_regex(found.distinct, r"^[^\p{L}]+|[^\p{L}]+$", "")
    return found, np.diff(np.r_[found.begin, len(found.number)]), bare


def stem_counts(sample: DataFrame) -> DataFrame:
    """``stem, toxic, clean``: how many texts of each kind hold a word, or a word that begins so."""

    def count(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                found, size, bare = _bare_words(part["text"])
                label = np.asarray(part["label"])
                for cut in (*PREFIXES, PIECE):
                    stems = pc.utf8_slice_codeunits(bare, 0, cut).dictionary_encode()
                    pairs = np.unique(np.repeat(found.text, size) * len(found.distinct) + np.asarray(stems.indices)[found.number])
                    kind, which = label[pairs // max(len(found.distinct), 1)], pairs % max(len(found.distinct), 1)
                    toxic = np.bincount(which[kind == 1], minlength=len(stems.dictionary))
                    clean = np.bincount(which[kind == 0], minlength=len(stems.dictionary))
                    yield pa.record_batch(
                        {"stem": stems.dictionary.cast(pa.string()), "toxic": pa.array(toxic), "clean": pa.array(clean)}
                    )

    counts = sample.mapInArrow(count, "stem string, toxic bigint, clean bigint")
    # a word as short as a prefix length is met once for each; the largest count is the number of texts at most
    longest = F.char_length("stem") >= ORDER
    return counts.where(longest).groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_landmarks(sample: DataFrame, toxic_texts: int, clean_texts: int) -> Landmarks | None:
    """Stems that together cover the toxic texts, and common clean ones, none of which holds most of another.

    Covering keeps words out that toxic texts share only because they are copies of each other: once the stems
    that made the first of them toxic are taken, the others bring little.
    """
    counts = stem_counts(sample).where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
    in_toxic, in_clean = (F.col("toxic") + 0.5) / (toxic_texts + 1.0), (F.col("clean") + 0.5) / (clean_texts + 1.0)
    telling = counts.where(in_toxic > 3 * in_clean).orderBy(F.desc(in_toxic * F.ln(in_toxic / in_clean)), F.desc(F.char_length("stem")), "stem")
    common = counts.where(in_toxic <= 3 * in_clean).orderBy(F.desc("clean"), "stem")
    telling, common = ([r["stem"] for r in found.limit(CANDIDATES).collect()] for found in (telling, common))
    words = _apart(_cover(telling, stem_sets(sample, telling).collect()), [], TOXIC_LANDMARKS) if telling else []
    if not words:
        return None
    toxic = len(words)
    # for contrast, those of the common clean stems that come nearest to a toxic one
    near = Landmarks.of(words, toxic).held_by(pa.array(common, pa.large_string())).max(axis=1) if common else np.zeros(0)
    common = [common[i] for i in np.argsort(-near, kind="stable")]
    return Landmarks.of(_apart(common, words, min(2 * toxic, LANDMARKS)), toxic)


def stem_sets(sample: DataFrame, stems: list[str]) -> DataFrame:
    """``label, held``: which of ``stems`` each text of the sample holds, by number."""
    known = pa.array(stems, pa.large_string())

    def look_up(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                found, size, bare = _bare_words(part["text"])
                pairs = []
                for cut in (*PREFIXES, PIECE):
                    which = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(bare, 0, cut), known), -1)
                    pairs.append(np.repeat(found.text, size) * (len(stems) + 1) + np.asarray(which)[found.number] + 1)
                pairs = np.unique(np.concatenate(pairs))
                pairs = pairs[pairs % (len(stems) + 1) > 0]
                edges = np.searchsorted(pairs // (len(stems) + 1), np.arange(found.texts + 1))
                held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pairs % (len(stems) + 1) - 1, pa.int32()))
                yield pa.record_batch({"label": part["label"], "held": held})

    return sample.mapInArrow(look_up, "label int, held array<int>")


def _cover(stems: list[str], texts: list) -> list[str]:
    """Stems in the order of what they add; a clean text counts three times against them.

    A toxic text that n chosen stems already explain counts for AGAIN ** n.
    """
    holds = np.zeros((len(texts), len(stems)), bool)
    for i, r in enumerate(texts):
        holds[i, r["held"]] = True
    toxic = np.array([r["label"] == 1 for r in texts], bool)
    against, holds = 3 * holds[~toxic].sum(axis=0), holds[toxic]
    worth, out = np.ones(len(holds)), []
    while len(holds) and len(out) < 2 * TOXIC_LANDMARKS:
        gain = worth @ holds - against
        best = int(np.argmax(gain))
        if gain[best] < max(LEAST_TEXTS, LEAST_SHARE * len(holds)):
            break
        out.append(stems[best])
        worth = np.where(holds[:, best], worth * AGAIN, worth)
        against = against.copy()
        against[best] = 1 << 40
    return out


def _apart(candidates: list[str], taken: list[str], size: int) -> list[str]:
    """``taken`` and then candidates in order, up to ``size``, leaving out those that share most with one before."""
    out = list(taken)
    features = explicit_features(out + candidates)
    norm = (features**2).sum(axis=1)
    rows = list(range(len(out)))
    for i, word in enumerate(candidates, len(taken)):
        if len(out) >= size:
            break
        if norm[i] <= 0:
            continue
        both = features[rows] @ features[i] if rows else np.zeros(0)
        if len(both) and (both / np.minimum(norm[rows], norm[i])).max() > 0.6:
            continue
        out.append(word)
        rows.append(i)
    return out


def bags(sample: DataFrame, landmarks: Landmarks) -> DataFrame:
    """``label, rows, x``: of each text the BAG sentences nearest to a toxic landmark, packed."""
    shared = sample.sparkSession.sparkContext.broadcast(landmarks)

    def extract(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                found = sentences(part["text"])
                values = pooled(found, shared.value)
                near = values[:, : shared.value.toxic].max(axis=1) if len(values) else np.zeros(0)
                order = np.lexsort((np.arange(len(near)), -near, found.text))
                edges = np.searchsorted(found.text, np.arange(found.texts + 1))
                rows, data = [], []
                for i in range(found.texts):
                    best = values[order[edges[i] : edges[i + 1]][:BAG]]
                    rows.append(len(best))
                    data.append(pack(best.astype(np.float16)))
                yield pa.record_batch({"label": part["label"], "rows": pa.array(rows, pa.int32()), "x": pa.array(data, pa.binary())})

    return sample.mapInArrow(extract, "label int, rows int, x binary")


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, the bias last, of the machine with squared hinge loss: Newton steps on the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    w = np.zeros(z.shape[1])
    loss = lambda v: 0.5 * v @ penalty @ v + 0.5 * weight @ np.maximum(1 - y * (z @ v), 0) ** 2
    for _ in range(50):
        inside = y * (z @ w) < 1
        zi = z[inside] * weight[inside, None]
        target = np.linalg.solve(zi.T @ z[inside] + penalty, zi.T @ y[inside])
        step, before = 1.0, loss(w)
        while step > 1e-6 and loss(w + step * (target - w)) > before:
            step /= 2
        moved = step * (target - w)
        w = w + moved
        if np.abs(moved).max() < 1e-9:
            break
    return w


def fit_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve; targets a little inside 0 and 1 keep them finite."""
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(200):
        p = _sigmoid(z @ w)
        gradient = z.T @ (p - target) + 1e-6 * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "toxic") -> Model:
    """Landmarks, weights and curve from the labelled sample; only numbers of that bounded sample reach the driver."""
    sample = labelled(docs, labels, label, sample_rows)
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    landmarks = choose_landmarks(sample, toxic, clean) if toxic and clean else None
    if landmarks is None:
        share = min(max(toxic / (toxic + clean), 1e-6), 1 - 1e-6) if toxic + clean else 0.5
        return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = sorted(bags(sample, landmarks).collect(), key=lambda r: (r["label"], r["rows"], r["x"]))
    m = len(landmarks.words)
    held = [unpack(r["x"], np.float16).reshape(-1, m).astype(np.float64) if r["rows"] else np.zeros((1, m)) for r in rows]
    bag_label = np.array([r["label"] for r in rows])
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    values, edge = np.concatenate(held), np.searchsorted(owner, np.arange(len(held)))

    # Nystrom: coordinates in the span of the landmarks
    power, vectors = np.linalg.eigh(landmarks.gram)
    root = (vectors / np.sqrt(np.maximum(power, 1e-3))) @ vectors.T
    x = values @ root

    altered = landmarks.held_by(pa.array(_altered(landmarks.words[: landmarks.toxic]), pa.large_string())) @ root
    near = values[:, : landmarks.toxic].max(axis=1)
    is_toxic = bag_label[owner] == 1
    witness = _witnesses(near, owner, edge)
    for _ in range(ROUNDS):
        use = ~is_toxic
        use[witness[bag_label == 1]] = True
        y = np.where(is_toxic[use], 1.0, -1.0)
        weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1))
        # altered forms of what tells toxic texts, as heavy together as the toxic sentences
        w = fit_machine(
            np.vstack([x[use], altered]),
            np.r_[y, np.ones(len(altered))],
            np.r_[weight, np.full(len(altered), 1 / len(altered))],
            1e-4,
        )
        found = _witnesses(x @ w[:-1] + w[-1], owner, edge)
        if np.array_equal(found[bag_label == 1], witness[bag_label == 1]):
            break
        witness = found
    margin = np.maximum.reduceat(x @ w[:-1] + w[-1], edge)
    slope, shift = fit_curve(np.clip(margin, -1, 1), bag_label)  # beyond the margin all are equally sure
    return Model(landmarks, root @ w[:-1], float(w[-1]), slope, shift)


def _altered(words: list[str]) -> list[str]:
    """Each word as it is and with a letter doubled at every place: what a hidden insult may look like."""
    return [w[:i] + w[max(i - 1, 0) : i] + w[i:] for w in words for i in range(len(w))]


def _witnesses(value: np.ndarray, owner: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The first row of the largest value of each owner."""
    return np.lexsort((np.arange(len(value)), -value, owner))[edge]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                values = shared.value.text_scores(part["text"])
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"],
                        "held_out": pa.array(remainder(part["doc_id"].to_pylist(), 3) == 1),
                        "score": pa.array(values, pa.float64()),
                        "predicted": pa.array((values >= threshold).astype(np.int32)),
                    }
                )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")

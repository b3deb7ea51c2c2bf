"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over the texts.

Every word of a document extends or shortens the longest match that ends at it. A match of ``window``
words, or of a whole shorter item, is a hit. Items are cut into slices of a bounded number of words, one
automaton and one pass each, so that a benchmark of any size is matched whole with bounded memory.

Defined results: a null or empty text has no words and is clean; items without
text match nothing; an item without an id is matched like any other and only left out of ``n_items`` and
``items_sha256``; repeated items are separate items with the same matches; rows with the same id are judged on their own;
columns other than the named ones are carried by :func:`remove_spans` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.text import PLAIN, plain_words, steps

WINDOW = 10
SLICE_WORDS = 500_000


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            ends.append(last)
        self.ancestor = self._ancestors()
        self.window_items: dict[int, set[str]] = {}
        self.short: dict[tuple[int, int], set[str]] = {}
        for (name, words), _ in zip(items, ends):
            state, matched = 0, 0
            if len(words) < window:
                for w in words:
                    state = self.next[state][w]
                if words:
                    self.short.setdefault((state, len(words)), set()).add(name)
                continue
            for w in words:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    self.window_items.setdefault(self.ancestor[state], set()).add(name)
        # the shorter items that end in a state, along its suffix links
        by_state: dict[int, list[tuple[int, set[str]]]] = {}
        for (state, size), names in self.short.items():
            by_state.setdefault(state, []).append((size, names))
        self.short_at: list[list[tuple[int, set[str]]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_at[state] = by_state.get(state, []) + self.short_at[self.link[state]]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        target = self.next[state].get(w)
        return (target, matched + 1) if target is not None else (0, 0)

    def _ancestors(self) -> list[int]:
        """For each state the one on its suffix links that holds its last ``window`` words."""
        out = list(range(len(self.next)))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[self.link[state]] >= self.window:
                out[state] = out[self.link[state]]
        return out

    def matches(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered ranges of word positions, and the items whose windows occur."""
        ranges, names = [], set()
        state = matched = 0
        for i, w in enumerate(words):
            state, matched = self.step(state, matched, w)
            if not state:
                continue
            size = 0
            if matched >= self.window:
                size = self.window
                names |= self.window_items.get(self.ancestor[state], set())
            for length, items in self.short_at[state]:
                if length <= matched:
                    size = max(size, length)
                    names |= items
            if size:
                ranges.append((i + 1 - size, i + 1))
        return ranges, names


def _slices(items: DataFrame, item_id: str, text: str, slice_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in slices that hold a bounded number of words; read one partition at a time."""
    chosen = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where(
        "t IS NOT NULL"
    )
    part, size = [], 0
    for row in chosen.toLocalIterator():
        words = bytes(PLAIN[np.frombuffer(row.t.encode(), np.uint8)]).split()
        part.append((row.i, words))
        size += len(words)
        if size >= slice_words:
            yield part
            part, size = [], 0
    yield part


class _Matcher:
    """An automaton over the words of one slice of items, sent once to each executor."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.words = sorted({w for _, ws in items for w in ws})
        number = {w: i for i, w in enumerate(self.words)}
        numbered = [(name, [number[w] for w in ws]) for name, ws in items]
        self.automaton = Automaton(numbered, window)
        self.shortest = min([min(len(ws), window) for _, ws in items if ws], default=window)
        self.values = pa.array([w.decode() for w in self.words], pa.large_string())

    def scan(self, words: pa.Array, starts: np.ndarray):
        """For each text with known runs long enough: its covered mask and items."""
        known = np.asarray(pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=self.values), -1))
        hit, items = np.zeros(len(known), bool), {}
        # a run of known words never crosses a text, and only runs as long as the shortest window can match
        edge = np.zeros(len(known) + 1, bool)
        edge[starts] = True
        in_run = known >= 0
        begins = np.flatnonzero(in_run & (edge[:-1] | ~np.r_[False, in_run[:-1]]))
        ends = np.flatnonzero(in_run & (edge[1:] | ~np.r_[in_run[1:], False])) + 1
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        owners = np.searchsorted(starts, begins, "right") - 1
        for begin, end, owner in zip(begins.tolist(), ends.tolist(), owners.tolist()):
            ranges, names = self.automaton.matches(known[begin:end].tolist())
            for a, b in ranges:
                hit[begin + a : begin + b] = True
            if names:
                items.setdefault(owner, set()).update(names)
        return hit, items


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    slice_words: int = SLICE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    spark = docs.sparkSession
    shared = [
        spark.sparkContext.broadcast(_Matcher(part, window))
        for part in _slices(items, item_id, item_text, slice_words)
    ]

    def scan(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                words, starts = plain_words(part["text"])
                covered, found = np.zeros(len(words), bool), {}
                for one in shared:
                    hit, names = one.value.scan(words, starts)
                    covered |= hit
                    for owner, more in names.items():
                        found.setdefault(owner, set()).update(more)
                total = np.r_[0, np.cumsum(covered)]
                n_hit = np.diff(total[starts])
                lists = [sorted(found.get(i, set()) - {None}) for i in range(part.num_rows)]
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"],
                        "n_words": pa.array(np.diff(starts)),
                        "n_hit": pa.array(n_hit),
                        "n_items": pa.array([len(x) for x in lists], pa.int64()),
                        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
                        "contaminated": pa.array(n_hit > 0),
                    }
                )

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(
        scan,
        "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    )


def remove_spans(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5, text: str = "text"
) -> DataFrame:
    """``docs`` with every hit word taken out of ``text``; documents hit beyond ``coverage`` are left out.

    Untouched texts stay byte for byte. All other columns stay as they are.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(_Matcher(p, window)) for p in _slices(items, "item_id", "text", SLICE_WORDS)]

    def clean(batches):
        for batch in batches:
            for part in steps(batch, text):
                words, starts = plain_words(part[text])
                covered = np.zeros(len(words), bool)
                for one in shared:
                    covered |= one.value.scan(words, starts)[0]
                total = np.diff(np.r_[0, np.cumsum(covered)][starts])
                share = total / np.maximum(np.diff(starts), 1)
                values = part[text].to_pylist() if total.any() else None
                column = part[text]
                if values is not None:
                    for i in np.flatnonzero(total):
                        values[i] = _without(values[i], covered[starts[i] : starts[i + 1]])
                    column = pa.array(values, part[text].type)
                out = part.set_column(part.schema.get_field_index(text), text, column)
                yield out.filter(pa.array(share <= coverage))

    return docs.mapInArrow(clean, docs.schema)


def _without(value: str, covered: np.ndarray) -> str:
    """``value`` without its covered plain words; what lies between two covered words goes with them."""
    raw = np.frombuffer(value.encode(), np.uint8)
    inside = np.r_[False, PLAIN[raw] != 32, False]
    begins = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    drop = np.zeros(len(raw) + 1, np.int64)
    np.add.at(drop, begins[covered], 1)
    np.add.at(drop, ends[covered], -1)
    both = covered[1:] & covered[:-1]
    np.add.at(drop, ends[:-1][both], 1)
    np.add.at(drop, begins[1:][both], -1)
    return raw[np.cumsum(drop[:-1]) == 0].tobytes().decode()

"""Connected components as a loop of joins; every round is a table in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import RunFolder


def components(edges: DataFrame, run: RunFolder, name: str) -> DataFrame:
    """``(id, label)`` for every id in ``edges(a, b)``: the smallest id that it reaches.

    Each round takes the smallest label among neighbours and then the label of that label, so a chain
    shrinks by more than half. A hot id only makes one side of a join skewed, which adaptive execution
    splits; nothing is gathered by id.
    """
    both = run.write(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{name}-edges",
    )
    labels = run.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        offered = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offered, "id").select("id", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = run.write(
            lower.join(jump, "label").select("id", "old", F.least("label", "further").alias("label")),
            f"{name}-{step}",
        )
        labels = after.select("id", "label")
        if after.where("old <> label").isEmpty():
            return labels


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the edges ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label

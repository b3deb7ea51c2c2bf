"""Many-to-one joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import shuffle_partitions


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str,
    sizes: DataFrame,
    how: str = "inner",
    hashed: bool = False,
) -> DataFrame:
    """``facts`` joined to the row (or the few rows) of ``dim`` with the same ``key``.

    ``sizes(key, n)`` gives the number of fact rows per key. A key is hot when it alone would fill more
    than an average shuffle partition; it is cut into as many parts as partitions it would fill, by the
    hash of ``spread``. There are fewer hot keys than partitions and at most twice as many extra
    dimension rows, whatever the data, so broadcasting the list of hot keys is bounded.

    With ``hashed`` a task holds its share of ``dim`` and lets the facts pass; otherwise both sides are sorted, and
    facts of more than the task's memory spill. It is for a ``dim`` whose rows, dealt to all partitions, fit in memory.
    """
    parts = shuffle_partitions(facts.sparkSession)
    share = sizes.agg(F.greatest(F.sum("n") / parts, F.lit(1.0)).alias("share"))
    filled = F.ceil(F.col("n") / share.scalar()).cast("int")
    hot = sizes.select(key, filled.alias("_cuts")).where("_cuts > 1")
    cuts = F.coalesce(F.col("_cuts"), F.lit(1))
    salted_facts = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), cuts).cast("int")
    )
    salted_dim = dim.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), cuts - 1))
    )
    looked_up = salted_dim.drop("_cuts")
    return salted_facts.drop("_cuts").join(looked_up.hint("shuffle_hash") if hashed else looked_up, [key, "_salt"], how).drop("_salt")

"""Columns that hold one value per topic.

The expressions are SQL text on purpose: a vector expression has hundreds of nodes, and building it node
by node from Python costs more than running it on a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: float) -> str:
    return f"{float(value)!r}D"


def per_topic(k: int, fn: Callable[[int], str]) -> Column:
    """An array with the SQL expression ``fn(i)`` for every topic."""
    return F.expr("array(" + ", ".join(fn(i) for i in range(k)) + ")")


def literal(values: Sequence[float]) -> Column:
    """A constant vector. Spark keeps it out of the generated source, so loops reuse compiled code."""
    return F.expr(literal_sql(values))


def literal_sql(values: Sequence[float]) -> str:
    return "array(" + ", ".join(number(v) for v in values) + ")"


def sum_vectors(column: str, k: int) -> Column:
    return per_topic(k, lambda i: f"sum({column}[{i}])")


def total_sql(array: str) -> str:
    return f"aggregate({array}, 0D, (s, x) -> s + x)"


def dot_sql(left: str, right: str) -> str:
    return total_sql(f"zip_with({left}, {right}, (x, y) -> x * y)")


def ratio_sql(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> x / y)"


def expected_rate_sql(mu: str, sig: str) -> str:
    """E[exp(w)] = exp(mu + sig / 2) of a normal with variance sig, element by element."""
    return f"zip_with({mu}, {sig}, (x, y) -> exp(x + 0.5D * y))"

"""Digamma and log-gamma, which Spark lacks, as SQL expressions and as Arrow array functions.

Both shift the argument up by eight with the recurrence and use the asymptotic series there. The eight
factors x(x+1)...(x+7) pair up as t, t+6, t+10, t+12 with t = x(x+7), which halves the divisions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients B_2n / 2n and B_2n / (2n (2n - 1)) of the two asymptotic series.
DIGAMMA_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def _horner(coefficients, x):
    value = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        value = value * x + c
    return value


def digamma_sql(x: str) -> str:
    """Digamma of the SQL expression ``x`` as a SQL expression."""
    z, t = f"(({x}) + 8D)", f"(({x}) * (({x}) + 7D))"
    series = _horner_sql(DIGAMMA_SERIES, f"{z} * {z}")
    pairs = " + ".join(f"1D / ({t} + {c}D)" for c in (0, 6, 10, 12))
    return f"(ln({z}) - 0.5D / {z} - ({series}) / ({z} * {z}) - (2D * ({x}) + 7D) * ({pairs}))"


def lgamma_sql(x: str) -> str:
    """Log-gamma of the SQL expression ``x`` as a SQL expression."""
    z, t = f"(({x}) + 8D)", f"(({x}) * (({x}) + 7D))"
    series = _horner_sql(LGAMMA_SERIES, f"{z} * {z}")
    return (
        f"(({z} - 0.5D) * ln({z}) - {z} + {HALF_LN_2PI!r}D + ({series}) / {z}"
        f" - ln({t}) - ln(({t} + 6D) * ({t} + 10D) * ({t} + 12D)))"
    )


def _horner_sql(coefficients, divisor: str) -> str:
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({text}) / ({divisor}) + {c!r}D"
    return text.replace("+ -", "- ")


def digamma(column: str) -> Column:
    return F.expr(digamma_sql(column))


def lgamma(column: str) -> Column:
    return F.expr(lgamma_sql(column))


def np_digamma(x):
    x = np.asarray(x, dtype=float)
    z = x + 8.0
    t = x * (x + 7.0)
    inv2 = 1.0 / (z * z)
    return (
        np.log(z)
        - 0.5 / z
        - inv2 * _horner(DIGAMMA_SERIES, inv2)
        - (2.0 * x + 7.0) * (1.0 / t + 1.0 / (t + 6.0) + 1.0 / (t + 10.0) + 1.0 / (t + 12.0))
    )


def np_lgamma(x):
    x = np.asarray(x, dtype=float)
    z = x + 8.0
    t = x * (x + 7.0)
    inv = 1.0 / z
    return (
        (z - 0.5) * np.log(z)
        - z
        + HALF_LN_2PI
        + inv * _horner(LGAMMA_SERIES, inv * inv)
        - np.log(t)
        - np.log((t + 6.0) * (t + 10.0) * (t + 12.0))
    )


def np_trigamma(x):
    """Used on the driver for the K-sized Newton step of the second-level scale."""
    x = np.asarray(x, dtype=float)
    shifted = sum(1.0 / (x + i) ** 2 for i in range(8))
    z = x + 8.0
    inv2 = 1.0 / (z * z)
    return shifted + 1.0 / z + 0.5 * inv2 + (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))) * inv2 / z


# Rows of the chunks in which an Arrow batch is evaluated, so that temporaries stay in the CPU cache.
_CHUNK = 1 << 14


def _map_chunks(fn, values: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    for lo in range(0, len(values), _CHUNK):
        out[lo : lo + _CHUNK] = fn(values[lo : lo + _CHUNK])
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def digamma_array(arrays: pa.Array) -> pa.Array:
    """Digamma of every element; one Arrow batch at a time."""
    values = arrays.flatten().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(_offsets(arrays), pa.array(_map_chunks(np_digamma, values)))


@F.arrow_udf(T.DoubleType())
def lgamma_array_sum(arrays: pa.Array) -> pa.Array:
    """Sum of log-gamma over the elements of each array; all arrays hold one value per topic."""
    if len(arrays) == 0:
        return pa.array([], pa.float64())
    values = arrays.flatten().to_numpy(zero_copy_only=False)
    return pa.array(_map_chunks(np_lgamma, values).reshape(len(arrays), -1).sum(axis=1))


@F.arrow_udf(T.BinaryType())
def pack(arrays: pa.Array) -> pa.Array:
    """Each array of doubles as its bytes. Packed vectors move through joins and shuffles as one value."""
    return pack_rows(arrays.flatten().to_numpy(zero_copy_only=False), len(arrays))


@F.arrow_udf(T.BinaryType())
def digamma_packed(arrays: pa.Array) -> pa.Array:
    """Digamma of every element, packed."""
    values = arrays.flatten().to_numpy(zero_copy_only=False)
    return pack_rows(_map_chunks(np_digamma, values), len(arrays))


def pack_rows(values: np.ndarray, rows: int) -> pa.Array:
    width = 8 * len(values) // rows if rows else 0
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    data = np.ascontiguousarray(values, dtype="<f8")
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack_rows(packed: pa.Array, k: int) -> np.ndarray:
    """The rows x k matrix of a packed column, all of whose vectors have k entries."""
    if len(packed) == 0:
        return np.empty((0, k))
    offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2][offsets[0] : offsets[-1]], dtype="<f8").reshape(-1, k)


def _offsets(arrays: pa.Array) -> pa.Array:
    start = arrays.offsets[0].as_py() if len(arrays) else 0
    return pa.array(arrays.offsets.to_numpy() - start, pa.int32())

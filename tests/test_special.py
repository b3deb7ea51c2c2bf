import math

import numpy as np
import pytest

from topicloom.functions.special import (
    digamma,
    digamma_array,
    digamma_packed,
    lgamma,
    lgamma_array_sum,
    np_digamma,
    np_lgamma,
    np_trigamma,
    pack,
    unpack_rows,
)
from twin import psi

X = np.array([1e-9, 1e-3, 0.1, 0.5, 1.0, 2.5, 7.9, 8.0, 33.3, 1e3, 1e7])


def test_numpy_functions():
    assert np_digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert np.allclose(np_digamma(X), psi(X), rtol=1e-11, atol=1e-11)
    assert np.allclose(np_lgamma(X), [math.lgamma(x) for x in X], rtol=1e-12, atol=1e-11)
    h = 1e-5 * X[3:]
    assert np.allclose(np_trigamma(X[3:]), (psi(X[3:] + h) - psi(X[3:] - h)) / (2 * h), rtol=1e-4)


def test_columns_agree_with_numpy(spark):
    rows = spark.createDataFrame([(float(x),) for x in X], "x double").select("x", digamma("x"), lgamma("x")).collect()
    for x, d, g in rows:
        assert d == pytest.approx(float(np_digamma(x)), rel=1e-12, abs=1e-12)
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.5],), ([0.1, 33.0],), ([8.0, 9.0],)], "v array<double>").repartition(2)
    out = df.select("v", digamma_array("v").alias("d"), lgamma_array_sum("v").alias("s"), digamma_packed("v").alias("p"))
    for row in out.collect():
        v = np.array(row["v"])
        assert np.allclose(row["d"], psi(v))
        assert row["s"] == pytest.approx(sum(math.lgamma(x) for x in v), abs=1e-10)
        assert np.allclose(np.frombuffer(row["p"], "<f8"), psi(v))


def test_pack_round_trip(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.5],), ([0.0, 1e300, -1e-300],)], "v array<double>")
    table = df.select("v", pack("v").alias("p")).coalesce(1).toArrow()
    packed = table["p"].combine_chunks().cast("binary")
    assert np.array_equal(unpack_rows(packed, 3), np.array(table["v"].to_pylist()))
    assert np.array_equal(unpack_rows(packed.slice(1, 1), 3), np.array(table["v"].to_pylist())[1:])

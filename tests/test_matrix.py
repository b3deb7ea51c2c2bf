import tracemalloc

import numpy as np
import pytest

from topicloom.operators import matrix as op
from topicloom.session import RunFolder
from topicloom.sources import matrix_text


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(150, 90)), rng.normal(size=(90, 70))
    a[rng.random(a.shape) < 0.7] = 0
    b[rng.random(b.shape) < 0.5] = 0
    a[:, 5] = 0
    return a, b


def table(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "i bigint, j bigint, value double")


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, value double")


def back(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r)[:-1]] = np.nan if r["value"] is None else r["value"]
    return out


def test_products(spark, dense):
    a, b = dense
    ta, tb = table(spark, a), table(spark, b)
    assert np.allclose(back(op.matrix_multiply(ta, tb), (150, 70)), a @ b)
    assert np.allclose(back(op.gram(ta), (90, 90)), a.T @ a)
    x = np.arange(90.0)
    assert np.allclose(back(op.matrix_vector(ta, vector(spark, x)), (150,)), a @ x)
    y = np.arange(150.0)
    assert np.allclose(back(op.matrix_vector(ta, vector(spark, y), transpose=True), (90,)), a.T @ y)


def test_sums_and_norms(spark, dense):
    a, _ = dense
    ta = table(spark, a)
    assert np.allclose(back(op.matrix_sums(ta, 1), (90,)), a.sum(0))
    assert np.allclose(back(op.matrix_sums(ta, 2), (150,)), a.sum(1))
    norm = np.linalg.norm(a, axis=0)
    assert np.allclose(back(op.normalize(ta, 1), a.shape), a / np.where(norm > 0, norm, 1))
    assert np.allclose(back(op.normalize(ta, 2), a.shape), a / np.linalg.norm(a, axis=1)[:, None])
    assert np.allclose(back(op.normalize_vector(vector(spark, [3.0, 4.0])), (2,)), [0.6, 0.8])
    assert np.isnan(back(op.normalize_vector(vector(spark, [0.0])), (1,))).all()
    with pytest.raises(ValueError):
        op.matrix_sums(ta, 3)


def test_elementwise(spark, dense):
    a, _ = dense
    c = np.roll(a, 1, axis=0)
    ta, tc = table(spark, a), table(spark, c)
    assert np.allclose(back(op.elementwise_product(ta, tc), a.shape), a * c)
    assert np.allclose(back(op.difference(ta, tc), a.shape), a - c)
    x, y = np.arange(4.0), np.array([2.0, 0.0, 1.0, -1.0])
    assert op.dot_product(vector(spark, x), vector(spark, y)).first()["value"] == x @ y


def test_inner_sizes_must_agree(spark, dense):
    a, b = dense
    with pytest.raises(ValueError):
        op.matrix_multiply(table(spark, a), table(spark, b), shapes=((150, 90), (70, 90)))
    with pytest.raises(ValueError):
        op.matrix_vector(table(spark, a), vector(spark, [1.0]), shape=(150, 90), size=1)


def test_text_round_trip(spark, tmp_path):
    a = np.array([[1.5, -2.25, 0.0], [1e6, 3.125, -0.5]])
    full = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i bigint, j bigint, value double")
    matrix_text.write_matrix(full, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text == "1.500000,-2.250000,0.000000,\n1000000.000000,3.125000,-0.500000,\n"
    again = matrix_text.read_matrix(spark, str(tmp_path / "m"))
    assert np.array_equal(back(again, (2, 3)), a)
    assert tuple(matrix_text.matrix_shape(again).first()) == (2, 3)
    matrix_text.write_vector(vector(spark, [0.25, -7.0]), str(tmp_path / "v"))
    assert back(matrix_text.read_vector(spark, str(tmp_path / "v")), (2,)).tolist() == [0.25, -7.0]


def test_sparse_cells_keep_their_place(spark, tmp_path):
    sparse = spark.createDataFrame([(0, 0, 1.0), (0, 2, 3.0), (2, 1, 5.0)], "i bigint, j bigint, value double")
    matrix_text.write_matrix(sparse, str(tmp_path / "s"))
    back = {(r.i, r.j): r.value for r in matrix_text.read_matrix(spark, str(tmp_path / "s")).collect()}
    assert back == {(i, j): {(0, 0): 1.0, (0, 2): 3.0, (2, 1): 5.0}.get((i, j), 0.0) for i in range(3) for j in range(3)}
    gap = matrix_text.parse_matrix_lines(spark.createDataFrame([(0, "1,,3,")], "i bigint, line string"))
    assert sorted((r.j, r.value) for r in gap.collect()) == [(0, 1.0), (2, 3.0)]


def test_sparse_products_have_dense_and_rare_inner_indices(spark):
    """Inner index 0 is in every row, some in many, most in one or two; stored zeros and large ids stay."""
    rng = np.random.default_rng(8)
    rows = [(i * 10**9, 0, 1.0 + i) for i in range(200)]
    rows += [(i * 10**9, 1 + j, float(rng.normal())) for j in range(5) for i in range(0, 200, 1 + j * 4)]
    rows += [(int(rng.integers(200)) * 10**9, 100 + j, float(rng.integers(0, 2))) for j in range(400)]
    rows += [(0, 5000, 0.0), (10**9, 5000, 0.0)]
    other = [(j, int(rng.integers(150)), float(rng.normal())) for _, j, _ in rows[::2]] + [(0, c, 2.0) for c in range(150)]
    schema = "i bigint, j bigint, value double"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    plain = {}
    by_inner = {}
    for i, j, v in other:
        by_inner.setdefault(i, []).append((j, v))
    for i, j, v in rows:
        for c, w in by_inner.get(j, []):
            plain[i, c] = plain.get((i, c), 0.0) + v * w
    got = {(r["i"], r["j"]): r["value"] for r in op.matrix_multiply(a, b).collect()}
    assert got.keys() == plain.keys() and all(np.isclose(got[k], plain[k]) for k in plain)

    flipped = a.selectExpr("j AS i", "i AS j", "value")  # rows are the inner index of a Gram matrix
    plain = {}
    by_inner = {}
    for i, j, v in rows:
        by_inner.setdefault(j, []).append((i, v))
    for cells in by_inner.values():
        for x, v in cells:
            for y, w in cells:
                plain[x, y] = plain.get((x, y), 0.0) + v * w
    got = {(r["i"], r["j"]): r["value"] for r in op.gram(flipped).collect()}
    assert got.keys() == plain.keys() and all(np.isclose(got[k], plain[k]) for k in plain)


def test_products_without_a_common_inner_index(spark):
    a = spark.createDataFrame([(0, 1, 2.0)], "i bigint, j bigint, value double")
    b = spark.createDataFrame([(2, 3, 4.0)], "i bigint, j bigint, value double")
    assert op.matrix_multiply(a, b).count() == 0
    assert op.gram(a.limit(0)).count() == 0
    kept = op.matrix_multiply(a, a.selectExpr("j AS i", "i AS j", "0D AS value")).collect()
    assert [tuple(r) for r in kept] == [(0, 0, 0.0)]


def test_cells_outside_the_shape_are_errors(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (5, 5, 9.0)], "i bigint, j bigint, value double")
    with pytest.raises(Exception, match="outside"):
        matrix_text.matrix_lines(cells, (2, 2)).collect()
    with pytest.raises(Exception, match="outside"):
        matrix_text.matrix_lines(cells.selectExpr("i - 1 AS i", "j", "value")).collect()
    assert matrix_text.matrix_lines(cells, (6, 6)).count() == 6
    places = spark.createDataFrame([(0, 1.0), (4, 2.0)], "i bigint, value double")
    with pytest.raises(Exception, match="outside"):
        matrix_text.write_vector(places, str(tmp_path / "v"), 3)
    matrix_text.write_vector(places, str(tmp_path / "w"), 6)
    assert [r["value"] for r in matrix_text.read_vector(spark, str(tmp_path / "w")).orderBy("i").collect()] == [1.0, 0, 0, 0, 2.0, 0]


def test_text_rounds_exact_values_as_c_does(spark, tmp_path):
    """0.0078125 and 0.0234375 are halves at six decimals: the nearest even digit. 0.1234565 is a little less than a half."""
    values = [0.0078125, 0.0234375, -0.0078125, 0.1234565, -1e-9, float("nan"), float("inf")]
    rows = [(0, j, x) for j, x in enumerate(values)]
    expected = ",".join("%.6f" % x for x in values) + ","
    assert expected.startswith("0.007812,0.023438,-0.007812,")
    matrix = spark.createDataFrame(rows, "i bigint, j bigint, value double")
    assert [r["line"] for r in matrix_text.matrix_lines(matrix).collect()] == [expected]
    matrix_text.write_vector(vector(spark, values[:4]), str(tmp_path / "v"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()) == sorted("%.6f" % x for x in values[:4])


def test_gram_of_many_columns_shuffles_no_products(spark, monkeypatch):
    """Common and rare inner indices, a stored zero, strips of rows; nothing is grouped after the products."""
    rng = np.random.default_rng(8)
    a = rng.integers(1, 5, (40, 300)).astype(float)
    a[rng.random(a.shape) < np.linspace(0.1, 0.99, 40)[:, None]] = 0
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))] + [(100, 0, 0.0), (100, 1, 2.0)]
    cells = spark.createDataFrame(rows, "i bigint, j bigint, value double")
    expected = a.T @ a
    present = ((a > 0).astype(int).T @ (a > 0).astype(int)) > 0
    present[:2, :2] = True
    for budget in (1 << 22, 500):
        monkeypatch.setattr(op, "PRODUCT_CELLS", budget)
        out = op._finished_products(cells.select(cells.i.alias("at"), cells.j.alias("out"), "value"), 5)
        got = {(r["i"], r["j"]): r["value"] for r in out.collect()}
        assert len(got) == out.count() and all(i <= j for i, j in got)
        more = {(0, 0): 0.0, (0, 1): 0.0, (1, 1): 4.0}
        assert got == {(i, j): expected[i, j] + more.get((i, j), 0.0) for i, j in zip(*np.nonzero(np.triu(present)))}
    gram = op.gram(cells)
    plan = gram._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    assert gram.count() == present.sum()


def test_left_cells_of_a_narrow_product_are_not_sorted(spark, monkeypatch):
    """Dense and sparse inner indices, listed to the tasks or looked up; the narrow side is held, the other passes."""
    rng = np.random.default_rng(5)
    a = (rng.random((60, 90)) < np.where(np.arange(90) < 8, 0.9, 0.05)) * rng.integers(1, 5, (60, 90)).astype(float)
    b = (rng.random((90, 2)) < 0.6) * rng.integers(1, 5, (90, 2)).astype(float)
    left, right = table(spark, a), table(spark, b)
    for listed in (op.LISTED, 0):
        monkeypatch.setattr(op, "LISTED", listed)
        product = op.matrix_multiply(left, right)
        assert "ShuffledHashJoin" in product._jdf.queryExecution().executedPlan().toString()
        assert np.allclose(back(product, (60, 2)), a @ b)


def test_tiles_of_a_gram_matrix_travel_packed(spark, monkeypatch):
    """Tiles move once for every other tile; unpacked, each cell takes 24 bytes."""
    rng = np.random.default_rng(12)
    rows = sorted({(int(i), int(j)) for i, j in zip(rng.zipf(1.5, 40_000) % 3000 - 5, rng.integers(0, 900, 40_000))})
    cells = spark.createDataFrame([(i, j, float(1 + (i + j) % 4)) for i, j in rows], "i bigint, j bigint, value double")
    tables, write = {}, RunFolder.write

    def noted(self, df, name, partition_by=None):
        tables[name] = write(self, df, name, partition_by)
        return tables[name]

    monkeypatch.setattr(RunFolder, "write", noted)
    found = {(r.i, r.j): r.value for r in op.gram(cells).collect()}
    dense = np.zeros((3006, 900))
    for i, j in rows:
        dense[i, j] = 1 + (i + j) % 4
    expected = dense.T @ dense
    there = (dense > 0).astype(np.float32)
    assert set(found) == set(zip(*(x.tolist() for x in np.nonzero(there.T @ there))))
    assert all(abs(v - expected[at]) < 1e-9 for at, v in found.items())
    columns = [c for c in tables["tiles"].columns if c != "tile"]
    moved = sum(len(r[c]) for r in tables["tiles"].collect() for c in columns)
    assert moved < 8 * len(rows)


def test_a_gram_kernel_holds_few_products():
    rng = np.random.default_rng(13)
    at, out = np.sort(rng.integers(0, 3000, 250_000)), rng.integers(0, 2000, 250_000)
    tile = [out, at, np.ones(len(at))]
    tracemalloc.start()
    cells = sum(part.num_rows for part in op._tile_products(tile, tile, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cells and peak < 150 << 20

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tensorloom.frame import Span, TensorFrame
from tensorloom.operators import create

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def cube(spark):
    a = np.arange(24).reshape(2, 3, 4)
    return a, TensorFrame.from_nested(spark, a)


def same(t, a):
    assert t.shape == a.shape
    assert np.allclose(t.collect().astype(float), a.astype(float))


def test_slices(cube):
    a, t = cube
    same(t[Span(), Span(2, 0, -1), Span(0, 3, 2)], a[:, ::-1, ::2])
    same(t[1, ..., 1:3], a[1:2, :, 1:3])
    same(t.at(1, Span(), 2), a[1, :, 2])
    with pytest.raises(IndexError):
        t[2]


def test_put(spark, cube):
    a, t = cube
    b = a.copy()
    b[0, :2] = 7
    same(t.put((0, Span(0, 1)), 7), b)
    b[:, ::2] = np.arange(16).reshape(2, 2, 4)
    same(t.put((0, Span(0, 1)), 7).put((Span(), Span(0, 2, 2)), TensorFrame.from_nested(spark, np.arange(16).reshape(2, 2, 4))), b)


def test_shapes(cube):
    a, t = cube
    same(t.reshape((6, -1)), a.reshape(6, 4))
    same(t.permute(2, 0, 1), a.transpose(2, 0, 1))
    same(t.moveaxis(0, 2), np.moveaxis(a, 0, 2))
    same(t.roll(3), np.roll(a, 3))
    same(t.roll(-1, 1), np.roll(a, -1, 1))
    same(t.repeat_values(2, 1), np.repeat(a, 2, 1))
    same(t.tile(1, 2, 1), np.tile(a, (1, 2, 1)))
    same(t.unsqueeze(1).squeeze(1), a)
    same(TensorFrame.stack([t, t], 1), np.stack([a, a], 1))
    assert [p.shape for p in t.split(2, 2)] == [(2, 3, 2)] * 2
    assert [p.shape[2] for p in t.chunk(3, 2)] == [2, 1, 1]
    with pytest.raises(ValueError):
        t.reshape((-1, -1))


def test_reductions(cube):
    a, t = cube
    same(t.sum(1), a.sum(1, keepdims=True))
    same(t.max(0), a.max(0, keepdims=True))
    assert t.mean().item() == 11
    same(t.cast("double").std(2), a.std(2, ddof=1, keepdims=True))
    same(t.cast("double").percentile(30, 2), np.percentile(a, 30, axis=2, keepdims=True))
    same(t.argmax(2)[0], a.argmax(2)[..., None])
    assert not t.all().item() and t.any().item()


def test_selection(spark, cube):
    a, t = cube
    same(t.masked_select(lambda v: v % 5 == 0), a[a % 5 == 0])
    same(t.index_select(2, [3, 0, 3]), a[:, :, [3, 0, 3]])
    same(t.nonzero(), np.array(np.nonzero(a)))
    mask = TensorFrame.from_nested(spark, [True, False, True])
    same(t.masked_axis_select(mask, 1), a[:, [0, 2]])
    b = a.copy()
    b[a > 20] = [1, 2, 3]
    same(t.masked_fill(lambda v: v > 20, [1, 2, 3]), b)
    same(t.index_fill(1, [0, -1], [5, 6]).max(0).max(2), np.array([[[5], [19], [6]]]))


def test_order_and_sets(spark):
    v = np.array([3.0, 1, 2, 2, -5])
    t = TensorFrame.from_nested(spark, v)
    same(t.argsort(), np.array([4, 1, 2, 3, 0]))
    same(t.argsort(True), np.array([0, 2, 3, 1, 4]))
    same(t.unique(), np.array([3.0, 1, 2, -5]))
    same(t.cumprod(), np.cumprod(v))
    same(t.diff(2), np.diff(v, 2))
    k = TensorFrame.from_nested(spark, [1.0, 2.0, 4.0])
    for mode in ("full", "same", "valid"):
        same(t.convolve(k, mode), np.convolve(v, [1, 2, 4], mode))
        same(t.correlate(k, mode), np.correlate(v, [1, 2, 4], mode))
    same(t.intersection(TensorFrame.from_nested(spark, [2.0, 3.0, 9.0])), np.array([2.0, 3.0]))


def test_long_cumsum(spark):
    same(create.arange(spark, 0, 1000).cumsum(chunk=64), np.cumsum(np.arange(1000)))


def test_contractions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((4, 3)), rng.random((3, 5))
    x, y = TensorFrame.from_nested(spark, a), TensorFrame.from_nested(spark, b)
    same(x @ y, a @ b)
    same(TensorFrame.einsum("ij,jk,lk->il", x, y, y @ y.transpose() @ y), np.einsum("ij,jk,lk->il", a, b, b @ b.T @ b))
    same(TensorFrame.einsum("ij,kl->ijkl", x, y), np.einsum("ij,kl->ijkl", a, b))
    same(x * TensorFrame.from_nested(spark, [[1.0, 2.0, 3.0]]), a * np.array([[1, 2, 3]]))
    with pytest.raises(ValueError):
        TensorFrame.einsum("ij,ij->i", x, y)


def test_special_matrices(spark):
    t = create.arange(spark, 1, 5)
    same(create.toeplitz(t), np.array([[abs(i - j) + 1 for j in range(4)] for i in range(4)]))
    same(create.hankel(t), np.array([[i + j + 1 if i + j < 4 else 0 for j in range(4)] for i in range(4)]))
    same(create.vandermonde(t, increasing=False), np.vander([1, 2, 3, 4]))
    a = np.arange(12).reshape(3, 4)
    x = TensorFrame.from_nested(spark, a)
    same(create.diagonal(x, 1), np.diag(a, 1))
    same(create.diagonal(x, 0, True), np.diag(np.fliplr(a)))
    same(create.triu(x, 1), np.triu(a, 1))
    with pytest.raises(ValueError):
        create.arange(spark, 0, 1, 0)


@QUICK
@given(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(0, 3))
def test_random_shapes(spark, shape, axis):
    a = np.arange(np.prod(shape)).reshape(shape) - 3
    t = TensorFrame.from_nested(spark, a)
    k = axis % len(shape)
    same(t.sum(k), a.sum(k, keepdims=True))
    same(t.transpose(), a.T)
    same(t.roll(2, k), np.roll(a, 2, k))


def test_arrow_items_and_axes(spark):
    a = np.random.default_rng(1).random((3, 4))
    t = TensorFrame.from_arrow(spark, a)
    same(t, a)
    assert [v for _, v in t.items()] == a.ravel().tolist()
    same(t.apply_axis(lambda v: v - v.mean(), 1), a - a.mean(1, keepdims=True))
    assert t.distinct_values().count() == 12


def test_precedes(spark):
    a, b, c = (TensorFrame.from_nested(spark, x) for x in ([1, 2, 3], [1, 3, 0], [1, 2]))
    assert a.precedes(b) and not b.precedes(a) and not a.precedes(a)
    assert c.precedes(a) and not a.precedes(c) and c.precedes(b)


def test_masked_axis_select_on_a_long_axis(spark):
    """More places than one chunk of the numbering holds."""
    n = 70_000
    t = TensorFrame.generate(spark, (n, 1), lambda i, j: i)
    mask = TensorFrame.generate(spark, (n,), lambda i: i % 35_000 == 34_999)
    assert [(r["i0"], r["v"]) for r in t.masked_axis_select(mask, 0).df.orderBy("i0").collect()] == [(0, 34_999), (1, 69_999)]


def test_special_matrices_side_by_side(spark):
    """Of one pass over the cells: nothing but the series is sent, and cells are never shuffled."""
    x = np.array([3, 1, 4, 1, 5])
    k = TensorFrame.from_nested(spark, x)
    out = create.beside(spark, eye=create.identity_filling(5), hankel=create.hankel_filling(k), toeplitz=create.toeplitz_filling(k), circulant=create.circulant_filling(k), vander=create.vandermonde_filling(k))
    i, j = np.indices((5, 5))
    want = {"eye": np.eye(5), "hankel": np.where(i + j < 5, x[(i + j) % 5], 0), "toeplitz": x[abs(i - j)], "circulant": x[(i - j) % 5], "vander": np.vander(x, increasing=True)}
    rows = out.collect()
    assert len(rows) == 25 and all(r[name] == a[r["i0"], r["i1"]] for r in rows for name, a in want.items())
    with pytest.raises(ValueError):
        create.beside(spark, a=create.hilbert_filling(4), b=create.identity_filling(5))


@pytest.mark.parametrize("name", ["special_matrices", "structured_matrices"])
def test_cells_of_matrices_are_not_joined(spark, sf_dir, name):
    from tensorloom import queries as core

    plan = core.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    # What is broadcast has a row per supplier, and comes from its table alone.
    assert plan.count("BroadcastExchange") == plan.count("BroadcastHashJoin") and plan.count("Range (") == 1


@pytest.mark.parametrize("shape", [(0, 3), (3, 0), (1, 1), (5, 700), (1030, 5), (1500, 300), (2048, 257)])
def test_cells_are_all_there_once(spark, shape):
    got = create.cells(spark, shape).toPandas()
    at = np.sort((got["i0"] * max(shape[1], 1) + got["i1"]).to_numpy())
    assert np.array_equal(at, np.arange(shape[0] * shape[1])) and (got["i1"] < shape[1]).all()


@pytest.mark.parametrize("name", ["special_matrices", "structured_matrices"])
def test_matrices_take_few_bytes_a_cell(spark, tmp_path, name):
    """The cells are the square of the suppliers' number: written row by row, they took two to four bytes each."""
    import pandas as pd

    from tensorloom import queries as core

    n = 1500
    nations = np.random.default_rng(5).integers(0, 25, n)
    pd.DataFrame({"s_suppkey": np.arange(n), "s_nationkey": nations.astype("int32")}).to_parquet(tmp_path / "supplier.parquet")
    core.QUERIES[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    got = pd.read_parquet(tmp_path / "out")
    assert len(got) == n * n and size < 0.75 * n * n
    i, j = got["i0"].to_numpy(), got["i1"].to_numpy()
    assert len(np.unique(i * n + j)) == n * n
    if name == "special_matrices":
        assert (got["circulant"] == nations[(i - j) % n]).all() and np.allclose(got["hilbert"], 1 / (i + j + 1), rtol=0, atol=5.001e-11)
        assert np.allclose(got["vander"], (nations[i] / 25) ** j, rtol=0, atol=5.001e-9)
    else:
        assert (got["eye"] == (i == j)).all() and (got["toeplitz"] == nations[abs(i - j)]).all()
        assert (got["hankel"] == np.where(i + j < n, nations[(i + j) % n], 0)).all()


def test_round_decimals_is_round(spark):
    """Halves, their neighbours, signs and what is not finite: as Spark rounds by decimals."""
    from pyspark.sql import functions as F

    from tensorloom.functions import elementwise as fx

    rng = np.random.default_rng(4)
    halves = (rng.integers(-10**6, 10**6, 2000) + 0.5) / 1e6
    x = np.concatenate([halves, np.nextafter(halves, 9), np.nextafter(halves, -9), 1 / np.arange(1, 5000), rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), [0.0, -0.0, -1e-9, 1e-320, np.nan, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(2)
    for places in (6, 8, 10):
        bad = df.where(~fx.round_decimals(F.col("x"), places).eqNullSafe(F.round("x", places))).collect()
        assert not bad, bad[:5]

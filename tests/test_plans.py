"""Rank selection and scans along long axes against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from tensorloom.frame import TensorFrame
from tensorloom.plans import scan, select
from tensorloom.plans.select import quantiles

SHARES = [0.0, 0.1, 0.777]


def series_of(kind: str, rng: np.random.Generator, n: int) -> np.ndarray:
    return {
        "normal": lambda: rng.normal(size=n),
        "one value": lambda: np.full(n, 3.5),
        "few values": lambda: rng.integers(0, 3, n).astype(float),
        "wide": lambda: np.exp(rng.normal(scale=90, size=n)) * rng.choice([-1, 1], n),
        "mostly one": lambda: np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)),
        "infinite": lambda: np.where(rng.random(n) < 0.2, -np.inf, rng.normal(size=n)),
        "short": lambda: rng.normal(size=3),
    }[kind]()


KINDS = ["normal", "one value", "wide", "mostly one", "infinite", "short"]


def test_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(select, "FEW", 64)
    rng = np.random.default_rng(5)
    groups = {k: series_of(k, rng, 800) for k in KINDS}
    rows = [(None if k == "normal" else k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("short", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: [r[f"q{k}"] for k in range(len(SHARES))] for r in quantiles(df, ["g"], "x", SHARES).collect()}
    assert set(got) == {None, *KINDS[1:]}
    for k, vs in groups.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(vs, SHARES)
        want = np.where(np.isnan(want), -np.inf, want)  # between two equal infinities
        assert np.allclose(got[None if k == "normal" else k], want, rtol=1e-12), k


def test_a_sketch_that_misses_is_found_out(spark, monkeypatch):
    monkeypatch.setattr(select, "FEW", 5000)
    monkeypatch.setattr(select, "ACCURACY", 10)
    xs = np.random.default_rng(1).permutation(20_000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(7)
    assert quantiles(df, [], "x", [0.333, 0.5]).first()[:] == tuple(np.quantile(xs, [0.333, 0.5]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "g int, x double")
    assert quantiles(df, ["g"], "x", [0.5]).count() == 0
    assert quantiles(df.where("g > 1"), [], "x", [0.5]).collect() == [(None,)]


def test_only_the_bracket_is_left_after_a_pass(spark, monkeypatch):
    left = []
    keep = select.settle
    monkeypatch.setattr(select, "settle", lambda df, name: left.append((name, keep(df, name))) or left[-1][1])
    df = spark.range(200_000).selectExpr("cast(id as double) AS x")
    assert quantiles(df, [], "x", [0.25]).first()[0] == 199_999 * 0.25
    inside = [d.count() for name, d in left if name == "inside"]
    assert inside and inside[0] < 200_000 / 100


def test_percentiles_of_long_axes(spark, monkeypatch):
    monkeypatch.setattr(select, "FEW", 16)
    x = np.random.default_rng(2).normal(size=(100, 3))
    t = TensorFrame.from_arrow(spark, x)
    for axis in (0, None):
        assert np.allclose(t.percentile(30, axis).collect().ravel(), np.percentile(x, 30, axis=axis).ravel())
    assert np.allclose(t.iqr(0).collect().ravel(), np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0))


@pytest.mark.parametrize("chunk", [2, 5, 64])
@pytest.mark.parametrize("shape,axis", [((97,), 0), ((3, 41), 1), ((41, 3), 0)])
def test_scans_equal_numpy(spark, chunk, shape, axis):
    rng = np.random.default_rng(3)
    x = rng.normal(scale=4, size=shape)
    x.flat[[5, 40]] = 0.0
    t = TensorFrame.from_arrow(spark, x)
    assert np.allclose(t.cumsum(axis, chunk).collect(), np.cumsum(x, axis))
    assert np.allclose(t.cumprod(axis, chunk).collect(), np.cumprod(x, axis))
    for n in (1, 2, 3):
        assert np.allclose(t.diff(n, axis, chunk).collect(), np.diff(x, n, axis))
    assert np.allclose(t.unwrap(period=6.0, axis=axis, chunk=chunk).collect(), np.unwrap(x, period=6.0, axis=axis))


def test_high_orders_booleans_and_whole_products(spark):
    x = np.arange(30.0) ** 3
    assert np.allclose(TensorFrame.from_arrow(spark, x).diff(11, chunk=4).collect(), np.diff(x, 11))
    b = np.random.default_rng(4).random(50) < 0.5
    assert (TensorFrame.from_nested(spark, b).diff(2, chunk=7).collect() == np.diff(b, 2)).all()
    v = np.array([3, 7, 11, -13, 17, 19, 23, 29, 31, 37, 41])
    assert TensorFrame.from_nested(spark, v).cumprod(chunk=3).collect().tolist() == np.cumprod(v).tolist()


def test_no_window_spans_the_axis(spark):
    t = TensorFrame.from_arrow(spark, np.arange(50.0))
    for out in (t.cumsum(chunk=4), t.cumprod(chunk=4), t.diff(2, chunk=4), t.unwrap(chunk=4)):
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_c#" in w.split("windowspecdefinition(")[-1] for w in windows)
    assert scan.CHUNK == 1 << 14

"""Convolution of two long series by blocks against the direct sum."""

from __future__ import annotations

import numpy as np
import pytest

from tensorloom import frame
from tensorloom.frame import TensorFrame
from tensorloom.plans import convolve as blocks


def line(spark, v):
    kind = "bigint" if v.dtype.kind == "i" else "double"
    return TensorFrame(spark.createDataFrame([(k, x.item()) for k, x in enumerate(v)], f"i0 bigint, v {kind}"), (len(v),))


def values(t):
    out = {r["i0"]: r["v"] for r in t.df.collect()}
    assert sorted(out) == list(range(t.size))
    return np.array([out[k] for k in range(t.size)])


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_long_kernels(spark, monkeypatch, mode):
    """Uneven blocks on both sides, in all modes."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=1000), rng.normal(size=301)
    df = blocks.convolve(line(spark, a).df, line(spark, b).df, False, block=64, salts=3)
    assert np.allclose(values(TensorFrame(df.where("i0 < 1300"), (1300,))), np.convolve(a, b))
    assert np.allclose(values(line(spark, a).convolve(line(spark, b), mode)), np.convolve(a, b, mode))
    assert np.allclose(values(line(spark, b).convolve(line(spark, a), mode)), np.convolve(a, b, mode))
    monkeypatch.setattr(frame, "SHORT_KERNEL", 10_000)
    assert np.allclose(values(line(spark, a).convolve(line(spark, b), mode)), np.convolve(a, b, mode))


def test_whole_numbers_are_exact(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**27), 2**27, 900), rng.integers(-(2**27), 2**27, 400)
    assert (values(line(spark, a).convolve(line(spark, b))) == np.convolve(a, b)).all()


def test_nan_stays_where_it_is_met(spark):
    a, b = np.ones(900), np.ones(300)
    a[600] = np.nan
    got = values(line(spark, a).convolve(line(spark, b)))
    assert (np.isnan(got) == np.isnan(np.convolve(a, b))).all()


def test_down_and_correlate(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=700), rng.normal(size=290)
    assert np.allclose(values(line(spark, a).convolve(line(spark, b), "full", 7)), np.convolve(a, b)[::7])
    assert np.allclose(values(line(spark, a).correlate(line(spark, b))), np.correlate(a, b, "valid"))


@pytest.mark.parametrize("n,m,strip", [(1000, 301, 4), (700, 699, 64), (5, 3, 64), (2049, 2000, 16)])
def test_transform_of_the_whole(spark, n, m, strip):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=n), rng.normal(size=m)
    df = blocks.transformed(line(spark, a).df, line(spark, b).df, n, m, strip=strip)
    assert np.allclose(values(TensorFrame(df, (n + m - 1,))), np.convolve(a, b))


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_long_series_go_by_the_transform(spark, monkeypatch, mode):
    """Never by pairs of blocks, and without sending copies of blocks to the driver."""
    monkeypatch.setattr(blocks, "PAIRS", 0)
    a, b = np.random.default_rng(5).normal(size=(2, 900))
    a, b = line(spark, a), line(spark, b[:400])
    want = np.convolve(values(a), values(b), mode)
    out = a.convolve(b, mode)
    assert np.allclose(values(out), want)
    assert "Join" not in out.df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_broadcast(spark):
    a = line(spark, np.arange(900))
    plan = a.convolve(a).df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

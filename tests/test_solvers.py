"""Iterative solvers against dense ones."""

from __future__ import annotations

import numpy as np
import pytest

from tensorloom.operators import solvers


def entries(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)], "i long, j long, v double")


def vector(spark, b):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(b) if x], "i long, v double")


def dense(df, n, at="i", v="v"):
    out = np.zeros(n)
    for r in df.collect():
        out[r[at]] = r[v]
    return out


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(5)


def test_conjugate_gradient(spark, rng):
    w = np.triu(rng.integers(1, 4, (12, 12)) * (rng.random((12, 12)) < 0.4), 1).astype(float)
    a = np.diag((w + w.T).sum(axis=1) + 1) - w - w.T
    b = np.where(rng.random(12) < 0.5, 0.0, rng.normal(size=12))
    x, how = solvers.conjugate_gradient(entries(spark, a), vector(spark, b))
    assert np.allclose(dense(x, 12), np.linalg.solve(a, b), atol=1e-8) and how["steps"] <= 13
    zero, how = solvers.conjugate_gradient(entries(spark, a), vector(spark, np.zeros(12)))
    assert how["steps"] == 0 and not dense(zero, 12).any()
    with pytest.raises(ValueError):
        solvers.conjugate_gradient(entries(spark, -a), vector(spark, b))
    with pytest.raises(ValueError):
        solvers.conjugate_gradient(entries(spark, np.array([[1.0, 2.0], [2.0, 1.0]])), vector(spark, [1.0, -1.0]))


def test_least_squares_of_least_norm(spark, rng):
    a = np.round(rng.normal(size=(14, 5)), 2)
    a = np.hstack([a, a[:, :1] + a[:, 1:2]])  # of rank 5
    b = rng.normal(size=14)
    x, how = solvers.least_squares(entries(spark, a), vector(spark, b))
    want = np.linalg.pinv(a) @ b
    assert np.allclose(dense(x, 6, "j"), want, atol=1e-7)
    assert np.isclose(how["residual"], ((b - a @ want) ** 2).sum())


def test_eigenpairs_with_restarts(spark, rng):
    a = rng.normal(size=(16, 16))
    a = a + a.T
    values, vectors = solvers.eigenpairs(entries(spark, a), 2, width=7)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:2], atol=1e-6)
    e = np.array([r["e"] for r in vectors.orderBy("i").collect()])
    assert np.allclose(a @ e, e * values, atol=1e-5) and np.allclose(e.T @ e, np.eye(2), atol=1e-8)
    assert all(c[np.argmax(abs(c))] > 0 for c in e.T)


def test_eigenpairs_of_small_matrices(spark):
    values, vectors = solvers.eigenpairs(entries(spark, np.diag([3.0, 1.0])), 5)
    assert np.allclose(values, [3.0, 1.0]) and vectors.count() == 2
    none, _ = solvers.eigenpairs(entries(spark, np.zeros((2, 2))), 1)
    assert len(none) == 0


def test_long_rows_and_columns_are_cut(spark, monkeypatch):
    """A column that every row has is spread over tasks, and steps give the same."""
    monkeypatch.setattr(solvers, "HEAVY", 10)
    rng = np.random.default_rng(12)
    a = np.column_stack([np.ones(60), rng.normal(size=(60, 2)) * (rng.random((60, 2)) < 0.3)])
    b = rng.normal(size=60)
    found, _ = solvers.least_squares(entries(spark, a), vector(spark, b))
    got = {r["j"]: r["v"] for r in found.collect()}
    assert np.allclose([got[j] for j in range(3)], np.linalg.lstsq(a, b, rcond=None)[0])
    with solvers._dealt(entries(spark, a), "j") as m:
        assert m.entries.groupBy("j", "_s").count().agg({"count": "max"}).first()[0] < 30
        assert m.entries.where("j = 0").select("_s").distinct().count() == 6
    s = a.T @ a + np.eye(3)
    x, _ = solvers.conjugate_gradient(entries(spark, s), vector(spark, b[:3]))
    assert np.allclose([r["v"] for r in x.orderBy("i").collect()], np.linalg.solve(s, b[:3]))


def test_entries_are_sorted_once(spark):
    """A step merges the kept entries as they lie: only the vector is sorted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = np.eye(50) + np.eye(50, k=1)
        with solvers._dealt(entries(spark, a), "j") as m:
            m.entries.count()
            out = solvers._times(m, vector(spark, np.ones(50)), "v", "q")
            plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
            assert "SortMergeJoin" in plan and plan.split("SortMergeJoin")[1].count("Sort [") == 0
            assert out.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

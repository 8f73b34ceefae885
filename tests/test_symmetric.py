"""Packed blocks of symmetric matrices against dense ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tensorloom import queries as core
from tensorloom.operators import solvers
from tensorloom.plans import symmetric
from tests.compare import database, differences
from tests.test_solvers import dense, entries, vector


@pytest.fixture
def matrix():
    rng = np.random.default_rng(3)
    a = rng.integers(-3, 4, (30, 30)) * (rng.random((30, 30)) < 0.3) + np.eye(30)
    return a + a.T


@pytest.fixture
def small(monkeypatch):
    """Several chunks, shares of blocks and pieces of shares."""
    monkeypatch.setattr(symmetric, "CHUNK", (30, 30))
    monkeypatch.setattr(symmetric, "PIECE", 5)
    monkeypatch.setattr(symmetric, "FEW", 4)
    monkeypatch.setattr(symmetric, "BATCH", 3)


def test_products_diagonal_and_indices(spark, matrix, small):
    x = np.arange(30) - 7.5
    twice = entries(spark, matrix).union(entries(spark, matrix))  # cells add up
    with symmetric.blocks(twice) as m:
        assert m.chunks > 1 and m.shares > 1
        assert m.pieces.groupBy("b").count().agg({"count": "max"}).first()[0] > 1
        y = symmetric.times(m, vector(spark, x), F.col("v") + 1, "y")
        assert np.allclose(dense(y, 30, v="y"), 2 * matrix @ (x + 1)) and y.count() == 30
        assert np.allclose(dense(symmetric.diagonal(m), 30, v="d"), 2 * matrix.diagonal())
        assert sorted(r["i"] for r in symmetric.indices(m).collect()) == list(range(30))


def test_a_vector_that_lacks_an_index_is_refused(spark, matrix):
    with symmetric.blocks(entries(spark, matrix)) as m, pytest.raises(Exception, match="lacks indices"):
        symmetric.times(m, vector(spark, np.r_[0.0, np.ones(29)]), F.col("v"), "y").collect()


def test_solvers_in_several_chunks(spark, matrix, small):
    a = matrix + 200 * np.eye(30)
    b = np.arange(30.0)
    x, _ = solvers.conjugate_gradient(entries(spark, a), vector(spark, b), tolerance=1e-7)
    assert np.allclose(dense(x, 30), np.linalg.solve(a, b), atol=1e-6)
    scale, a = np.linspace(0.5, 1.5, 30), matrix + np.diag([400.0, *[0.0] * 28, 100.0])
    values, vectors = solvers.eigenpairs(entries(spark, a), 2, scale=vector(spark, scale), tolerance=1e-6)
    want, found = scale[:, None] * a * scale, np.array([r["e"] for r in vectors.orderBy("i").collect()])
    assert np.allclose(values, np.linalg.eigvalsh(want)[::-1][:2], atol=1e-3)
    assert np.allclose(want @ found, found * values, atol=1e-2)


def _shuffled(spark) -> int:
    """Rows written to shuffles by the session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_entries_are_shuffled_once(spark):
    """All steps of a solution shuffle fewer rows than the matrix has entries."""
    rng = np.random.default_rng(8)
    w = np.triu(rng.random((150, 150)), 1)
    a = np.diag((w + w.T).sum(axis=1) * 4) - w - w.T
    given, b = entries(spark, a).persist(), vector(spark, rng.normal(size=150))
    assert given.count() == 150 * 150
    before = _shuffled(spark)
    x, how = solvers.conjugate_gradient(given, b, tolerance=1e-4)
    assert 0 < _shuffled(spark) - before < 150 * 150 and how["steps"] > 2
    assert np.allclose(dense(x, 150), np.linalg.solve(a, b.toPandas().v), atol=1e-3)


def test_the_first_vector_decides_among_equal_values(spark):
    values, vectors = solvers.eigenpairs(entries(spark, np.diag([2.0, 2.0, 1.0])), 1, start=vector(spark, [3.0, 4.0, 5.0]))
    assert np.allclose(values, [2.0]) and np.allclose([r["e"][0] for r in vectors.orderBy("i").collect()], [0.6, 0.8, 0.0], atol=1e-6)


def _lineitem(sf_dir, tmp_path, copies):
    """The line items, and copies of them with keys of their own."""
    x = pd.read_parquet(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_suppkey", "l_partkey", "l_quantity"])
    moved = [x.assign(l_suppkey=x.l_suppkey + k * (x.l_suppkey.max() + 1), l_partkey=x.l_partkey + k * (x.l_partkey.max() + 1)) for k in range(copies)]
    pd.concat(moved).to_parquet(tmp_path / "lineitem.parquet")
    return str(tmp_path)


def test_leading_pair_of_groups_apart(spark, sf_dir, tmp_path):
    """Suppliers and parts in groups without a link between them: the pair is that of all degrees."""
    d = _lineitem(sf_dir, tmp_path, 3)
    want = database(d).execute(core.ORACLE["graph_eigen_lineitem"]).df()
    assert not differences(core.QUERIES["graph_eigen_lineitem"](spark, d).toPandas(), want)

"""Contraction in tiles against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from tensorloom.frame import TensorFrame
from tensorloom.plans import blocks


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 1)
    monkeypatch.setattr(blocks, "SIDE", 4)
    monkeypatch.setattr(blocks, "GROUP", 2)


def by_tiles(frame: TensorFrame) -> bool:
    return "FlatMapCoGroupsInArrow" in frame.df._jdf.queryExecution().toString()


SPECS = [("ij,jk->ik", (9, 17), (17, 6)), ("ij,kj->ik", (3, 5), (21, 5)), ("ki,kj->ij", (30, 2), (30, 11)), ("bij,bjk->bik", (3, 5, 7), (3, 7, 4)), ("ijk,kjl->il", (5, 3, 4), (4, 3, 6)), ("ij,jk->ki", (8, 8), (8, 8)), ("iaj,jbk->iakb", (3, 2, 9), (9, 2, 3))]


@pytest.mark.parametrize("spec,p,q", SPECS)
def test_tiles_equal_numpy(spark, small, spec, p, q):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=p), rng.normal(size=q)
    got = TensorFrame.einsum(spec, TensorFrame.from_arrow(spark, x), TensorFrame.from_arrow(spark, y))
    assert by_tiles(got) and got.df.count() == got.size
    assert np.allclose(got.collect(), np.einsum(spec, x, y))


@pytest.mark.parametrize("share,tiled", [(0.5, True), (0.02, False)])
def test_sparse_operands(spark, small, share, tiled):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((13, 22)) < share, rng.normal(size=(13, 22)), 0)
    y = rng.normal(size=(22, 7))
    a = TensorFrame.from_arrow(spark, x)
    a = TensorFrame(a.df.where("v <> 0"), x.shape, sparse=True)
    got = TensorFrame.einsum("ij,jk->ik", a, TensorFrame.from_arrow(spark, y))
    assert by_tiles(got) == tiled
    assert np.allclose(got.collect(), x @ y)


def test_empty_tiles_and_integers(spark, small):
    x, y = np.zeros((6, 40)), np.ones((40, 6))
    x[5, 39] = 2
    a = TensorFrame.from_arrow(spark, x)
    got = TensorFrame.einsum("ij,jk->ik", TensorFrame(a.df.where("i1 > 35"), x.shape, sparse=True), TensorFrame.from_arrow(spark, y))
    assert np.allclose(got.collect(), x @ y)
    whole = TensorFrame.from_nested(spark, np.full((3, 5), 2**20))
    exact = TensorFrame.einsum("ij,kj->ik", whole, whole.map(lambda v: v + 1))
    assert not by_tiles(exact) and dict(exact.df.dtypes)["v"] == "bigint"


def test_shuffled_rows_stay_few(spark):
    """A product of 300 x 300 x 300 passes tiles, not 27 million products."""
    x = np.random.default_rng(3).normal(size=(300, 300))
    a = TensorFrame.from_arrow(spark, x)
    got = a @ a
    assert by_tiles(got)
    s = blocks.split(("i", "j"), ("j", "k"), {"i", "k"}, {"i": 300, "j": 300, "k": 300})
    left, n, k = blocks.tiles(a.df.withColumnsRenamed({"i0": "x_i", "i1": "x_j"}), s, s.left, s.summed, blocks.SIDE)
    assert (n, k, left.count()) == (150, 150, 4)
    assert np.allclose(got.collect(), x @ x)

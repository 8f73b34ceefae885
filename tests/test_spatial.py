"""The kd-split against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tensorloom.operators import spatial
from tensorloom.operators.spatial import build_index, nearest, split, within


def brute(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qs: np.ndarray, k: int, p: float) -> dict:
    d = spatial.norm(q[:, None, :] - x[None, :, :], p)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, row)) if ids[j] != i][:k] for i, row in zip(qs, d)}


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, x array<double>").repartition(3)


@pytest.mark.parametrize("kind,p", [("even", 2.0), ("ties", 1.0), ("one point", 2.0), ("clusters", 3.0)])
def test_nearest_equals_brute_force(spark, monkeypatch, kind, p):
    monkeypatch.setattr(spatial, "PART", 50)
    rng = np.random.default_rng(6)
    x = {
        "even": lambda: rng.random((400, 3)),
        "ties": lambda: rng.integers(0, 6, (400, 2)).astype(float),
        "one point": lambda: np.where(rng.random((300, 1)) < 0.6, 1.0, rng.random((300, 2))),
        "clusters": lambda: rng.integers(0, 4, (400, 1)) * 10 + rng.normal(size=(400, 2)),
    }[kind]()
    ids = rng.permutation(len(x)) * 3
    points = frame(spark, ids, x)
    index = build_index(points, "id", "x", leaf=20)
    got: dict = {}
    for r in nearest(index, points, "id", "x", 4, p, exclude_self=True).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == brute(x, ids, x, ids, 4, p)


def test_few_points_outside_queries_and_balls(spark):
    rng = np.random.default_rng(8)
    x, q = rng.random((300, 2)), rng.random((40, 2)) * 3 - 1
    ids, qs = np.arange(300), np.arange(1000, 1040)
    index = build_index(frame(spark, ids, x), "id", "x", leaf=16)
    got = {(r["q"], r["id"]) for r in within(index, frame(spark, qs, q), "id", "x", 0.2).collect()}
    d = spatial.norm(q[:, None, :] - x[None, :, :], 2)
    assert got == {(1000 + int(i), int(j)) for i, j in zip(*np.nonzero(d < 0.2))}
    few = build_index(frame(spark, ids[:3], x[:3]), "id", "x", leaf=1)
    assert nearest(few, frame(spark, qs, q), "id", "x", 5).count() == 40 * 3


def test_cells_prune(spark, monkeypatch):
    """All points against all points look at a small share of the pairs."""
    sent = []
    keep = spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df, name: sent.append((name, keep(df, name))) or sent[-1][1])
    x = np.random.default_rng(9).random((2000, 2))
    points = frame(spark, np.arange(2000), x)
    index = build_index(points, "id", "x", leaf=20)
    assert nearest(index, points, "id", "x", 3, exclude_self=True).count() == 6000
    further = next(df for name, df in sent if name == "sent").count()
    candidates = (2000 + further) * 2000 / index.splits.cells
    assert index.splits.cells >= 64 and candidates < 2000 * 2000 / 20


def test_splits_cover_the_space():
    x = np.random.default_rng(1).normal(size=(500, 3))
    s = split(x, 32)
    counts = np.bincount(s.locate(x), minlength=s.cells)
    assert s.cells == 32 and counts.min() >= 8 and counts.max() <= 24
    assert set(s.locate(x * 100)) <= set(range(32))
    assert split(np.ones((50, 2)), 8).cells == 1 and split(np.empty((0, 2)), 8).locate(x[:, :2]).tolist() == [0] * 500


def test_empty(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    assert nearest(build_index(none, "id", "x"), none, "id", "x", 2).count() == 0


def test_boxes_are_found_along_the_splits(monkeypatch):
    """The boxes that are looked at grow with those reached, not with all; the cells are those of a plain search."""
    rng = np.random.default_rng(3)
    x = rng.random((20_000, 2))
    s = split(x, 1024)
    cell = s.locate(x)
    low, high = np.full((s.cells, 2), np.inf), np.full((s.cells, 2), -np.inf)
    np.minimum.at(low, cell, x)
    np.maximum.at(high, cell, x)
    low[5], high[5] = np.inf, -np.inf  # a cell without points
    q, r = rng.random((300, 2)), rng.random(300) * 0.02
    seen, plain = [], spatial.norm
    monkeypatch.setattr(spatial, "norm", lambda gaps, p: seen.append(len(gaps)) or plain(gaps, p))
    at, cells = spatial.KdIndex(s, low, high, None).reached(q, r, 2.0)
    gaps = plain(np.maximum(np.maximum(low - q[:, None, :], q[:, None, :] - high), 0), 2.0)
    assert set(zip(at.tolist(), cells.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(gaps <= r[:, None]))))
    assert sum(seen) < 300 * 60


@pytest.mark.parametrize("kind", ["even", "one point", "apart"])
def test_within_sends_a_query_to_few_cells(spark, monkeypatch, kind):
    """Cells much narrower than the radius are met as one: what is sent grows with the queries alone."""
    monkeypatch.setattr(spatial, "PART", 100)
    monkeypatch.setattr(spatial, "CROWD", 50_000)
    sent = []
    keep = spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df, name: sent.append((name, keep(df, name))) or sent[-1][1])
    rng = np.random.default_rng(12)
    x = np.stack([rng.random(3000) * 10, rng.integers(0, 3, 3000) * 5.0], axis=1)
    if kind == "one point":
        x[:1500] = 2.5
    if kind == "apart":
        x[:, 1] += rng.random(3000) * 4
    ids = rng.permutation(3000) * 7
    points = frame(spark, ids, x)
    index = build_index(points, "id", "x", leaf=4)
    assert index.splits.cells > 300 and index.counts.sum() == 3000
    found = within(index, points, "id", "x", 1.0, exclude_self=True).toPandas()
    d = spatial.norm(x[:, None, :] - x[None, :, :], 2)
    i, j = np.nonzero((d < 1) & (ids[:, None] != ids[None, :]))
    want = dict(zip(zip(ids[i].tolist(), ids[j].tolist()), d[i, j].tolist()))
    assert len(found) == len(want) and all(want[q, k] == v for q, k, v in zip(found["q"], found["id"], found["d"]))
    assert next(df for name, df in sent if name == "sent").count() < 3000 * (20 if kind == "apart" else 6)


def test_coarser_cells_hold_the_same_points(spark):
    rng = np.random.default_rng(13)
    x = rng.random((500, 2))
    index = build_index(frame(spark, np.arange(500), x), "id", "x", leaf=4)
    wide = index.coarser(0.3)
    cell = wide.splits.locate(x)
    assert 4 <= wide.splits.cells < index.splits.cells and np.array_equal(np.bincount(cell, minlength=wide.splits.cells), wide.counts)
    assert (wide.low[cell] <= x).all() and (x <= wide.high[cell]).all() and (wide.high - wide.low).max() <= 0.3
    rows = wide.packed.collect()
    assert all((cell[np.frombuffer(r["ids"], np.int64)] == r["cell"]).all() for r in rows) and sum(len(r["ids"]) for r in rows) == 8 * 500
    assert index.coarser(0.0) is index or index.coarser(0.0).splits.cells <= index.splits.cells
    assert index.coarser(9.0).splits.cells == 1

"""Density clusters against all pairs, and their work in one crowded place."""

from __future__ import annotations

import numpy as np
import pytest

from tensorloom.operators import density


def frame(spark, pts):
    dims = ["x", "y", "z"][: pts.shape[1]]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, " + ", ".join(f"{c} double" for c in dims)), dims


def plain(pts, eps, least, order):
    """Labels from the full distance matrix."""
    gaps = np.abs(pts[:, None] - pts[None])
    near = (gaps**order).sum(axis=2) ** (1 / order) < eps
    core = near.sum(axis=1) >= least
    root = {i: i for i in np.flatnonzero(core)}
    moved = True
    while moved:
        moved = False
        for i in root:
            low = min(root[j] for j in np.flatnonzero(near[i] & core))
            moved |= low != root[i]
            root[i] = low
    out = {}
    for i in range(len(pts)):
        others = [root[j] for j in np.flatnonzero(near[i] & core)]
        out[i] = (bool(core[i]), root[i] if core[i] else min(others, default=None))
    return out


@pytest.mark.parametrize(("seed", "rank", "metric"), [(0, 2, "euclidean"), (1, 2, "manhattan"), (2, 3, "euclidean"), (3, 1, "euclidean")])
def test_labels_equal_all_pairs(spark, monkeypatch, seed, rank, metric):
    monkeypatch.setattr(density, "FEW_PAIRS", 6)  # boxes are halved even where few points lie
    rng = np.random.default_rng(seed)
    crowds = [rng.normal(m, 0.25, (45, rank)) for m in (0.0, 1.1, 4.0)]
    pts = np.vstack([*crowds, rng.uniform(-2, 6, (40, rank)), np.repeat([[4.0] * rank], 12, axis=0)])
    df, dims = frame(spark, pts)
    got = {r["id"]: (r["core"], r["root"]) for r in density.dbscan(df, dims, "id", 0.5, 5, metric).collect()}
    assert got == plain(pts, 0.5, 5, 1 if metric == "manhattan" else 2)


def test_points_exactly_eps_apart_do_not_touch(spark):
    pts = np.vstack([np.repeat([[0.0, 0.0]], 60, axis=0), np.repeat([[1.0, 0.0]], 60, axis=0), np.repeat([[1.99, 0.0]], 60, axis=0)])
    df, dims = frame(spark, pts)
    roots = {r["id"]: r["root"] for r in density.dbscan(df, dims, "id", 1.0, 4).collect()}
    assert roots[0] == 0 and roots[70] == roots[130] == 60


def test_missing_coordinates_are_noise(spark):
    rows = [(i, 0.0, 0.0) for i in range(5)] + [(5, None, 0.0), (6, float("nan"), 0.0), (7, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: (r["core"], r["root"]) for r in density.dbscan(df, ["x", "y"], "id", 1.0, 3).collect()}
    assert got == {**{i: (True, 0) for i in range(5)}, **{i: (False, None) for i in (5, 6, 7)}}
    assert density.dbscan(df.where("id < 0"), ["x", "y"], "id", 1.0, 3).count() == 0


def test_a_hundred_thousand_points_in_two_cells(spark):
    """All pairs would be 2.5 billion for each cell."""
    df = spark.range(100_000).selectExpr("id", "(id % 997) / 997.0 * 0.3 + IF(id < 50000, 0, 0.6) AS x", "(id % 1009) / 1009.0 * 0.3 AS y")
    out = density.dbscan(df, ["x", "y"], "id", 0.5, 10)
    assert [tuple(r) for r in out.groupBy("core", "root").count().collect()] == [(True, 0, 100_000)]

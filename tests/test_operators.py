from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import elementwise as fx
from tensorloom.operators import arrays, linalg, neighbors, stats, wide


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_guards(spark):
    lit = lambda x: F.lit(float(x))
    assert one(spark, fx.ln(lit(0))) == -math.inf and math.isnan(one(spark, fx.ln(lit(-1))))
    assert math.isnan(one(spark, fx.floor(lit("nan")))) and one(spark, fx.trunc(lit(-2.5))) == -2
    assert one(spark, fx.divide(lit(-1), lit(0))) == -math.inf and math.isnan(one(spark, fx.divide(lit(0), lit(0))))
    assert one(spark, fx.floor_mod(F.lit(7), F.lit(-3))) == -2
    assert one(spark, fx.compare("==", lit("nan"), lit("nan"))) is False
    assert one(spark, fx.round_half_away(lit(-2.5))) == -3
    assert one(spark, fx.int_divide(F.lit(-7), F.lit(2))) == -3
    assert [one(spark, fx.classify(lit(x))) for x in ("nan", "inf", "-inf", "-0.0", "0", "5e-324", "1")] == ["nan", "inf", "neginf", "negzero", "zero", "subnormal", "normal"]
    assert one(spark, fx.erf(lit(0.5))) == math.erf(0.5)
    assert math.copysign(1, one(spark, fx.copysign(lit(3), lit(-2)))) == -1


@pytest.fixture(scope="module")
def matrix(spark):
    a = np.random.default_rng(1).normal(size=(300, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 1
    return a, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(a)], "id long, x array<double>").repartition(5)


def test_linear_algebra(matrix):
    a, df = matrix
    q, r = linalg.tsqr(df, "id", "x", 6)
    rows = np.array([x["q"] for x in q.orderBy("id").collect()])
    assert np.allclose(rows @ r, a) and np.allclose(rows.T @ rows, np.eye(6)) and np.allclose(r, np.triu(r))
    u, s, vt = linalg.svd(df, "id", "x", 6)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False))
    assert np.allclose(np.array([x["u"] for x in u.orderBy("id").collect()]) * s @ vt, a)
    _, top, _ = linalg.svd_randomized(df, "id", "x", 6, 2, oversample=1)
    assert np.allclose(top, s[:2], rtol=1e-2)
    p = linalg.pca(df, "id", "x", 6, 2)
    assert np.allclose(p.explained_variance, np.linalg.eigvalsh(np.cov(a.T))[::-1][:2])
    low, up = linalg.lu_permuted(a[:6])
    assert np.allclose(low @ up, a[:6])
    assert np.allclose(linalg.pinv(a), np.linalg.pinv(a))


def test_least_squares(spark, matrix):
    a, _ = matrix
    y = a @ np.arange(6) + 0.1
    df = spark.createDataFrame([(row.tolist(), float(t)) for row, t in zip(a, y, strict=True)], "x array<double>, y double")
    got, want = linalg.least_squares(df, "x", "y", 6), np.linalg.lstsq(a, y, rcond=None)
    assert np.allclose(got["solution"], want[0]) and np.isclose(got["residual"], want[1][0]) and got["rank"] == want[2]
    two, want = linalg.least_squares(df.withColumn("z", F.col("y") ** 2), "x", ["y", "z"], 6), np.linalg.lstsq(a, np.stack([y, y**2], axis=1), rcond=None)
    assert np.allclose(two["solution"], want[0]) and np.allclose(two["residual"], want[1])


def test_wide_covariance(spark):
    a = np.random.default_rng(2).normal(size=(50, 12)) + 1e4
    names = [f"f{k}" for k in range(12)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in a], ", ".join(f"{n} double" for n in names))
    got = {(r["a"], r["b"]): r["cov"] for r in wide.covariance(df, names).collect()}
    assert np.allclose([[got[x, y] for y in names] for x in names], np.cov(a.T))


def test_radius_join_and_dbscan(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 0.2, (40, 3)), rng.normal(3, 0.2, (40, 3)), [[10, 10, 10]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")
    for metric, f in (("euclidean", lambda u: np.sqrt((u**2).sum())), ("manhattan", lambda u: np.abs(u).sum())):
        got = {(r["a_id"], r["b_id"]) for r in neighbors.radius_join(df, df, ["x", "y", "z"], "id", 0.5, metric).collect()}
        assert got == {(i, j) for i in range(81) for j in range(81) if f(pts[i] - pts[j]) < 0.5}
    out = {r["id"]: r for r in neighbors.dbscan(df, ["x", "y", "z"], "id", 0.9, 5).collect()}
    assert out[80]["root"] is None and len({out[i]["root"] for i in range(80)}) == 2


def test_kmeans(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(m, 0.1, (30, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    centers, inertia, labelled = neighbors.kmeans(df, "id", "v", 3, n_init=2)
    assert sorted(round(c[0]) for c in centers) == [0, 5, 10] and inertia < 5
    assert labelled.select("label").distinct().count() == 3


def test_knn_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 3)))], "id long, v array<double>")
    q = df.where("id % 2 = 0")
    rows = [sorted(map(tuple, neighbors.knn(df, q, "id", "v", 4, exclude_self=True, block=b).collect())) for b in (7, 1000)]
    assert rows[0] == rows[1] and len(rows[0]) == 160


def test_kmeans_keeps_points_of_no_cluster_apart(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id long, v array<double>")
    centers, inertia, _ = neighbors.kmeans(df, "id", "v", 3, n_init=2)
    assert centers == [[1.0, 1.0]] and inertia == 0.0
    assert neighbors.kmeans(df.where("id < 0"), "id", "v", 3)[2].count() == 0


def test_kde_reaches_all_kernels(spark):
    xs = [0.0, 3.0, 7.0, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    at = spark.createDataFrame([(float(x),) for x in range(-2, 13)], "x double")
    for k in fx.KERNELS:
        got = {r["x"]: r["density"] for r in stats.kde(df, "v", at, kernel=k, bandwidth=1.5).collect()}
        f = {"box": lambda u: 1.0, "triangular": lambda u: 1 - abs(u), "trigonometric": lambda u: 1 + math.cos(2 * math.pi * u), "epanechnikov": lambda u: 0.75 * (1 - u * u), "gauss": lambda u: math.exp(-u * u / 2) / math.sqrt(2 * math.pi)}[k]
        reach = {"gauss": 4.5, "box": 0.75, "trigonometric": 0.75}.get(k, 1.5)
        for x, y in got.items():
            assert math.isclose(y, sum(f((x - v) / 1.5) for v in xs if abs(x - v) <= reach) / 6, abs_tol=1e-12)


def test_tokens_and_losses(spark):
    assert one(spark, arrays.tokenize(F.lit("  hello\n world "))) == ["hello", "world"]
    x = F.array(F.lit(1.0), F.lit(1000.0))
    assert one(spark, arrays.softmax_cross_entropy(x, F.lit(1))) == 0.0
    assert one(spark, arrays.logsumexp(x)) == 1000.0


def test_blocks_of_queries_meet_blocks_of_points(spark, monkeypatch):
    """Neighbours and distances over several blocks each way; ties by id, no pair ranked or sent that a block rules out."""
    monkeypatch.setattr(neighbors, "MET", 30)
    monkeypatch.setattr(neighbors, "LISTED", (7, 30))
    x = np.random.default_rng(7).integers(0, 4, (120, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[::5, None, :] - x[None, :, :]) ** 2).sum(-1))
    got = neighbors.knn(df, df.where("id % 5 = 0"), "id", "v", 4, exclude_self=True, block=9)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    want = {(5 * q, int(i), k + 1) for q, row in enumerate(d) for k, i in enumerate([i for i in np.lexsort((np.arange(120), row)) if i != 5 * q][:4])}
    assert {(r["q"], r["id"], r["rank"]) for r in got.collect()} == want
    every = neighbors.distance_matrix(df.where("id % 5 = 0"), df, "id", "v").collect()
    assert len(every) == 24 * 120 and all(abs(r["d"] - d[r["i"] // 5, r["j"]]) < 1e-12 for r in every)


def test_radius_join_of_a_crowded_cell(spark, monkeypatch):
    """All points in a few cells: each cell is met in parts, and by more than one task."""
    monkeypatch.setattr(neighbors, "PAIRS", 2000)
    x = np.random.default_rng(11).random((400, 2)) * 1.5
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    out = neighbors.radius_join(df, df, ["x", "y"], "id", 0.9)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    found = out.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["a_id"], r["b_id"]) for r in found} == set(zip(*(v.tolist() for v in np.nonzero(d < 0.9)))) and len(found) == (d < 0.9).sum()
    per_task = np.bincount([r["task"] for r in found])
    assert per_task.max() < len(found) / 4


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_distance_matrix_deals_every_row_once(spark, monkeypatch, kind):
    """Blocks hold each row once, whatever number of blocks it meets; missing vectors are far from all."""
    monkeypatch.setattr(neighbors, "LISTED", (8, 64))
    monkeypatch.setattr(neighbors, "LISTING", 16)
    monkeypatch.setattr(neighbors, "MEETINGS", 2)
    monkeypatch.setattr(neighbors, "AT_ONCE", 80)
    kept, keep = [], neighbors.settle
    monkeypatch.setattr(neighbors, "settle", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    x = np.random.default_rng(14).normal(size=(150, 3)).astype("float32" if kind == "array<float>" else "float64")
    rows = [(f"v{i}", None if i in (4, 77) else [float(v) for v in x[i]]) for i in range(150)]
    df = spark.createDataFrame(rows, f"id string, v {kind}").repartition(3)
    got = neighbors.distance_matrix(df.where("substring(id, 2, 9) % 2 = 0"), df, "id", "v").collect()
    blocks = [[r["ids"] for r in k.collect()] for k in kept]
    assert [sorted(i for b in bs for i in b) for bs in blocks] == [sorted(f"v{i}" for i in range(0, 150, 2)), sorted(f"v{i}" for i in range(150))]
    assert len(blocks[0]) == 10 and len(blocks[1]) > 2 and all(len(b) <= 64 for b in blocks[1])
    want = np.sqrt(((x[::2, None, :].astype(float) - x[None, :, :].astype(float)) ** 2).sum(-1))
    want[[2], :] = want[:, [4, 77]] = np.nan
    assert len(got) == len({(r["i"], r["j"]) for r in got}) == 75 * 150
    assert np.allclose([r["d"] for r in got], [want[int(r["i"][1:]) // 2, int(r["j"][1:])] for r in got], rtol=0, atol=1e-12, equal_nan=True)


def test_distances_of_copies_take_few_bytes(spark, tmp_path):
    """Equal vectors lie together, so their distances do."""
    x = np.random.default_rng(15).normal(size=(40, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i % 40]]) for i in range(4000)], "id long, v array<double>")
    neighbors.distance_matrix(df.where("id % 50 = 0"), df, "id", "v").write.parquet(str(tmp_path / "out"))
    got = pd.read_parquet(tmp_path / "out")
    assert len(got) == 80 * 4000 and sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.6 * len(got)
    assert np.allclose(got["d"], np.sqrt(((x[got["i"] % 40] - x[got["j"] % 40]) ** 2).sum(1)), rtol=0, atol=1e-12)


def test_distance_matrix_of_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert neighbors.distance_matrix(df.where("id > 1"), df, "id", "v").count() == 0
    assert neighbors.distance_matrix(df, df.where("id > 1"), "id", "v").count() == 0

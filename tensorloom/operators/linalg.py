"""Linear algebra on tall matrices: one pass over the rows, then NumPy on k x k.

Matrices are (id, array) rows.  The number of columns must fit a driver-side
k x k problem; the number of rows is not limited.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.wide import gram
from tensorloom.plans.tables import settle

MAX_COLUMNS = 4000


def _check(k: int) -> None:
    if k > MAX_COLUMNS:
        raise ValueError(f"{k} columns do not fit a driver-side problem of {MAX_COLUMNS}")


def times(x: Column, m: np.ndarray) -> Column:
    """Row vectors times a driver-side matrix, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(s.to_list()) @ m) if len(s) else [], dtype=object)

    return run(x.cast("array<double>"))


def symeig(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and their vectors of a symmetric matrix on the driver."""
    return np.linalg.eigh(a)


def lu_permuted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PL, U) with partial pivoting; PL @ U is ``a``."""
    m, n = a.shape
    _check(max(m, n))
    u, k = a.astype(float).copy(), min(m, n)
    low, perm = np.zeros((m, k)), np.arange(m)
    for j in range(k):
        p = j + int(np.argmax(np.abs(u[j:, j])))
        u[[j, p]], low[[j, p]], perm[[j, p]] = u[[p, j]], low[[p, j]], perm[[p, j]]
        low[j, j] = 1.0
        if u[j, j]:
            f = u[j + 1 :, j] / u[j, j]
            low[j + 1 :, j] = f
            u[j + 1 :] -= np.outer(f, u[j])
    out = np.zeros((m, k))
    out[perm] = low
    return out, np.triu(u[:k])


def pinv(a: np.ndarray, rcond: float = 1e-15) -> np.ndarray:
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    cut = s > rcond * (s[0] if len(s) else 0.0)
    return (vt[cut].T / s[cut]) @ u[:, cut].conj().T


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, b)


def tsqr(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Reduced QR of a tall matrix: (rows of Q, R).  Each task reduces its rows to k x k."""
    _check(k)

    def part(it):
        r = np.zeros((0, k))
        for pdf in it:
            if len(pdf):
                r = np.linalg.qr(np.vstack([r, np.stack(pdf[vec_col].to_list())]), mode="r")
        if len(r):
            yield pd.DataFrame({"row": r.tolist()})

    x = df.select(F.col(vec_col).cast("array<double>").alias(vec_col))
    # Sixteen to one until a few are left: no task or driver ever holds more.
    parts = x.mapInPandas(part, "row array<double>")
    n = x.rdd.getNumPartitions()
    while n > 16:
        n = -(-n // 16)
        parts = parts.coalesce(n).withColumnRenamed("row", vec_col).mapInPandas(part, "row array<double>")
    rows = parts.collect()
    r = np.linalg.qr(np.array([x["row"] for x in rows]), mode="r")
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    r = r * sign[:, None]
    q = df.select(id_col, times(F.col(vec_col), pinv(r)).alias("q"))
    return q, r


def least_squares(df: DataFrame, vec_col: str, y_col: str | Sequence[str], k: int, rcond: float | None = None) -> dict:
    """Minimum-norm solution with residual sum, rank and singular values, from one QR pass over (X | y).

    Several right-hand sides give a column of the solution and a residual each.
    """
    names = [y_col] if isinstance(y_col, str) else list(y_col)
    both = df.select(F.lit(0).alias("_id"), F.concat(F.col(vec_col).cast("array<double>"), F.array(*[F.col(y).cast("double") for y in names])).alias("_xy"))
    n = df.count()
    _, r = tsqr(both, "_id", "_xy", k + len(names))
    full = np.zeros((k + len(names), k + len(names)))
    full[: len(r)] = r
    a, b = full[:k, :k], full[:k, k:]
    u, s, vt = np.linalg.svd(a)
    cut = s > (np.finfo(float).eps * max(n, k) if rcond is None or rcond < 0 else rcond) * s[0]
    x = vt[cut].T @ ((u[:, cut].T @ b) / s[cut][:, None])
    resid = (full[k:, k:] ** 2).sum(axis=0) + ((b - a @ x) ** 2).sum(axis=0)
    if isinstance(y_col, str):
        x, resid = x[:, 0], float(resid[0])
    return {"solution": x, "residual": resid, "rank": int(cut.sum()), "singular_values": s}


def svd(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Reduced SVD of a tall matrix: (rows of U, singular values, Vᵀ)."""
    _, r = tsqr(df, id_col, vec_col, k)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    inv = np.where(s > s[0] * 1e-15, 1 / np.where(s > 0, s, 1), 0.0)
    return df.select(id_col, times(F.col(vec_col), vt.T * inv).alias("u")), s, vt


def svd_randomized(df: DataFrame, id_col: str, vec_col: str, width: int, k: int, oversample: int = 5, power: int = 2, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Leading k singular triplets by a random sketch with power iterations: (rows of U, S, Vᵀ)."""
    rows, size = df.count(), k + oversample
    if 1.25 * size >= min(rows, width):
        u, s, vt = svd(df, id_col, vec_col, width)
        return u.select(id_col, F.slice("u", 1, k).alias("u")), s[:k], vt[:k]
    omega = np.random.default_rng(seed).standard_normal((width, size))
    x = settle(df.select(id_col, F.col(vec_col).cast("array<double>").alias("x")), "x")

    def back(m: np.ndarray) -> np.ndarray:
        """XᵀX m: each task returns width x size sums."""

        def part(it):
            acc = np.zeros((width, size))
            for pdf in it:
                if len(pdf):
                    b = np.stack(pdf["x"].to_list())
                    acc += b.T @ (b @ m)
            yield pd.DataFrame({"i": range(width), "row": acc.tolist()})

        got = x.mapInPandas(part, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((width, size))
        out[got["i"], got["j"]] = got["v"]
        return out

    for _ in range(power):
        omega, _ = np.linalg.qr(back(omega))
    y = x.select(id_col, "x", times(F.col("x"), omega).alias("y"))
    _, r = tsqr(y, id_col, "y", size)
    half = pinv(r)

    def part(it):
        acc = np.zeros((size, width))
        for pdf in it:
            if len(pdf):
                b = np.stack(pdf["x"].to_list())
                acc += (b @ omega @ half).T @ b
        yield pd.DataFrame({"i": range(size), "row": acc.tolist()})

    got = x.mapInPandas(part, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    small = np.zeros((size, width))
    small[got["i"], got["j"]] = got["v"]
    u, s, vt = np.linalg.svd(small, full_matrices=False)
    return x.select(id_col, times(F.col("x"), omega @ half @ u[:, :k]).alias("u")), s[:k], vt[:k]


@dataclass
class PCA:
    """A fitted projection; ``projected`` has id and the scores."""

    projected: DataFrame
    components: np.ndarray
    mean: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    singular_values: np.ndarray
    noise_variance: float


def pca(df: DataFrame, id_col: str, vec_col: str, width: int, k: int = 2, center: bool = True) -> PCA:
    """Principal components from the Gram matrix of one pass; signs are set so that each component's largest weight is positive."""
    _check(width)
    g, s, n = gram(df, vec_col, width)
    mean = s / max(n, 1) if center else np.zeros(width)
    values, vectors = symeig(g - n * np.outer(mean, mean))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), range(width)])
    top = vectors[:, :k]
    var = values / max(n - 1, 1)
    shifted = F.zip_with(F.col(vec_col).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    rest = var[k : min(n, width)]
    return PCA(df.select(id_col, times(shifted, top).alias("score")), top, mean, var[:k], var[:k] / var.sum() if var.sum() else var[:k], np.sqrt(values[:k]), float(rest.mean()) if len(rest) else 0.0)

"""Observations by features: one row per observation, one column per feature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import elementwise as fx

#: Up to so many features, aggregates are listed; beyond, Gram matrices are summed per task.
LISTED = 8


def axis0(df: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row: ``<column>_<stat>`` for sum, mean, min, max, var, std and product over all rows."""
    how = {
        "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "product": F.product,
        "var": lambda c: F.coalesce(F.var_samp(c), F.lit(fx.NAN)), "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(fx.NAN)),
    }
    return df.agg(*[how[s](c).alias(f"{c}_{s}") for c in columns for s in stats])


def center(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean: the one row of means is broadcast."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(means))
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def gram(df: DataFrame, columns: Sequence[str] | str, width: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(XᵀX, column sums, rows) of columns, or of an array column of ``width``, in one pass with tree aggregation.

    What is gathered is k x k per task, and k is the number of features.
    """
    x = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")) if not isinstance(columns, str) else df.select(F.col(columns).cast("array<double>").alias("x"))
    k = width or len(columns)

    def part(it):
        g, s, n = np.zeros((k, k)), np.zeros(k), 0
        for pdf in it:
            if len(pdf):
                m = np.stack(pdf["x"].to_list())
                g += m.T @ m
                s += m.sum(axis=0)
                n += len(m)
        if n:
            yield pd.DataFrame({"p": range(k + 1), "row": [*g.tolist(), s.tolist()], "n": n})

    parts = x.mapInPandas(part, "p int, row array<double>, n long")
    summed = parts.select("p", F.posexplode("row").alias("q", "v"), "n").groupBy("p", "q").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    out, n = np.zeros((k + 1, k)), 0
    if len(summed):
        out[summed["p"], summed["q"]] = summed["v"]
        n = int(summed["n"].iloc[0])
    return out[:k], out[k], n


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, cov) for each pair of columns, with n - 1."""
    if len(columns) <= LISTED:
        pairs = [(a, b) for a in columns for b in columns]
        one = df.agg(*[F.coalesce(F.covar_samp(a, b), F.lit(fx.NAN)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
        rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)]))
        return one.select(rows.alias("r")).select("r.*")
    # Shifting by a first estimate of the means keeps the products small.
    first = df.select(*[F.avg(c) for c in columns]).first()
    g, s, n = gram(df.select(*[(F.col(c) - F.lit(float(m or 0))).alias(c) for c, m in zip(columns, first, strict=True)]), columns)
    cov = (g - np.outer(s, s) / max(n, 1)) / (n - 1) if n > 1 else np.full_like(g, np.nan)
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double")


def accuracy(pred: Column, truth: Column) -> Column:
    return F.avg((pred == truth).cast("double"))


def mean_squared_error(y: Column, truth: Column) -> Column:
    return F.avg(fx.squared_error(y, truth))


def mean_absolute_error(y: Column, truth: Column) -> Column:
    return F.avg(fx.absolute_error(y, truth))


def mean_relative_error(y: Column, truth: Column) -> Column:
    return F.avg(fx.relative_error(y, truth))

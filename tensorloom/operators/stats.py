"""Kernel density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import elementwise as fx
from tensorloom.plans.select import quantiles


def silverman(df: DataFrame, col: str, adjust: float = 1.0) -> float:
    r = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("s")).first()
    q = quantiles(df, [], col, [0.25, 0.75]).first()
    spread = min(x for x in (r["s"], (q["q1"] - q["q0"]) / 1.34) if x) if r["s"] else 1.0
    return 0.9 * spread * r["n"] ** -0.2 * adjust


def kde(df: DataFrame, col: str, samples: DataFrame, x_col: str = "x", kernel: str = "gauss", bandwidth: float | None = None, adjust: float = 1.0, cutoff: float | None = None, weight: str | None = None, normalize: bool = False) -> DataFrame:
    """(x, density) at the sample points.

    Values reach only samples within the cutoff (the kernel's own half-width, or
    three bandwidths for the bell curve): both are cut into cells of that width and
    joined by cell.
    """
    bw = bandwidth if bandwidth is not None else silverman(df, col, adjust)
    reach = cutoff if cutoff is not None else fx.REACH[kernel] * bw
    values = df.select(F.col(col).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    # Equal values are summed first: each distinct value meets its samples once.
    values = values.groupBy("_v").agg(F.sum("_w").alias("_w")).withColumn("_c", F.floor(F.col("_v") / reach))
    n = df.where(F.col(col).isNotNull()).count()
    at = samples.select(F.col(x_col).cast("double").alias("x"))
    near = at.distinct().withColumn("_c", F.explode(F.array(*[F.floor(F.col("x") / reach) + s for s in (-1, 0, 1)])))
    u = (F.col("x") - F.col("_v")) / bw
    hit = near.join(values, "_c").where(F.abs(F.col("x") - F.col("_v")) <= reach)
    dens = hit.groupBy("x").agg((F.sum(F.col("_w") * fx.KERNELS[kernel](u)) / (n * bw)).alias("density"))
    out = at.join(dens, "x", "left").select("x", F.coalesce("density", F.lit(0.0)).alias("density"))
    if not normalize:
        return out
    r = out.agg(F.sum("density").alias("s"), F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).first()
    area = (r["s"] or 0.0) * ((r["b"] - r["a"]) / r["n"] if r["n"] else 0.0)
    return out.withColumn("density", F.col("density") / (area if area and math.isfinite(area) else 1.0))

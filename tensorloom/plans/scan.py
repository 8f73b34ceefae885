"""Running aggregates and neighbours along an axis of any length, in chunks.

The axis is cut into chunks.  Inside a chunk an ordinary window runs; chunks are
summed up to one row each, these are scanned in the same way, and each chunk starts
from what came before it.  Neighbours across a cut are had by sending the last rows of
a chunk to the next one as well.  No window spans more than ``CHUNK`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 14


def _chunk(at: str, size: int) -> Column:
    return F.call_function("div", F.col(at), F.lit(size)).cast("bigint")


def running(df: DataFrame, by: list[str], at: str, n: int, value: Column, agg: Callable[[Column], Column], combine: Callable[[Column, Column], Column], out: str, chunk: int | None = None) -> DataFrame:
    """``df`` plus ``out``: the aggregate of ``value`` up to each row along ``at`` (0 to n - 1), itself included.

    ``agg`` must be associative with ``combine``: sums, products, minima, maxima.
    """
    chunk, columns = chunk or CHUNK, df.columns
    cut = df.withColumn("_v", value).withColumn("_c", _chunk(at, chunk))
    inside = agg(F.col("_v")).over(Window.partitionBy(*by, "_c").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    if n <= chunk:
        return cut.withColumn(out, inside).select(*columns, out)
    sums = cut.groupBy(*by, F.col("_c").alias("_k")).agg(agg(F.col("_v")).alias("_s"))
    upto = running(sums, by, "_k", -(-n // chunk), F.col("_s"), agg, combine, "_r", chunk)
    before = upto.select(*by, (F.col("_k") + 1).alias("_c"), F.col("_r").alias("_upto"))
    both = cut.withColumn("_in", inside).join(before, [*by, "_c"], "left")
    total = F.when(F.col("_c") == 0, F.col("_in")).otherwise(combine(F.col("_upto"), F.col("_in")))
    return both.select(*columns, total.alias(out))


def with_earlier(df: DataFrame, by: list[str], at: str, value: str, reach: int, chunk: int | None = None) -> DataFrame:
    """``df`` plus _e1 ... _e<reach>: the values 1 to ``reach`` places before along ``at``; null before the start."""
    chunk = max(chunk or CHUNK, reach)
    own = _chunk(at, chunk)
    homes = F.when(F.col(at) % chunk >= chunk - reach, F.array(own, own + 1)).otherwise(F.array(own))
    sent = df.withColumn("_c", F.explode(homes)).withColumn("_guest", F.col("_c") != own)
    w = Window.partitionBy(*by, "_c").orderBy(at)
    return sent.withColumns({f"_e{k}": F.lag(value, k).over(w) for k in range(1, reach + 1)}).where(~F.col("_guest")).drop("_c", "_guest")

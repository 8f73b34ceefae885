"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> one row (node, root) per node with a link; root is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, on the least known
    node; rounds grow with the logarithm of the longest path.  Neighbours are
    never gathered: only minima are aggregated, with map-side combining.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every node now has smaller neighbours only.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        then = materialize(small.where("a <> b"), "edges")
        same = _digest(now) == _digest(then)
        discard(now)
        now = then
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % 1_000_000_007)).alias("s"), F.expr("bit_xor(xxhash64(b, a))").alias("x")).first()
    return tuple(row)

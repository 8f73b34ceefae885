"""Exact order statistics per group by narrowing ranges, without gathering a group.

A pass sketches the values of each range (a mergeable quantile sketch of fixed size),
takes from it a bracket around each wanted rank, and counts exactly what lies below
and inside the bracket, with map-side combining.  What lies inside is the next range,
some 300 times smaller; the counts prove that it holds the rank.  A range of at most
``FEW`` values, or of about half as many different ones, is settled.  So a group of any size costs a
sketch and two numbers per task, and each pass reads what the last one left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.plans.tables import settle

#: Values of a range that are sorted in one row.
FEW = 2048
#: Steps between the percentages of a sketch, its accuracy (in parts of the range's size), and steps by which brackets reach beyond a rank.
GRID, ACCURACY, REACH = 1000, 20_000, 1
#: Groups whose brackets are sent to all tasks; more are joined by shuffle.
SENT_GROUPS = 50_000


def _bracket(sketch: Column, first: Column, last: Column, size: Column, reach: int) -> list[Column]:
    """Bounds (null: none) around the ranks ``first`` to ``last`` of ``size`` values with these percentiles."""
    step = GRID / F.greatest(size - 1, F.lit(1)).cast("double")
    low, high = F.floor(first * step).cast("int") - reach, F.ceil(last * step).cast("int") + reach
    return [F.when(low > 0, F.get(sketch, low)).alias("a"), F.when(high < GRID, F.get(sketch, high)).alias("b")]


def _narrowed(held: DataFrame, wanted: DataFrame, keys: list[str], sketched: list[str], sent: bool) -> tuple[DataFrame, DataFrame]:
    """One pass: the values inside the brackets, and ``wanted`` with the size of the new ranges and what lies below them."""
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    sketches = held.groupBy(*sketched).agg(F.percentile_approx("_v", grid, F.lit(ACCURACY)).alias("_sketch"))
    met = wanted.join(sketches, sketched) if sketched else wanted.crossJoin(sketches)
    reach = REACH
    while True:
        at = F.col("_first") - F.col("_below"), F.col("_last") - F.col("_below")
        brackets = settle(met.select(*keys, *_bracket(F.col("_sketch"), *at, F.col("_size"), reach)), "brackets")
        right = F.broadcast(brackets) if sent else brackets
        both = held.join(right, sketched) if sketched else held.crossJoin(right)
        low, high = F.coalesce(F.col("_v") < F.col("a"), F.lit(False)), F.coalesce(F.col("_v") > F.col("b"), F.lit(False))
        counts = both.groupBy(*keys).agg(F.count_if(low).alias("_less"), F.count_if(~low & ~high).alias("_now"))
        then = wanted.join(counts, keys).withColumns({"_below": F.col("_below") + F.col("_less"), "_size": F.col("_now")}).drop("_less", "_now")
        then = settle(then, "wanted")
        if reach >= GRID or not then.where("_first < _below OR _last >= _below + _size").take(1):
            return settle(both.where(~low & ~high).select(*keys, "_v"), "inside"), then
        reach *= 8  # a sketch that missed: wider brackets, at last the whole range


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with the exact quantile for each share (0 to 1), linear between neighbours.

    Nulls do not count; NaN is greater than all other values; a group without values
    has no row, but without groups there is one row, of nulls if there are no values;
    null is a group like any other.
    """
    names = list(names or [f"q{k}" for k in range(len(shares))])
    groups = {c: f"_g{k}" for k, c in enumerate(by)}
    # Null keys would not meet in joins: a flag stands beside each key.
    cols = [x for c, g in groups.items() for x in (F.col(c).isNull().alias(f"{g}n"), F.coalesce(F.col(c), F.lit(_zero(df, c))).alias(g))]
    keys = [x for g in groups.values() for x in (f"{g}n", g)]
    held = df.select(*cols, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    sizes = settle(held.groupBy(*keys).agg(F.count("*").alias("_size")), "sizes")
    most, n_groups = sizes.agg(F.max("_size"), F.count("*")).first()
    place = F.col("_share") * (F.col("_size") - 1)
    share = F.explode(F.array(*[F.struct(F.lit(k).alias("_s"), F.lit(float(x)).alias("_share")) for k, x in enumerate(shares)])).alias("_x")
    wanted = sizes.select("*", share).select(*keys, "_size", "_x.*").withColumns({"_first": F.floor(place), "_last": F.ceil(place), "_part": place - F.floor(place), "_below": F.lit(0).cast("bigint")})
    sketched, ranks = keys, [*keys, "_s"]
    for _ in range(64):
        if (most or 0) <= FEW:
            break
        held, wanted = _narrowed(held, wanted, ranks, sketched, n_groups * len(shares) <= SENT_GROUPS)
        sketched = ranks
        # A short list of values is enough, however often each of them occurs.
        kinds = held.groupBy(*ranks).agg(F.approx_count_distinct("_v").alias("_kinds"), F.count("*").alias("_n"))
        most = kinds.agg(F.max(F.least("_n", 2 * F.col("_kinds")))).first()[0]
    if sketched == keys:
        held = held.join(wanted.select(*ranks), keys) if keys else held.crossJoin(wanted.select("_s"))
    # Equal values are one entry with a number, so a range is short even if one value fills it.
    entries = held.groupBy(*ranks, "_v").agg(F.count("*").alias("_n"))
    listed = entries.groupBy(*ranks).agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_vs"))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("double").alias("v"))

    def at(rank: Column) -> Column:
        """The value at ``rank`` within the list."""
        found = F.aggregate("_vs", start, lambda s, e: F.struct((s["upto"] + e["_n"]).alias("upto"), F.when((s["upto"] <= rank) & (rank < s["upto"] + e["_n"]), e["_v"]).otherwise(s["v"]).alias("v")))
        return found["v"]

    low, high = at(F.col("_first") - F.col("_below")), at(F.col("_last") - F.col("_below"))
    pair = wanted.join(listed, ranks).select(*ranks, "_part", low.alias("_low"), high.alias("_high"))
    value_at = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (1 - F.col("_part")) + F.col("_high") * F.col("_part"))
    wide = pair.withColumn("_q", value_at).groupBy(*keys).agg(*[F.max(F.when(F.col("_s") == k, F.col("_q"))).alias(n) for k, n in enumerate(names)])
    return wide.select(*[F.when(~F.col(f"{g}n"), F.col(g)).alias(c) for c, g in groups.items()], *names)


def _zero(df: DataFrame, column: str):
    """Some value of the column's type, which stands for null beside its flag."""
    return "" if dict(df.dtypes)[column] == "string" else 0


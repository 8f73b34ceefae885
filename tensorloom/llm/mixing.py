"""Mixing sources to target weights by temperature.

Token shares q of the sources are raised to an exponent a in [0, 1] and
normalised.  ``a`` is found by bisection: the largest that reaches a target
entropy, but never so small that a source would be repeated beyond a limit.
Each weight becomes a token budget, and each budget a stream of permuted blocks:
whole passes over the source's blocks, each in an order of its own, then a part
of a last pass that ends at the budget.

The sources are a table of any length: each step of the search sums up powers of
all shares, for several exponents at once, and only those sums reach the driver.
A pass is cut by prefix sums over ranges of blocks, then over the blocks of a
range, and within the one block that the budget ends in over its documents, so a
source with most of the corpus is never in one task.

Defined results: a null source is a source of its own; documents without a
token cost nothing and follow their block; a source without tokens takes no
part of the budget and passes once; an empty table gives an empty result;
repeated rows are separate documents that share their fate; rows without an id
are dealt by their text, or all alike where there is none; a text is never cut,
however long: one that the budget would end in is left out of the last pass;
columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE_RE, discard, materialize, without

#: Documents per block, about; ranges of a pass that are summed before its blocks are.
BLOCK_DOCS, RANGES = 500, 1024
#: Exponents tried at once, and rounds of the search: the last gap is WIDTH ** -ROUNDS.
WIDTH, ROUNDS = 16, 10


class Shares:
    """Sums over the live sources (those with tokens) from which every figure of a mix follows."""

    def __init__(self, sources: DataFrame, tokens: str = "t"):
        self.live = sources.where(F.col(tokens) > 0).select(F.col(tokens).cast("double").alias("t"))
        r = self.live.agg(F.count("*").alias("n"), F.sum("t").alias("all"), F.min("t").alias("low"), F.max("t").alias("high")).first()
        self.n, self.total, self.low, self.high = r["n"], r["all"] or 0.0, r["low"] or 0.0, r["high"] or 0.0

    def at(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent: the sum of powers of the shares, and the entropy of the weights."""
        q = F.col("t") / self.total
        sums = [x for k, a in enumerate(exponents) for x in (F.sum(F.pow(q, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(q, F.lit(a)) * F.ln(q)).alias(f"s{k}"))]
        r = self.live.agg(*sums).first()
        return [(r[f"z{k}"], math.log(r[f"z{k}"]) - a * r[f"s{k}"] / r[f"z{k}"]) for k, a in enumerate(exponents)]

    def deal(self, exponent: float, z: float, budget: float | None) -> float:
        """Tokens to deal out: ``budget`` times the corpus; None: just enough for one whole pass of each source."""
        return budget * self.total if budget is not None else z * self.total * (self.high / self.total) ** (1 - exponent)

    def repeats(self, exponent: float, z: float, budget: float | None) -> float:
        """Passes of the source that is repeated most: the smallest one."""
        return (self.low / self.total) ** (exponent - 1) / z * self.deal(exponent, z, budget) / self.total


def search(holds: Callable[[list[float]], list[bool]]) -> float:
    """The largest number in [0, 1] at which ``holds``; it holds below and fails above. 0 if nowhere.

    A bisection into WIDTH parts: one question to the data settles several cuts.
    """
    if holds([1.0])[0]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        cuts = [low + (high - low) * k / WIDTH for k in range(1, WIDTH)]
        ok = holds(cuts)
        k = next((k for k, x in enumerate(ok) if not x), len(cuts))
        low, high = (cuts[k - 1] if k else low), (cuts[k] if k < len(cuts) else high)
    return low


def choose_exponent(shares: Shares, budget: float | None = 1.0, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """``target_entropy`` is a share of the largest possible entropy, log(number of sources)."""
    if shares.n < 2:
        return 1.0
    a = 0.0 if target_entropy is None and max_repeats is not None else 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(shares.n)
        a = search(lambda xs: [h >= goal for _, h in shares.at(xs)])
    if max_repeats is not None:
        # Repeats fall as the exponent rises: the smallest exponent within the limit.
        within = lambda ys: [shares.repeats(1.0 - y, z, budget) <= max_repeats for y, (z, _) in zip(ys, shares.at([1.0 - y for y in ys]), strict=True)]
        a = max(a, 1.0 - search(within))
    return a


def token_count(text: Column) -> Column:
    """Words of the text, counted without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_RE[1:-2]}]+")).cast("long")


def deal_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What decides where a document is dealt to: its id, or the text of rows that have none."""
    return F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))


#: Names used inside; input columns of these names are dropped.
_INSIDE = ("_s", "_total", "_goal", "_blocks", "_block", "_start", "_take", "_in", "_run")


def _running(df: DataFrame, by: list[str], order: Column, value: str, out: str) -> DataFrame:
    """``df`` plus the sum of ``value`` over the rows before it in ``order`` (a hash) within ``by``.

    Ranges of the hash are summed first, so no window holds more than a range.
    """
    cut = df.withColumns({"_h": order, "_r": F.shiftrightunsigned(order, 64 - RANGES.bit_length() + 1)})
    sums = cut.groupBy(*by, "_r").agg(F.sum(value).alias("_n"))
    # At most RANGES rows for each group.
    upto = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*[F.col(c).alias(f"{c}_"[1:]) for c in by], F.col("_r").alias("r_"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_r").orderBy("_h", "_block").rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("_in_range", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [within[c].eqNullSafe(shift[f"{c}_"[1:]]) for c in by] + [within["_r"] == shift["r_"]]
    return within.join(shift, same).withColumn(out, F.col("_in_range") + F.col("_shift")).select(*df.columns, out)


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float | None = 1.0, target_entropy: float | None = None, max_repeats: float | None = 4.0, seed: int = 7, tokens_col: str | None = None, key_col: str | None = None) -> DataFrame:
    """One row per copy of a document in the mix: the columns of ``df`` plus n_tokens, weight, epoch and mix_key.

    Tokens are the words of the text, or what ``tokens_col`` says.  Documents are
    dealt by :func:`deal_key`, or by ``key_col``.

    Ordering by mix_key (0 to 1) deals the sources out side by side at their weights.
    """
    tokens = token_count(F.col(text_col)) if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0)).cast("long")
    key = deal_key(id_col, text_col) if key_col is None else F.col(key_col)
    added = {"_tokens": tokens, "_key": key, "_src": F.col(source_col).cast("string")}
    tagged = without(df.withColumns(added), "n_tokens", "weight", "epoch", "mix_key", *_INSIDE).withColumnRenamed("_tokens", "n_tokens")
    per = materialize(tagged.groupBy(F.col("_src").alias("_s")).agg(F.sum("n_tokens").alias("_total"), F.count("*").alias("_docs")), "sources")
    shares = Shares(per, "_total")
    a = choose_exponent(shares, budget, target_entropy, max_repeats)
    z = shares.at([a])[0][0] if shares.n else 1.0
    deal = shares.deal(a, z, budget) if shares.n else 0.0
    weight = F.when(F.col("_total") > 0, F.pow(F.col("_total") / F.lit(max(shares.total, 1.0)), F.lit(a)) / z).otherwise(0.0)
    ratio = F.when(F.col("_total") > 0, F.col("weight") * deal / F.col("_total")).otherwise(0.0)
    # Rounding must not cut a whole pass short.
    goal = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.col("_total") * F.round(ratio)).otherwise(F.round(F.col("weight") * deal)).cast("long")
    plan = per.withColumn("weight", weight).withColumn("_goal", goal).withColumn("_blocks", F.greatest(F.ceil(F.col("_docs") / BLOCK_DOCS), F.lit(1)).cast("int")).drop("_docs")
    # One row per source: Spark broadcasts it if it is small and splits hot sources if it is not.
    block = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.col("_blocks")).cast("int")
    blocked = tagged.join(plan, tagged["_src"].eqNullSafe(plan["_s"])).withColumn("_block", block)

    sums = materialize(blocked.groupBy("_s", "_block", "_total", "_goal").agg(F.sum("n_tokens").alias("_in")), "blocks")
    passes = F.when(F.col("_total") > 0, F.ceil(F.col("_goal") / F.col("_total"))).otherwise(F.lit(1)).cast("int")
    each = sums.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0)))))
    each = _running(each, ["_s", "_epoch"], F.xxhash64(F.lit(seed), "_s", "_epoch", "_block"), "_in", "_before")
    each = each.withColumn("_start", F.col("_epoch") * F.col("_total") + F.col("_before"))
    take = F.when(F.col("_total") == 0, F.lit(0)).otherwise(F.least(F.col("_in"), F.greatest(F.col("_goal") - F.col("_start"), F.lit(0))))
    schedule = materialize(each.withColumn("_take", take).where((F.col("_take") > 0) | (F.col("_total") == 0) | ((F.col("_in") == 0) & (F.col("_start") <= F.col("_goal")))), "schedule")
    discard(sums)

    by = [blocked["_s"].eqNullSafe(schedule["_s"]), blocked["_block"] == schedule["_block"]]
    keep = schedule.select("_s", "_block", F.col("_epoch").alias("epoch"), "_start", "_take", "_in")
    placed = blocked.join(keep, by).drop(keep["_s"]).drop(keep["_block"])
    whole = placed.where(F.col("_take") == F.col("_in"))
    # The one block of a source in which its budget ends.
    ends = Window.partitionBy("_s", "_block", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where(F.col("_take") < F.col("_in")).withColumn("_run", F.sum("n_tokens").over(ends)).where(F.col("_run") <= F.col("_take")).drop("_run")
    out = whole.unionByName(cut)
    within = F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "epoch"), F.lit(1_000_003)) / 1_000_003
    at = F.when(F.col("_goal") > 0, F.least(F.lit(1.0), (F.col("_start") + within * F.col("_take")) / F.col("_goal"))).otherwise(within)
    return out.withColumn("mix_key", at).drop("_s", "_src", "_key", "_total", "_goal", "_blocks", "_block", "_start", "_take", "_in")

"""Density clusters whose cost stays linear however many points lie in one place.

Cells are so small that any two of their points are neighbours.  A cell with
``min_samples`` points is *full*: all its points are core points of one cluster, so
it stands for them as one node and its pairs are never formed.  Only points of other
cells, fewer than ``min_samples`` each, look for their neighbours.  Whether two full
cells touch is found by halving both, level by level: bounding boxes that are surely
apart are dropped, boxes that are surely near settle their cells, and what has become
small is compared point by point.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators import arrays, neighbors
from tensorloom.plans.tables import settle

#: Product of two boxes' points up to which they are compared point by point.
FEW_PAIRS = 1024
#: Halvings after which boxes are as fine as the numbers themselves.
LEVELS = 48


def _norm(gaps: list[Column], metric: str, p: float) -> Column:
    zero = F.array(*[F.lit(0.0)] * len(gaps))
    return arrays.distance(F.array(*gaps), zero, metric, p)


def _box_gaps(k: int) -> tuple[Column, Column]:
    """Least and greatest difference along axis ``k`` of points in the boxes a and b."""
    a, b, c, d = (F.col(f"{n}.{e}{k}") for n, e in (("a", "lo"), ("a", "hi"), ("b", "lo"), ("b", "hi")))
    return F.greatest(c - b, a - d, F.lit(0.0)), F.greatest(d - a, b - c)


def _boxes(points: DataFrame, side: float, level: int, rank: int) -> DataFrame:
    """Tight boxes of the occupied parts of cells after ``level`` halvings, each with the number of its parent."""
    at = lambda n: F.array(*[F.floor(F.col(f"_x{k}") / (side / 2**n)) for k in range(rank)])
    box = F.struct(*[f(f"_x{k}").alias(f"{n}{k}") for k in range(rank) for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))
    return points.groupBy("rep", at(max(level - 1, 0)).alias("parent"), at(level).alias("own")).agg(box.alias("box"))


def _touching(full: DataFrame, pairs: DataFrame, side: float, eps: float, metric: str, p: float, rank: int) -> list[DataFrame]:
    """Tables (a, b) of those ``pairs`` of full cells that hold two points within eps.

    ``full`` has rep and coordinates; a cell goes by its smallest point, ``rep``.
    """
    origin = F.array(*[F.lit(0).cast("bigint")] * rank)
    found: list[DataFrame] = []
    live = pairs.select("a", "b", origin.alias("pa"), origin.alias("pb"))
    for level in range(LEVELS + 1):
        reps = live.select(F.col("a").alias("rep")).union(live.select(F.col("b").alias("rep"))).distinct()
        full = settle(full.join(reps, "rep", "left_semi"), "full")
        boxes = settle(_boxes(full, side, level, rank), "boxes")
        left = boxes.select(F.col("rep").alias("a"), F.col("parent").alias("pa"), F.col("own").alias("oa"), F.col("box").alias("_a"))
        right = boxes.select(F.col("rep").alias("b"), F.col("parent").alias("pb"), F.col("own").alias("ob"), F.col("box").alias("_b"))
        # At the first level a cell is one box, whose parent is not asked for.
        met = live.join(left, ["a", "pa"]).join(right, ["b", "pb"]) if level else live.drop("pa", "pb").join(left, "a").join(right, "b")
        met = met.select("a", "b", "oa", "ob", F.col("_a").alias("box_a"), F.col("_b").alias("box_b"))
        gaps = [_box_gaps(k) for k in range(rank)]
        judged = met.withColumnsRenamed({"a": "ra", "b": "rb", "box_a": "a", "box_b": "b"})
        judged = judged.select("ra", "rb", "oa", "ob", (F.col("a.n") * F.col("b.n")).alias("n"), _norm([g for g, _ in gaps], metric, p).alias("least"), _norm([g for _, g in gaps], metric, p).alias("most"))
        judged = settle(judged.where(F.col("least") < eps), "judged")
        sure = settle(judged.where(F.col("most") < eps).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "sure")
        found.append(sure)
        rest = judged.join(sure, (judged["ra"] == sure["a"]) & (judged["rb"] == sure["b"]), "left_anti")
        small = F.lit(True) if level == LEVELS else F.col("n") <= FEW_PAIRS
        own = full.withColumn("own", F.array(*[F.floor(F.col(f"_x{k}") / (side / 2**level)) for k in range(rank)])).select("rep", "own", F.array(*[f"_x{k}" for k in range(rank)]).alias("_x"))
        u, v = own.select(F.col("rep").alias("ra"), F.col("own").alias("oa"), F.col("_x").alias("_u")), own.select(F.col("rep").alias("rb"), F.col("own").alias("ob"), F.col("_x").alias("_v"))
        near = rest.where(small).join(u, ["ra", "oa"]).join(v, ["rb", "ob"]).where(arrays.distance(F.col("_u"), F.col("_v"), metric, p) < eps)
        by_point = settle(near.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "by_point")
        found.append(by_point)
        open_ = rest.where(~small).join(by_point, (rest["ra"] == by_point["a"]) & (rest["rb"] == by_point["b"]), "left_anti")
        live = settle(open_.select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.col("oa").alias("pa"), F.col("ob").alias("pb")), "live")
        if not live.take(1):
            break
    return found


def dbscan(points: DataFrame, dims: list[str], id_col: str, eps: float, min_samples: int, metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """(id, core, root): root is the smallest core point of the cluster, null for noise.

    Neighbours lie strictly within eps and include the point itself.  A border point
    goes to the cluster with the smallest root among its core neighbours.  A point
    with a missing or non-finite coordinate is noise; ids are unique.  Up to three
    dimensions work stays linear in crowded places; beyond, and for metrics other than
    Minkowski's, all pairs within eps are formed (:func:`neighbors.dbscan`).
    """
    rank = len(dims)
    power = {"euclidean": 2.0, "manhattan": 1.0, "minkowski": p}.get(metric)
    if power is None or power < 1 or rank > neighbors.GRID_DIMENSIONS:
        return neighbors.dbscan(points, dims, id_col, eps, min_samples, metric, p)
    # A little narrower than needed, so that rounding takes no point of a cell out of reach.
    side = 0.999 * eps / rank ** (1 / power)
    reach = math.ceil(eps / side)
    xs, cs = [f"_x{k}" for k in range(rank)], [f"_c{k}" for k in range(rank)]
    named = points.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(dims, xs, strict=True)])
    for x in xs:
        named = named.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    placed = named.select("*", *[F.floor(F.col(x) / side).alias(c) for x, c in zip(xs, cs, strict=True)])
    cells = settle(placed.groupBy(*cs).agg(F.count("*").alias("n"), F.min("id").alias("rep")), "cells")
    placed = settle(placed.join(cells, cs).withColumn("full", F.col("n") >= min_samples).withColumn("node", F.when(F.col("full"), F.col("rep")).otherwise(F.col("id"))), "placed")

    around = [o for o in itertools.product(range(-reach, reach + 1), repeat=rank) if sum(max(abs(x) - 1, 0) ** power for x in o) * side**power < eps**power]
    offsets = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"o{k}") for k, x in enumerate(o)]) for o in around])).alias("_o")
    shifted = [(F.col(c) + F.col(f"_o.o{k}")).alias(c) for k, c in enumerate(cs)]
    seeking = placed.where(~F.col("full")).select(F.col("id").alias("a"), F.array(*xs).alias("_u"), *cs, offsets).select("a", "_u", *shifted)
    # One row per point and full cell, or per pair of points of cells that are not full.
    hits = seeking.join(placed.select(*cs, "node", "full", F.array(*xs).alias("_v")), cs).where(arrays.distance(F.col("_u"), F.col("_v"), metric, p) < eps)
    near = settle(hits.groupBy("a", "node", "full").agg(F.count("*").alias("n")), "near")
    alone = settle(near.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("node")), "core")

    full_cells = cells.where(F.col("n") >= min_samples)
    beside = full_cells.select(F.col("rep").alias("a"), *cs, offsets).select("a", *shifted).join(full_cells.select(F.col("rep").alias("b"), *cs), cs).where("a < b").select("a", "b")
    touching = _touching(placed.where("full").select("rep", *xs), settle(beside, "beside"), side, eps, metric, p, rank)
    at_core = near.where("full").select("a", "node").unionAll(near.where("NOT full").join(alone, "node", "left_semi").select("a", "node"))
    links = at_core.join(alone.withColumnRenamed("node", "a"), "a", "left_semi").select("a", F.col("node").alias("b"))
    for t in touching:
        links = links.unionAll(t)
    roots = neighbors.connected(links, alone.unionAll(full_cells.select(F.col("rep").alias("node"))))
    border = at_core.join(roots, "node").groupBy("a").agg(F.min("root").alias("border"))
    core = placed.select("id", "node").join(roots, "node").select("id", "root", F.lit(True).alias("_core"))
    out = points.select(F.col(id_col).alias("id")).join(core, "id", "left").join(border.withColumnRenamed("a", "id"), "id", "left")
    return out.select("id", F.coalesce("_core", F.lit(False)).alias("core"), F.coalesce("root", "border").alias("root"))

"""Nearest neighbours by a kd-split: cells with bounding boxes, searched in two phases.

Splits come from a bounded sample at medians of the widest side; every point is then
dealt to its cell, and the cells' boxes are those of all their points.  A query first
meets its own cell.  The distance of its k-th neighbour there bounds what is left: it
goes on only to cells whose box is no farther.  So the answer is exact, whatever the
sample was; only the number of cells that are looked into depends on it.

Points of a cell travel in packed parts of at most ``PART``, and so do its queries, so a
cell with much of the data (equal points cannot be split) is many parts, not one row.
In many dimensions boxes reach everywhere and little is saved.

Distances are Minkowski's: ``p`` of 1, 2 or any other at least 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tensorloom.plans.tables import settle

#: Points of a cell, about; cells and sampled points at most (both shrink with the number of dimensions).
LEAF, MOST_CELLS, SAMPLE = 1024, 16_384, 50_000
#: Numbers in the sample and in all boxes, at most: both are on the driver and in every task.
NUMBERS = 2_000_000
#: Points or queries in a packed row; rows of an answer handed over at once, about.
PART, ROWS = 2048, 100_000
#: Pairs that a task compares, about, if that does not take more than ``MOST_TASKS``; pairs of a cell under one key.
PAIRS, MOST_TASKS, CROWD = 1 << 24, 20_000, 1 << 26


@dataclass
class Splits:
    """Inner nodes: split dimension and value, and children (a cell c is written as -1 - c)."""

    dim: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cells: int

    def locate(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row of ``x``."""
        node = np.full(len(x), 0 if len(self.dim) else -1)
        while (node >= 0).any():
            rows = np.flatnonzero(node >= 0)
            n = node[rows]
            node[rows] = np.where(x[rows, self.dim[n]] < self.at[n], self.low[n], self.high[n])
        return -1 - node


def split(sample: np.ndarray, cells: int) -> Splits:
    """Halve the largest parts of the sample at medians until there are ``cells`` of them or nothing differs."""
    dim, at, low, high = [], [], [], []
    cell = 0

    def grow(x: np.ndarray, wanted: int) -> int:
        nonlocal cell
        if wanted > 1 and len(x) > 1:
            side = np.ptp(x, axis=0)
            d = int(side.argmax())
            v = float(np.median(x[:, d]))
            left = x[:, d] < v
            if side[d] > 0 and not left.any():
                v = float(x[x[:, d] > v, d].min())
                left = x[:, d] < v
            if side[d] > 0 and left.any() and not left.all():
                node = len(dim)
                dim.append(d)
                at.append(v)
                low.append(0)
                high.append(0)
                low[node], high[node] = grow(x[left], wanted // 2), grow(x[~left], wanted - wanted // 2)
                return node
        cell += 1
        return -cell

    grow(sample, cells)
    return Splits(np.array(dim, int), np.array(at, float), np.array(low, int), np.array(high, int), max(cell, 1))


def norm(gaps: np.ndarray, p: float) -> np.ndarray:
    """Minkowski norm along the last axis."""
    if p == 2:
        return np.sqrt((gaps * gaps).sum(-1))
    return np.abs(gaps).sum(-1) if p == 1 else (np.abs(gaps) ** p).sum(-1) ** (1 / p)


@dataclass
class KdIndex:
    splits: Splits
    low: np.ndarray  # of each cell's box; cells without points have none
    high: np.ndarray
    packed: DataFrame  # cell, ids, xs: parts of at most PART points
    counts: np.ndarray | None = None  # points of each cell

    def reached(self, x: np.ndarray, radius: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``x``, cell) for each cell whose box is within a point's radius.

        All points go down the splits together; a node's box holds those of its cells,
        so a branch is left by the points that do not reach it.
        """
        rows, cells = [], []
        todo = [(0 if len(self.splits.dim) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            low, high = (self.low[-1 - node], self.high[-1 - node]) if node < 0 else (self.nodes[0][node], self.nodes[1][node])
            if np.isinf(low).any() and not (low <= high).all():
                continue  # no points
            gaps = np.maximum(np.maximum(low - x[at], x[at] - high), 0)
            # Rounding may make a box seem farther than its points are.
            at = at[norm(gaps, p) <= radius[at] * (1 + 1e-9)]
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                cells.append(np.full(len(at), -1 - node))
            else:
                todo += [(int(self.splits.low[node]), at), (int(self.splits.high[node]), at)]
        none = np.zeros(0, int)
        return np.concatenate([none, *rows]), np.concatenate([none, *cells])

    def coarser(self, side: float) -> KdIndex:
        """Cells of a branch whose box is no wider than ``side`` are made one.

        A search within that radius gains little by narrower cells, and sends a query to
        as many more of them as there are more points.
        """
        dim, at, low, high, boxes = [], [], [], [], []
        new = np.zeros(self.splits.cells, int)

        def cells(node: int) -> list[int]:
            return [-1 - node] if node < 0 else cells(int(self.splits.low[node])) + cells(int(self.splits.high[node]))

        def copy(node: int) -> int:
            lo, hi = (self.low[-1 - node], self.high[-1 - node]) if node < 0 else (self.nodes[0][node], self.nodes[1][node])
            if node < 0 or (lo > hi).any() or (hi - lo <= side).all():
                new[cells(node)] = len(boxes)
                boxes.append((lo, hi))
                return -len(boxes)
            own = len(dim)
            dim.append(self.splits.dim[node])
            at.append(self.splits.at[node])
            low.append(0)
            high.append(0)
            low[own], high[own] = copy(int(self.splits.low[node])), copy(int(self.splits.high[node]))
            return own

        copy(0 if len(self.splits.dim) else -1)
        if len(boxes) == self.splits.cells:
            return self
        splits = Splits(np.array(dim, int), np.array(at, float), np.array(low, int), np.array(high, int), len(boxes))
        # MOST_CELLS rows at most.
        names = self.packed.sparkSession.createDataFrame([(k, int(c)) for k, c in enumerate(new)], "cell long, _cell long")
        packed = self.packed.join(F.broadcast(names), "cell").select(F.col("_cell").alias("cell"), "ids", "xs")
        return KdIndex(splits, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]), packed, np.bincount(new, self.counts, len(boxes)).astype(int))

    @cached_property
    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of the inner nodes; children have higher numbers than their node."""
        n = len(self.splits.dim)
        low, high = np.full((n, self.low.shape[1]), math.inf), np.full((n, self.low.shape[1]), -math.inf)
        for k in range(n - 1, -1, -1):
            for child in (int(self.splits.low[k]), int(self.splits.high[k])):
                lo, hi = (self.low[-1 - child], self.high[-1 - child]) if child < 0 else (low[child], high[child])
                np.minimum(low[k], lo, out=low[k])
                np.maximum(high[k], hi, out=high[k])
        return low, high


def _located(df: DataFrame, id_col: str, vec_col: str, splits: Splits) -> DataFrame:
    """(cell, id, x) of every row with a vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                f["cell"] = splits.locate(np.stack(f["x"].to_list()))
                yield f[["cell", "id", "x"]]

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    return rows.mapInPandas(run, "cell long, id long, x array<double>")


def _packed(df: DataFrame, sizes: DataFrame, more: str = "") -> DataFrame:
    """Rows (cell, id, x) packed by cell, in parts of about ``PART`` by the hash of their id."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)).alias("part")
    # The sizes have MOST_CELLS rows at most: rows are dealt once, by cell and part.
    dealt = df.join(F.broadcast(sizes), "cell").select("cell", part, "id", "x", *([more] if more else []))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        row = [int(f["cell"].iloc[0]), f["id"].to_numpy(np.int64).tobytes(), np.stack(f["x"].to_list()).astype(float).tobytes()]
        return pd.DataFrame([[*row, *([f[more].to_numpy(float).tobytes()] if more else [])]], columns=["cell", "ids", "xs", *([more] if more else [])])

    return dealt.groupBy("cell", "part").applyInPandas(pack, "cell long, ids binary, xs binary" + (f", {more} binary" if more else ""))


def build_index(points: DataFrame, id_col: str, vec_col: str, leaf: int | None = None) -> KdIndex:
    """Cells of about ``leaf`` points; rows without an id or a vector are left out, all vectors have one length."""
    leaf = leaf or LEAF
    first = points.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    d = max(first[0], 1) if first else 1
    some = points.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col)).limit(min(SAMPLE, NUMBERS // d)).select(F.col(vec_col).cast("array<double>")).collect()
    sample = np.array([r[0] for r in some], float).reshape(len(some), d)
    n = points.count()
    splits = split(sample, max(1, min(MOST_CELLS, NUMBERS // d // 2, -(-n // leaf))))
    rows = settle(_located(points, id_col, vec_col, splits), "cells")

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                f = f.sort_values("cell")
                x, (cell, first, n) = np.stack(f["x"].to_list()), np.unique(f["cell"], return_index=True, return_counts=True)
                yield pd.DataFrame({"cell": cell, "lo": list(np.minimum.reduceat(x, first)), "hi": list(np.maximum.reduceat(x, first)), "n": n})

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f["cell"].iloc[0], np.stack(f["lo"].to_list()).min(0), np.stack(f["hi"].to_list()).max(0), f["n"].sum())], columns=["cell", "lo", "hi", "n"])

    kind = "cell long, lo array<double>, hi array<double>, n long"
    box = settle(rows.mapInPandas(boxes, kind).groupBy("cell").applyInPandas(joined, kind), "boxes")
    low, high = np.full((splits.cells, d), math.inf), np.full((splits.cells, d), -math.inf)
    counts = np.zeros(splits.cells, int)
    for r in box.collect():  # MOST_CELLS rows at most
        low[r["cell"]], high[r["cell"]], counts[r["cell"]] = r["lo"], r["hi"], r["n"]
    return KdIndex(splits, low, high, settle(_packed(rows, box.select("cell", "n")), "packed"), counts)


def _alike(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order in which neighbours along the widest side follow each other, and equal points by id."""
    return np.lexsort((ids, *x.T[np.argsort(np.ptp(x, axis=0), kind="stable")]))


def _dealt(index: KdIndex, asks: DataFrame) -> DataFrame:
    """(qs, qxs, r, ids, xs): packed queries with the packed points of their cell.

    Tasks are as many as the pairs ask for; the queries of a crowded cell are cut into
    slices, and its points sent to each.
    """
    spark = asks.sparkSession
    asked = {r["cell"]: r["n"] for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
    pairs = {c: n * int(index.counts[c]) for c, n in asked.items()}
    known = [(c, n, max(1, min(-(-pairs[c] // CROWD), -(-n // PART)))) for c, n in asked.items()]
    known = spark.createDataFrame(known, "cell long, n long, slices int")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sum(pairs.values()) // PAIRS, MOST_TASKS))
    slices = F.broadcast(known.select("cell", "slices"))
    queries = _packed(asks, known.select("cell", "n"), "r").withColumnsRenamed({"ids": "qs", "xs": "qxs"}).join(slices, "cell")
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("qs"), F.col("slices")).cast("int")).drop("slices")
    points = index.packed.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return queries.repartition(tasks, "cell", "slice").join(points.repartition(tasks, "cell", "slice"), ["cell", "slice"])


def _met(index: KdIndex, asks: DataFrame, p: float, k: int | None, exclude_self: bool, strict: bool = False) -> DataFrame:
    """Queries (cell, id, x, r) with the points of their cell: (q, id, d) within r, the k nearest of each part.

    Without a ``k``, queries and points come in the order of their places: an answer is then
    the same stretch of points from query to query, which a columnar file holds in few bytes.
    """
    met = _dealt(index, asks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, many = [], 0
        for f in frames:
            for qs, qxs, r, ids, xs in zip(f["qs"], f["qxs"], f["r"], f["ids"], f["xs"]):
                qs, r, ids = np.frombuffer(qs, np.int64), np.frombuffer(r), np.frombuffer(ids, np.int64)
                x, y = np.frombuffer(qxs).reshape(len(qs), -1), np.frombuffer(xs).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable") if k is not None else _alike(y, ids)
                ids, y = ids[order], y[order]
                if k is None:
                    order = _alike(x, qs)
                    qs, x, r = qs[order], x[order], r[order]
                for a in range(0, len(qs), 64):
                    dist = norm(x[a : a + 64, None, :] - y[None, :, :], p)
                    near = dist < r[a : a + 64, None] if strict else dist <= r[a : a + 64, None]
                    if exclude_self:
                        near &= qs[a : a + 64, None] != ids[None, :]
                    if k is not None and len(ids) > k:
                        # Ids ascend, so a stable sort breaks ties by id.
                        best = np.argsort(np.where(near, dist, math.inf), axis=1, kind="stable")[:, :k]
                        chosen = np.zeros_like(near)
                        np.put_along_axis(chosen, best, True, 1)
                        near &= chosen
                    i, j = np.nonzero(near)
                    found.append((qs[a + i], ids[j], dist[i, j]))
                    many += len(i)
                    if many >= ROWS:
                        yield pd.DataFrame(dict(zip(("q", "id", "d"), map(np.concatenate, zip(*found)))))
                        found, many = [], 0
        if many:
            yield pd.DataFrame(dict(zip(("q", "id", "d"), map(np.concatenate, zip(*found)))))

    return met.select("qs", "qxs", "r", "ids", "xs").mapInPandas(run, "q long, id long, d double")


def _sent(index: KdIndex, queries: DataFrame, p: float, but_own: bool) -> DataFrame:
    """Queries (cell, id, x, r), once for each cell that their radius reaches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                at, cells = index.reached(np.stack(f["x"].to_list()), f["r"].to_numpy(float), p)
                if but_own:
                    other = cells != f["cell"].to_numpy()[at]
                    at, cells = at[other], cells[other]
                for a in range(0, len(at), ROWS):
                    yield f.iloc[at[a : a + ROWS]].assign(cell=cells[a : a + ROWS])[["cell", "id", "x", "r"]]

    index = KdIndex(index.splits, index.low, index.high, None)
    return queries.mapInPandas(run, "cell long, id long, x array<double>, r double")


def nearest(index: KdIndex, queries: DataFrame, id_col: str, vec_col: str, k: int, p: float = 2.0, exclude_self: bool = False) -> DataFrame:
    """(q, id, d, rank) of the k nearest points of every query; ties by id.  Queries are told apart by their ids."""
    asks = settle(_located(queries, id_col, vec_col, index.splits), "queries")
    ranked = Window.partitionBy("q").orderBy("d", "id")
    own = settle(_met(index, asks.withColumn("r", F.lit(math.inf)), p, k, exclude_self), "own")
    best = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    kth = best.groupBy("q").agg(F.when(F.count("*") == k, F.max("d")).otherwise(F.lit(math.inf)).alias("r"))
    wide = asks.join(kth.withColumnRenamed("q", "id"), "id", "left").select("cell", "id", "x", F.coalesce("r", F.lit(math.inf)).alias("r"))
    beyond = _met(index, settle(_sent(index, wide, p, True), "sent"), p, k, exclude_self)
    every = best.select("q", "id", "d").unionByName(beyond)
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def within(index: KdIndex, queries: DataFrame, id_col: str, vec_col: str, radius: float, p: float = 2.0, exclude_self: bool = False) -> DataFrame:
    """(q, id, d) of all points strictly within the radius of every query.

    Cells are as wide as the radius at most if they can be, so the number of cells that a
    query is sent to does not grow with the points.
    """
    index = index.coarser(radius)
    asks = _located(queries, id_col, vec_col, index.splits).withColumn("r", F.lit(float(radius)))
    return _met(index, settle(_sent(index, asks, p, False), "sent"), p, None, exclude_self, strict=True)

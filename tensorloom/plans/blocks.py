"""Contraction of two operands in dense blocks.

Coordinates are cut into tiles: the indices that both operands are summed over, those
of the left alone, those of the right alone, and those that both keep.  A tile is
one row with a packed array; tiles that share their part of the common indices meet
in groups of at most ``GROUP`` cubed, are multiplied by NumPy and summed inside the
group; then the groups' sums of a result tile meet.  A tile goes to each group that
needs it, so what is shuffled is n*m*k / (side * GROUP) numbers for each operand and
for the sums, not one row per scalar product.

Tiles suit dense operands; a sparse one whose share of elements is below ``DENSE``
stays with one row per element.  A sparse operand in tiles has zeros for what it
lacks, so there a missing zero times NaN is NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements along each side of a tile, at most.
SIDE = 256
#: Tiles along each side of a group: a task holds three times its square.
GROUP = 4
#: Scalar products below which rows are as good.
FEW = 250_000
#: Share of a tile's cells that must be taken for tiles to pay.
DENSE = 0.1


@dataclass
class Split:
    """The index names of a contraction by role, with their sizes."""

    kept: list[str]  # in both operands and the result
    left: list[str]
    right: list[str]
    summed: list[str]  # in both operands only
    sizes: dict[str, int]

    def size(self, names: list[str]) -> int:
        return math.prod(self.sizes[x] for x in names)

    @property
    def products(self) -> int:
        return math.prod(self.sizes.values())


def split(a: tuple[str, ...], b: tuple[str, ...], needed: set[str], sizes: dict[str, int]) -> Split | None:
    """Roles of the indices; none where an index is in one operand and not needed (it should be summed before)."""
    both = [x for x in a if x in b]
    left, right = [x for x in a if x not in b], [x for x in b if x not in a]
    if not set(left + right) <= needed:
        return None
    return Split([x for x in both if x in needed], left, right, [x for x in both if x not in needed], {x: sizes[x] for x in dict.fromkeys((*a, *b))})


def worth(s: Split) -> bool:
    """Whether dense operands are better off in tiles: matrices on both sides, and enough products to sum."""
    return min(s.size(s.left), s.size(s.right), s.size(s.summed)) > 1 and s.products >= FEW


def side(n: int, size: int) -> int:
    """Length of the tiles of an axis of ``n``: even, at most ``size``."""
    return -(-n // -(-n // size)) if n else 1


def linear(names: list[str], sizes: dict[str, int]) -> Column:
    out: Column = F.lit(0).cast("bigint")
    for x in names:
        out = out * sizes[x] + F.col(f"x_{x}")
    return out


def _pack(rows: int, cols: int, keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted cells (keys, r, c, v) -> one row (keys, filled, array) per tile; cells of one place are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        tile = np.zeros((rows, cols))

        def told() -> pa.RecordBatch:
            names = [f"k{k}" for k in range(keys)]
            return pa.record_batch([*[pa.array([k], pa.int64()) for k in here], pa.array([tile.tobytes()], pa.binary())], [*names, "tile"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
            r, c, v = (batch.column(keys + k).to_numpy(zero_copy_only=False) for k in range(3))
            starts = np.flatnonzero(np.r_[True, (ks[1:] != ks[:-1]).any(1)])
            for a, b in zip(starts, [*starts[1:], len(ks)]):
                key = tuple(int(x) for x in ks[a])
                if key != here:
                    if here is not None:
                        yield told()
                    here, tile = key, np.zeros((rows, cols))
                np.add.at(tile, (r[a:b], c[a:b]), v[a:b])
        if here is not None:
            yield told()

    return run


def tiles(df: DataFrame, s: Split, rows: list[str], cols: list[str], size: int) -> tuple[DataFrame, int, int]:
    """Coordinates x_* and v -> tiles (k0: kept, k1: tile row, k2: tile column, tile) with their sides."""
    nr, nc = side(s.size(rows), size), side(s.size(cols), size)
    at = df.select(linear(s.kept, s.sizes).alias("k0"), linear(rows, s.sizes).alias("_r"), linear(cols, s.sizes).alias("_c"), F.col("v").cast("double").alias("v"))
    cells = at.select(
        "k0", F.expr(f"_r div {nr}").alias("k1"), F.expr(f"_c div {nc}").alias("k2"), F.expr(f"cast(_r % {nr} as int)").alias("r"), F.expr(f"cast(_c % {nc} as int)").alias("c"), "v"
    )
    dealt = cells.repartition("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2")
    return dealt.mapInArrow(_pack(nr, nc, 3), "k0 long, k1 long, k2 long, tile binary"), nr, nc


def _multiply(n: int, k: int, m: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Left and right tiles of one group -> their products (k0, i, j, tile), summed over the group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by_q: dict[int, list] = {}
        for q, j, t in zip(right["q"].to_pylist(), right["j"].to_pylist(), right["tile"]):
            by_q.setdefault(q, []).append((j, np.frombuffer(t.as_buffer()).reshape(k, m)))
        sums: dict[tuple, np.ndarray] = {}
        for k0, i, q, t in zip(left["k0"].to_pylist(), left["i"].to_pylist(), left["q"].to_pylist(), left["tile"]):
            a = np.frombuffer(t.as_buffer()).reshape(n, k)
            for j, b in by_q.get(q, ()):
                product = a @ b
                if (k0, i, j) in sums:
                    sums[k0, i, j] += product
                else:
                    sums[k0, i, j] = product
        keys = [pa.array([key[x] for key in sums], pa.int64()) for x in range(3)]
        return pa.table([*keys, pa.array([t.tobytes() for t in sums.values()], pa.binary())], ["k0", "i", "j", "tile"])

    return run


def _sum(n: int, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles sorted by place -> cells (k0, i, j, r, c, v) of their sums, by the tile's arrays of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        total = np.zeros(n * m)

        def told() -> pa.RecordBatch:
            return pa.record_batch([*[pa.array([x], pa.int64()) for x in here], pa.array([total], pa.list_(pa.float64()))], ["k0", "i", "j", "vs"])

        for batch in batches:
            for key, t in zip(zip(*[batch.column(x).to_pylist() for x in range(3)]), batch.column(3)):
                if key != here:
                    if here is not None:
                        yield told()
                    here, total = key, np.zeros(n * m)
                total += np.frombuffer(t.as_buffer())
        if here is not None:
            yield told()

    return run


def unlinear(at: Column, names: list[str], sizes: dict[str, int]) -> list[Column]:
    out, stride = [], math.prod(sizes[x] for x in names)
    for x in names:
        stride //= max(sizes[x], 1)
        out.append((F.call_function("div", at, F.lit(max(stride, 1))) % max(sizes[x], 1)).alias(f"x_{x}"))
    return out


def contract(a: DataFrame, b: DataFrame, s: Split) -> DataFrame:
    """Coordinates x_* and v of the sum over ``s.summed``; zeros of the result are rows where a tile has others."""
    left, n, k = tiles(a, s, s.left, s.summed, SIDE)
    right, k, m = tiles(b, s, s.summed, s.right, SIDE)
    ni, nq, nj = (-(-s.size(names) // edge) for names, edge in ((s.left, n), (s.summed, k), (s.right, m)))
    group = lambda c: F.expr(f"{c} div {GROUP}")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((count - 1) // GROUP).cast("bigint")))
    left = left.select("k0", F.col("k1").alias("i"), F.col("k2").alias("q"), "tile", group("k2").alias("gq"), group("k1").alias("gi"), every(nj).alias("gj"))
    right = right.select("k0", F.col("k1").alias("q"), F.col("k2").alias("j"), "tile", group("k1").alias("gq"), every(ni).alias("gi"), group("k2").alias("gj"))
    by = ["k0", "gq", "gi", "gj"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_multiply(n, k, m), "k0 long, i long, j long, tile binary")
    sums = parts.repartition("k0", "i", "j").sortWithinPartitions("k0", "i", "j").mapInArrow(_sum(n, m), "k0 long, i long, j long, vs array<double>")
    cells = sums.select("k0", "i", "j", F.posexplode("vs").alias("_p", "v"))
    cells = cells.select("k0", (F.col("i") * n + F.expr(f"_p div {m}")).alias("_r"), (F.col("j") * m + F.expr(f"_p % {m}")).alias("_c"), "v")
    inside = cells.where((F.col("_r") < s.size(s.left)) & (F.col("_c") < s.size(s.right)))
    return inside.select(*unlinear(F.col("k0"), s.kept, s.sizes), *unlinear(F.col("_r"), s.left, s.sizes), *unlinear(F.col("_c"), s.right, s.sizes), "v")

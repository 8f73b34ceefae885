"""Linear systems, least squares and eigenpairs of matrices that no driver holds.

A matrix is a table (i, j, v) of its entries that are not zero, a vector a table
(i, v) without rows for zeros.  A step costs one product of matrix and vector; the
entries are dealt once and kept so, hence only vectors are shuffled: symmetric ones in
packed blocks (``plans.symmetric``), of which the lower triangle is read, others by
column and by row.  The driver sees a few scalars per step.  Each step is written to the shared folder, and
its table replaces that of two steps before: a lost executor costs one step at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.plans import symmetric
from tensorloom.plans.tables import Steps, settle


#: Entries of one row or column that are kept together; longer ones are cut by their other index.
HEAVY = 1 << 19


@dataclass
class Dealt:
    """Entries (i, j, v) spread and sorted by one index; ``heavy`` (_at, _parts) tells which values of it are cut, if any."""

    entries: DataFrame
    by: str
    heavy: DataFrame | None


@contextmanager
def _dealt(a: DataFrame, by: str) -> Iterator[Dealt]:
    """The entries of ``a``, summed up per cell and spread by one of their indices until the end of the scope.

    They are sorted once, so that a step merges them with a vector as they lie.
    """
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = a.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    longest = a.groupBy(F.col(by).alias("_at")).count().where(F.col("count") > HEAVY)
    heavy = settle(longest.select("_at", F.ceil(F.col("count") / HEAVY).cast("int").alias("_parts")), "heavy")
    keys = [by]
    if heavy.take(1):
        # At most one row for each HEAVY entries.
        known, other = F.broadcast(heavy), "j" if by == "i" else "i"
        cut = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")
        cells, keys = cells.join(known, cells[by] == F.col("_at"), "left").select("i", "j", "v", cut.alias("_s")), [by, "_s"]
    else:
        heavy = None
    kept = cells.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    try:
        yield Dealt(kept, by, heavy)
    finally:
        kept.unpersist()


def _times(a: Dealt, x: DataFrame, value: str, out: str) -> DataFrame:
    """(i, out): matrix times vector if ``a`` is dealt by j; by i, its transpose times the vector."""
    to, m = "i" if a.by == "j" else "j", a.entries
    v = x.select(F.col("i").alias("_at"), F.col(value).alias("_x"))
    on = m[a.by] == F.col("_at")
    if a.heavy is not None:
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_c")
        v = v.join(F.broadcast(a.heavy), "_at", "left").select("_at", "_x", copies)
        on = on & (m["_s"] == F.col("_c"))
    return m.join(v, on).groupBy(F.col(to).alias("i")).agg(F.sum(F.col("v") * F.col("_x")).alias(out))


def _scalars(df: DataFrame, *terms: Column) -> list[float]:
    return [float(x or 0.0) for x in df.agg(*[F.sum(t) for t in terms]).first()]


def conjugate_gradient(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, max_steps: int = 500) -> tuple[DataFrame, dict]:
    """(i, v) with a x = b for a symmetric positive definite ``a``, scaled by its diagonal.

    Ends when the residual's norm is at most ``tolerance`` times that of ``b``; the
    second result holds the steps and that ratio.  Indices that only ``b`` knows make
    the system singular: an error.
    """
    with symmetric.blocks(a) as m:
        diagonal = symmetric.diagonal(m)
        right = b.groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("r"))
        steps = Steps(a.sparkSession, "cg")
        start = diagonal.join(right, "i", "full").select("i", "d", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"))
        now = steps.put(start.withColumn("p", F.col("r") / F.col("d")))
        if now.where("d IS NULL OR d <= 0").take(1):
            raise ValueError("a positive diagonal is needed")
        rr, rz = _scalars(now, F.col("r") ** 2, F.col("r") ** 2 / F.col("d"))
        target, n = rr * tolerance**2, 0
        first = rr
        while rr > target:
            if n == max_steps:
                raise RuntimeError(f"no convergence in {n} steps: residual {math.sqrt(rr / first):.1e}")
            seen = steps.put(now.join(symmetric.times(m, now, F.col("p"), "q"), "i", "left").fillna(0.0, ["q"]))
            (pq,) = _scalars(seen, F.col("p") * F.col("q"))
            if pq <= 0:
                raise ValueError("the matrix is not positive definite")
            alpha = rz / pq
            r = F.col("r") - alpha * F.col("q")
            was, (rr, rz) = rz, _scalars(seen, r**2, r**2 / F.col("d"))
            now = seen.select("i", "d", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r / F.col("d") + rz / was * F.col("p")).alias("p"))
            n += 1
        out = steps.put(now.select("i", F.col("x").alias("v")))
        steps.keep_last()
        return out, {"steps": n, "residual": math.sqrt(rr / first) if first else 0.0}


def least_squares(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, max_steps: int = 500) -> tuple[DataFrame, dict]:
    """(j, v) of least norm among those that bring a x nearest to b: the pseudo-inverse times ``b``.

    Conjugate gradients on the normal equations without forming them: two products a
    step, and the condition of ``a``, not its square, in every stored number.  Ends
    when the gradient's norm is at most ``tolerance`` times its first.  The second
    result holds the steps, that ratio and the squared residual.
    """
    with _dealt(a, "j") as by_column, _dealt(a, "i") as by_row:
        rows, columns = Steps(a.sparkSession, "rows"), Steps(a.sparkSession, "columns")
        right = b.groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("r"))
        res = rows.put(by_row.entries.select("i").distinct().join(right, "i", "full").fillna(0.0, ["r"]))
        grad = _times(by_row, res, "r", "s")
        now = columns.put(by_row.entries.select(F.col("j").alias("i")).distinct().join(grad, "i", "left").fillna(0.0, ["s"]).select("i", F.lit(0.0).alias("x"), F.col("s").alias("p"), "s"))
        (ss,) = _scalars(now, F.col("s") ** 2)
        first, n = ss, 0
        while ss > first * tolerance**2:
            if n == max_steps:
                raise RuntimeError(f"no convergence in {n} steps: gradient {math.sqrt(ss / first):.1e}")
            seen = rows.put(res.join(_times(by_column, now, "p", "q"), "i", "left").fillna(0.0, ["q"]))
            (qq,) = _scalars(seen, F.col("q") ** 2)
            alpha = ss / qq
            res = rows.put(seen.select("i", (F.col("r") - alpha * F.col("q")).alias("r")))
            then = now.drop("s").join(_times(by_row, res, "r", "s"), "i", "left").fillna(0.0, ["s"])
            then = columns.put(then.withColumn("x", F.col("x") + alpha * F.col("p")))
            was, (ss,) = ss, _scalars(then, F.col("s") ** 2)
            now = then.withColumn("p", F.col("s") + ss / was * F.col("p"))
            n += 1
        out = columns.put(now.select(F.col("i").alias("j"), F.col("x").alias("v")))
        (left,) = _scalars(res, F.col("r") ** 2)
        rows.drop_all()
        columns.keep_last()
        return out, {"steps": n, "gradient": math.sqrt(ss / first) if first else 0.0, "residual": left}


def eigenpairs(
    a: DataFrame, k: int, width: int = 24, tolerance: float = 1e-8, restarts: int = 60, seed: int = 0, scale: DataFrame | None = None, start: DataFrame | None = None
) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` greatest eigenvalues of a symmetric ``a``, falling, and (i, e): each row's entries of their vectors.

    Lanczos with thick restarts: a basis of up to ``width`` vectors is an array per
    row; a step appends the product with the last one, made orthogonal to all (twice),
    and a restart keeps the best combinations.  Ends when the residual of each pair is
    at most ``tolerance`` times the greatest value met.  A vector's greatest entry
    (by size, ties by index) is positive.  If ``a`` has fewer rows than ``k``, all are given.

    ``scale`` (i, v), one row for each index, multiplies rows and columns of ``a``.  The
    first vector is random, or ``start`` (i, v): of a value met more than once, the vector
    found is the one nearest to it.
    """
    with symmetric.blocks(a) as m:
        nodes = symmetric.indices(m)
        nodes = nodes.withColumn("s", F.lit(1.0)) if scale is None else nodes.join(scale.select("i", F.col("v").cast("double").alias("s")), "i")
        if start is None:
            drawn = nodes.withColumn("w", F.xxhash64("i", F.lit(seed)) / float(2**63))
        else:
            drawn = nodes.join(start.select("i", F.col("v").cast("double").alias("w")), "i", "left").fillna(0.0, ["w"])
        steps = Steps(a.sparkSession, "lanczos")
        drawn = steps.put(drawn)
        size, square = drawn.agg(F.count("*"), F.sum(F.col("w") ** 2)).first()
        if not size:
            return np.zeros(0), drawn.select("i", F.array().cast("array<double>").alias("e"))
        k = min(k, size)
        width = min(max(width, 2 * k + 2), size)
        if not square:
            raise ValueError("the first vector is zero")
        basis = steps.put(drawn.select("i", "s", F.array(F.col("w") / math.sqrt(square)).alias("q")))
        t, have = np.zeros((width, width)), 1
        for _ in range(restarts * width):
            # Product with the newest vector, and its part along each vector so far.
            product = symmetric.times(m, basis, F.element_at("q", -1) * F.col("s"), "w")
            seen = steps.put(basis.join(product, "i", "left").fillna(0.0, ["w"]).withColumn("w", F.col("w") * F.col("s")))
            h = np.zeros(have)
            for _ in range(2):
                part = np.array(_scalars(seen, *[F.get("q", z) * F.col("w") for z in range(have)]))
                h += part
                seen = seen.withColumn("w", F.col("w") - F.aggregate(F.zip_with("q", F.array(*map(F.lit, part.tolist())), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))
            t[have - 1, :have] = t[:have, have - 1] = h
            beta = math.sqrt(_scalars(seen, F.col("w") ** 2)[0])
            values, vectors = np.linalg.eigh(t[:have, :have])
            order = np.argsort(-values)
            values, vectors = values[order], vectors[:, order]
            scale = max(abs(values).max(), 1e-300)
            done = have == size or beta <= 1e-14 * scale
            if done or (have >= k and np.all(beta * abs(vectors[-1, :k]) <= tolerance * scale)):
                return values[:k], _signed(steps, seen, vectors[:, :k])
            if have == width:
                have = k + (width - k) // 2
                seen = seen.select("i", "s", _mixed(vectors[:, :have]).alias("q"), "w")
                t = np.zeros((width, width))
                t[range(have), range(have)] = values[:have]
            basis = steps.put(seen.select("i", "s", F.concat("q", F.array(F.col("w") / beta)).alias("q")))
            have += 1
        raise RuntimeError(f"no convergence in {restarts} restarts")


def _mixed(weights: np.ndarray) -> Column:
    """Each row's array times a small matrix."""
    rows = F.array(*[F.array(*map(F.lit, column.tolist())) for column in weights.T])
    return F.transform(rows, lambda w: F.aggregate(F.zip_with("q", w, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))


def _signed(steps: Steps, seen: DataFrame, weights: np.ndarray) -> DataFrame:
    out = steps.put(seen.select("i", _mixed(weights).alias("e")))
    n = weights.shape[1]
    top = out.agg(*[F.max(F.struct(F.abs(F.get("e", z)), -F.col("i"), F.get("e", z).alias("v")))["v"].alias(f"v{z}") for z in range(n)]).first()
    signs = F.array(*[F.lit(-1.0 if (x or 0.0) < 0 else 1.0) for x in top])
    out = steps.put(out.select("i", F.zip_with("e", signs, lambda x, y: x * y).alias("e")))
    steps.keep_last()
    return out

"""TensorFrame: an n-dimensional array as a DataFrame of coordinates.

One row per element: ``i0, i1, ...`` (bigint) and the value ``v``; the shape is
kept on the driver.  A frame is immutable: what would change an array in place
returns a new frame.  A frame with ``sparse`` set may lack rows for zeros; then
only sums and contractions are defined, and :meth:`dense` adds the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import elementwise as fx
from tensorloom.plans import convolve as long
from tensorloom.plans import einsum as plan
from tensorloom.plans import scan, select
from tensorloom.plans.tables import numbered, ranked

#: Cells of a generated frame that a task makes, about.
CELLS = 1 << 23
#: Values of a kernel that is sent to all tasks; a longer one goes by blocks.
SHORT_KERNEL = 256


class Span:
    """``first`` to ``last``, both included, by ``step``; negative bounds count from the end (-1 is the last)."""

    def __init__(self, first: int | None = None, last: int | None = None, step: int = 1):
        if step == 0:
            raise ValueError("a step of 0")
        self.first, self.last, self.step = first, last, step

    def resolve(self, n: int) -> tuple[int, int, int]:
        a = (0 if self.step > 0 else n - 1) if self.first is None else self.first + n * (self.first < 0)
        b = (n - 1 if self.step > 0 else 0) if self.last is None else self.last + n * (self.last < 0)
        if not (0 <= a < n and 0 <= b < n):
            raise IndexError(f"{self.first}..{self.last} of an axis of {n}")
        if (b - a) * self.step < 0:
            raise IndexError("the step leads away from the end")
        return a, self.step, abs((b - a) // self.step if self.step > 0 else (a - b) // -self.step) + 1


def _coordinates(shape: Sequence[int], linear: Column) -> list[Column]:
    out, stride = [], math.prod(shape)
    for n in shape:
        stride //= max(n, 1)
        out.append(F.call_function("div", linear, F.lit(max(stride, 1))) % max(n, 1))
    return out


class TensorFrame:
    def __init__(self, df: DataFrame, shape: Sequence[int], sparse: bool = False):
        self.df, self.shape, self.sparse = df, tuple(int(n) for n in shape), sparse

    # -- construction ---------------------------------------------------------------

    @staticmethod
    def index(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
        """All coordinates of ``shape``."""
        at = _coordinates(shape, F.col("id"))
        size = math.prod(shape)
        parts = max(spark.sparkContext.defaultParallelism, -(-size // CELLS))
        return spark.range(0, size, 1, parts).select(*[c.alias(f"i{k}") for k, c in enumerate(at)])

    @classmethod
    def generate(cls, spark: SparkSession, shape: Sequence[int], f: Callable[..., Column]) -> TensorFrame:
        """Values as a function of the coordinate columns."""
        at = [F.col(f"i{k}") for k in range(len(shape))]
        return cls(cls.index(spark, shape).withColumn("v", f(*at)), shape)

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value) -> TensorFrame:
        return cls.generate(spark, shape, lambda *_: F.lit(value))

    @classmethod
    def from_nested(cls, spark: SparkSession, data) -> TensorFrame:
        """From nested lists or a NumPy array on the driver; ragged input is an error."""
        a = np.array(data)
        if a.dtype == object:
            raise IndexError("ragged input")
        a = a.reshape(1) if a.ndim == 0 else a
        kind = {"i": "bigint", "u": "bigint", "b": "boolean", "f": "double"}.get(a.dtype.kind, "string")
        cols = ", ".join(f"i{k} bigint" for k in range(a.ndim))
        rows = [(*map(int, at), x) for at, x in zip(np.ndindex(*a.shape), a.ravel().tolist(), strict=True)]
        return cls(spark.createDataFrame(rows, f"{cols}, v {kind}"), a.shape)

    @classmethod
    def from_arrow(cls, spark: SparkSession, a: np.ndarray) -> TensorFrame:
        """From an array on the driver, handed over as Arrow columns without a Python object per value."""
        import pyarrow as pa

        at = np.unravel_index(np.arange(a.size), a.shape)
        cols = {f"i{k}": pa.array(x.astype(np.int64)) for k, x in enumerate(at)}
        return cls(spark.createDataFrame(pa.table({**cols, "v": pa.array(np.ascontiguousarray(a).ravel())})), a.shape)

    @classmethod
    def from_wide(cls, df: DataFrame, row: str, columns: Sequence[str], n: int) -> TensorFrame:
        """Rows are numbered by the dense id ``row``; columns become axis 1."""
        cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("i1", "v")
        return cls(df.select(F.col(row).cast("bigint").alias("i0"), cells).withColumn("i1", F.col("i1").cast("bigint")), (n, len(columns)))

    @classmethod
    def from_arrays(cls, df: DataFrame, row: str, column: str, shape: Sequence[int]) -> TensorFrame:
        out = df.select(F.col(row).cast("bigint").alias("i0"), F.posexplode(column).alias("i1", "v"))
        return cls(out.select("i0", F.col("i1").cast("bigint").alias("i1"), F.col("v").cast("double").alias("v")), shape)

    # -- basics -----------------------------------------------------------------------

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    def _axis(self, axis: int) -> int:
        k = axis + self.rank if axis < 0 else axis
        if not 0 <= k < self.rank:
            raise IndexError(f"axis {axis} of rank {self.rank}")
        return k

    def linear(self) -> Column:
        """Row-major position."""
        out: Column = F.lit(0).cast("bigint")
        for k, n in enumerate(self.shape):
            out = out * n + F.col(f"i{k}")
        return out

    def dense(self) -> TensorFrame:
        if not self.sparse:
            return self
        full = self.index(self.df.sparkSession, self.shape).join(self.df, self.axes, "left")
        return TensorFrame(full.withColumn("v", F.coalesce("v", F.lit(0))), self.shape)

    def _same(self, df: DataFrame) -> TensorFrame:
        return TensorFrame(df, self.shape, self.sparse)

    def collect(self) -> np.ndarray:
        """The array on the driver."""
        rows = self.dense().df.select(*self.axes, "v").toPandas()
        if not len(rows):
            return np.empty(self.shape)
        out = np.empty(self.shape, dtype=rows["v"].to_numpy().dtype)
        out[tuple(rows[c].to_numpy() for c in self.axes)] = rows["v"].to_numpy()
        return out

    def items(self):
        """(coordinates, value) in row-major order, fetched partition by partition."""
        for r in self.dense().df.select(*self.axes, "v").orderBy(*self.axes).toLocalIterator():
            yield tuple(r[:-1]), r[-1]

    def distinct_values(self) -> DataFrame:
        return self.df.select("v").distinct()

    def apply_axis(self, f: Callable[[np.ndarray], np.ndarray], axis: int) -> TensorFrame:
        """``f`` of each vector along an axis, which keeps its length; a vector must fit one task."""
        k = self._axis(axis)
        axes = self.axes
        others = [c for c in axes if c != f"i{k}"]

        def run(pdf):
            pdf = pdf.sort_values(f"i{k}")
            return pdf.assign(v=np.asarray(f(pdf["v"].to_numpy()), dtype=float))[[*axes, "v"]]

        schema = ", ".join(f"{c} bigint" for c in self.axes) + ", v double"
        df = self.dense().df.select(*self.axes, F.col("v").cast("double").alias("v"))
        return TensorFrame(df.groupBy(*others).applyInPandas(run, schema), self.shape)

    def item(self):
        if self.size != 1:
            raise IndexError("item() needs one element")
        return self.df.first()["v"]

    def pretty(self, precision: int = 6) -> str:
        kind = dict(self.df.dtypes)["v"]
        return f"Tensor[{kind}] of shape {list(self.shape)}\n" + np.array2string(self.collect(), precision=precision)

    def cast(self, kind: str) -> TensorFrame:
        return self._same(self.df.withColumn("v", F.col("v").cast(kind)))

    def equals(self, other: TensorFrame) -> bool:
        """Same shape and all elements equal."""
        if self.shape != other.shape:
            return False
        a, b = self.dense().df, other.dense().df.withColumnRenamed("v", "w")
        off = a.join(b, self.axes, "full").where(~F.coalesce(fx.compare("==", F.col("v"), F.col("w"), "double" in dict(a.dtypes)["v"]), F.lit(False)))
        return not off.take(1)

    def precedes(self, other: TensorFrame) -> bool:
        """Whether this frame comes first: by the first elements in row-major order that differ, else by size."""
        a = self.dense().df.select(self.linear().alias("_p"), "v")
        b = other.dense().df.select(other.linear().alias("_p"), F.col("v").alias("w"))
        off = a.join(b, "_p").where("v <> w").agg(F.min(F.struct("_p", (F.col("v") < F.col("w")).alias("less"))).alias("m")).first()["m"]
        return self.size < other.size if off is None else off["less"]

    # -- element-wise --------------------------------------------------------------------

    def map(self, f: str | Callable[[Column], Column]) -> TensorFrame:
        f = fx.UNIVERSAL[f] if isinstance(f, str) else f
        return self._same(self.df.withColumn("v", f(F.col("v"))))

    def map2(self, other: TensorFrame | float, f: Callable[[Column, Column], Column]) -> TensorFrame:
        """``f`` of both, broadcasting axes of size one."""
        if not isinstance(other, TensorFrame):
            return self.map(lambda v: f(v, F.lit(other)))
        rank = max(self.rank, other.rank)
        a = self.reshape((1,) * (rank - self.rank) + self.shape) if self.rank < rank else self
        b = other.reshape((1,) * (rank - other.rank) + other.shape) if other.rank < rank else other
        if any(m != n and 1 not in (m, n) for m, n in zip(a.shape, b.shape, strict=True)):
            raise ValueError(f"shapes {self.shape} and {other.shape} do not broadcast")
        shape = tuple(max(m, n) if 0 not in (m, n) else 0 for m, n in zip(a.shape, b.shape, strict=True))
        # Only axes that both have are joined on; a stretched axis takes its index from the other side.
        on = [k for k in range(rank) if a.shape[k] == b.shape[k]]
        right = b.df.select(*[F.col(f"i{k}").alias(f"j{k}") for k in range(rank)], F.col("v").alias("w"))
        cond = [F.col(f"i{k}") == F.col(f"j{k}") for k in on]
        small = math.prod(b.shape) <= 100_000
        both = a.df.join(F.broadcast(right) if small else right, cond) if cond else a.df.crossJoin(F.broadcast(right) if small else right)
        at = [(F.col(f"i{k}") if a.shape[k] == shape[k] else F.col(f"j{k}")).alias(f"i{k}") for k in range(rank)]
        return TensorFrame(both.select(*at, f(F.col("v"), F.col("w")).alias("v")), shape)

    def __add__(self, o):
        return self.map2(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self.map2(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self.map2(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self.map2(o, fx.divide)

    def __pow__(self, o):
        return self.map2(o, fx.power)

    def __mod__(self, o):
        return self.map2(o, fx.mod)

    def __neg__(self):
        return self.map(fx.negate)

    def compare(self, op: str, other) -> TensorFrame:
        floating = dict(self.df.dtypes)["v"] in ("double", "float")
        return self.map2(other, lambda a, b: fx.compare(op, a, b, floating))

    # -- slices and selection -------------------------------------------------------------

    def __getitem__(self, keys) -> TensorFrame:
        """Integers, :class:`Span`, Python slices, ``...`` and full slices; every axis is kept."""
        df, shape = self.df, []
        for k, key in enumerate(self._keys(keys)):
            a, step, n = self._span(key, self.shape[k]).resolve(self.shape[k])
            if (a, step, n) != (0, 1, self.shape[k]):
                i = F.col(f"i{k}")
                at = (i - a) if step > 0 else (a - i)
                s = abs(step)
                df = df.where((at >= 0) & (at <= (n - 1) * s) & (at % s == 0)).withColumn(f"i{k}", F.call_function("div", at, F.lit(s)))
            shape.append(n)
        return TensorFrame(df, shape, self.sparse)

    def _keys(self, keys) -> list:
        keys = list(keys) if isinstance(keys, tuple) else [keys]
        if Ellipsis in keys:
            at = keys.index(Ellipsis)
            keys[at : at + 1] = [Span()] * (self.rank - len(keys) + 1)
        if len(keys) > self.rank:
            raise IndexError("too many indices")
        return keys + [Span()] * (self.rank - len(keys))

    @staticmethod
    def _span(key, n: int) -> Span:
        if isinstance(key, Span):
            return key
        if isinstance(key, slice):
            a, b, step = key.indices(n)
            count = len(range(a, b, step))
            if not count:
                raise IndexError("an empty slice")
            return Span(a, a + (count - 1) * step, step)
        return Span(key, key)

    def at(self, *keys) -> TensorFrame:
        """Slice, then drop the axes that were indexed by integers."""
        out, keys = self[keys], self._keys(keys)
        for k in reversed(range(self.rank)):
            if isinstance(keys[k], int) and out.rank > 1:
                out = out.squeeze(k)
        return out

    def put(self, keys, value) -> TensorFrame:
        """A copy with the slice set to a scalar or a frame of the slice's shape."""
        spans = [self._span(key, self.shape[k]).resolve(self.shape[k]) for k, key in enumerate(self._keys(keys))]
        inside, new = F.lit(True), []
        for k, (a, step, n) in enumerate(spans):
            at = F.col(f"i{k}") - a if step > 0 else a - F.col(f"i{k}")
            inside = inside & (at >= 0) & (at <= (n - 1) * abs(step)) & (at % abs(step) == 0)
            new.append((a, step))
        if not isinstance(value, TensorFrame):
            return self._same(self.df.withColumn("v", F.when(inside, F.lit(value)).otherwise(F.col("v"))))
        want = tuple(n for _, _, n in spans)
        if value.size != math.prod(want):
            raise IndexError(f"a value of shape {value.shape} for a slice of shape {want}")
        value = value if value.shape == want else value.reshape(want)
        moved = value.df.select(*[(F.lit(a) + F.col(f"i{k}") * step).alias(f"i{k}") for k, (a, step) in enumerate(new)], F.col("v").alias("_new"), F.lit(True).alias("_set"))
        out = self.df.join(moved, self.axes, "left")
        return self._same(out.withColumn("v", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("v"))).drop("_new", "_set"))

    def index_select(self, axis: int, indices: Sequence[int]) -> TensorFrame:
        """Gathers by position; order and repeats are kept."""
        k, spark = self._axis(axis), self.df.sparkSession
        n = self.shape[k]
        if any(not -n <= i < n for i in indices):
            raise IndexError("index out of range")
        rows = spark.createDataFrame([(p, i % n) for p, i in enumerate(indices)], "_p bigint, _i bigint")
        # As long as the list that the caller passed.
        out = self.df.join(F.broadcast(rows), F.col(f"i{k}") == F.col("_i")).withColumn(f"i{k}", F.col("_p")).drop("_p", "_i")
        return TensorFrame(out, self.shape[:k] + (len(indices),) + self.shape[k + 1 :], self.sparse)

    def masked_select(self, mask: TensorFrame | Callable[[Column], Column]) -> TensorFrame:
        """Elements under the mask, in row-major order, as rank 1."""
        if callable(mask):
            kept = self.df.where(mask(F.col("v")))
        else:
            kept = self.df.join(mask.df.where("v").drop("v"), self.axes, "left_semi")
        out = numbered(kept.select(self.linear().alias("_l"), "v"), F.col("_l"), self.size, "i0").select("i0", "v")
        return TensorFrame(out, (out.count(),))

    def masked_axis_select(self, mask: TensorFrame, axis: int) -> TensorFrame:
        """Slices along ``axis`` under a mask of rank 1, numbered anew."""
        k = self._axis(axis)
        keep = numbered(mask.df.where("v").select(F.col(mask.axes[-1] if mask.rank == 1 else f"i{k}").alias("_i")), F.col("_i"), self.shape[k], "_p")
        out = self.df.join(keep, F.col(f"i{k}") == F.col("_i")).withColumn(f"i{k}", F.col("_p")).drop("_p", "_i")
        return TensorFrame(out, self.shape[:k] + (keep.count(),) + self.shape[k + 1 :], self.sparse)

    def masked_fill(self, mask: TensorFrame | Callable[[Column], Column], value) -> TensorFrame:
        """A scalar under the mask, or the values of a sequence in row-major order of the mask."""
        if callable(mask):
            cond, df = mask(F.col("v")), self.df
        else:
            df = self.df.join(mask.df.select(*self.axes, F.col("v").alias("_m")), self.axes)
            cond = F.col("_m")
        if not isinstance(value, (list, tuple, np.ndarray)):
            return self._same(df.withColumn("v", F.when(cond, F.lit(value)).otherwise(F.col("v"))).select(*self.axes, "v"))
        spark = self.df.sparkSession
        hit = numbered(df.where(cond).select(*self.axes, self.linear().alias("_l")), F.col("_l"), self.size, "_p").drop("_l")
        kind = dict(self.df.dtypes)["v"]
        vals = spark.createDataFrame([(p, x) for p, x in enumerate(np.asarray(value).tolist())], f"_p bigint, _new {kind}")
        if hit.count() > len(value):
            raise ValueError("fewer values than elements under the mask")
        new = hit.join(F.broadcast(vals), "_p").drop("_p").withColumn("_set", F.lit(True))
        out = self.df.join(new, self.axes, "left")
        return self._same(out.withColumn("v", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("v"))).select(*self.axes, "v"))

    def masked_axis_fill(self, mask: TensorFrame, axis: int, value) -> TensorFrame:
        k = self._axis(axis)
        m = mask.df.where("v").select(F.col(mask.axes[0]).alias(f"i{k}"), F.lit(True).alias("_m"))
        return self._same(self.df.join(m, f"i{k}", "left").withColumn("v", F.when(F.col("_m"), F.lit(value)).otherwise(F.col("v"))).select(*self.axes, "v"))

    def index_fill(self, axis: int, indices: Sequence[int], values) -> TensorFrame:
        k, n = self._axis(axis), self.shape[self._axis(axis)]
        vals = list(values) if isinstance(values, (list, tuple)) else [values] * len(indices)
        if len(vals) != len(indices):
            raise ValueError("as many values as indices are needed")
        rows = self.df.sparkSession.createDataFrame([(i % n, v) for i, v in zip(indices, vals, strict=True)], f"i{k} bigint, _new {dict(self.df.dtypes)['v']}")
        return self._same(self.df.join(F.broadcast(rows), f"i{k}", "left").withColumn("v", F.coalesce("_new", "v")).select(*self.axes, "v"))

    def nonzero(self) -> TensorFrame:
        """Coordinates of non-zero elements as a matrix [rank, n]."""
        hit = numbered(self.df.where(F.col("v").cast("double") != 0).withColumn("_l", self.linear()), F.col("_l"), self.size, "_p")
        cells = F.posexplode(F.array(*self.axes)).alias("a", "x")
        out = hit.select("_p", cells).select(F.col("a").cast("bigint").alias("i0"), F.col("_p").alias("i1"), F.col("x").alias("v"))
        return TensorFrame(out, (self.rank, hit.count()))

    def ismember(self, other: TensorFrame) -> TensorFrame:
        known = other.df.select(F.col("v").alias("_w")).distinct()
        out = self.df.join(known, F.col("v") == F.col("_w"), "left").withColumn("v", F.col("_w").isNotNull()).drop("_w")
        return self._same(out)

    # -- shape -------------------------------------------------------------------------------

    def permute(self, *axes: int) -> TensorFrame:
        if sorted(axes) != list(range(self.rank)):
            raise ValueError("not a permutation of the axes")
        return TensorFrame(self.df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(axes)], "v"), [self.shape[a] for a in axes], self.sparse)

    def transpose(self) -> TensorFrame:
        return self.permute(*reversed(range(self.rank)))

    def moveaxis(self, source: int, target: int) -> TensorFrame:
        order = [k for k in range(self.rank) if k != self._axis(source)]
        order.insert(self._axis(target), self._axis(source))
        return self.permute(*order)

    def reshape(self, shape: Sequence[int]) -> TensorFrame:
        """Row-major; one size may be -1."""
        shape = list(shape)
        if shape.count(-1) > 1:
            raise ValueError("only one size may be inferred")
        if -1 in shape:
            rest = -math.prod(shape)
            if not rest or self.size % rest:
                raise ValueError(f"{self.shape} cannot become {shape}")
            shape[shape.index(-1)] = self.size // rest
        if math.prod(shape) != self.size:
            raise ValueError(f"{self.shape} cannot become {shape}")
        at = _coordinates(shape, F.col("_l"))
        return TensorFrame(self.df.select(self.linear().alias("_l"), "v").select(*[c.alias(f"i{k}") for k, c in enumerate(at)], "v"), shape, self.sparse)

    def flatten(self) -> TensorFrame:
        return self.reshape((self.size,))

    def squeeze(self, axis: int | None = None) -> TensorFrame:
        """Drop axes of size one, or one of them; rank 1 stays."""
        gone = [k for k in range(self.rank) if self.shape[k] == 1] if axis is None else [self._axis(axis)]
        if any(self.shape[k] != 1 for k in gone):
            raise ValueError("only axes of size one can go")
        keep = [k for k in range(self.rank) if k not in gone] or [0]
        return TensorFrame(self.df.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(keep)], "v"), [self.shape[k] for k in keep], self.sparse)

    def unsqueeze(self, axis: int) -> TensorFrame:
        at = [F.col(c) for c in self.axes]
        at.insert(axis, F.lit(0).cast("bigint"))
        return TensorFrame(self.df.select(*[c.alias(f"i{k}") for k, c in enumerate(at)], "v"), (*self.shape[:axis], 1, *self.shape[axis:]), self.sparse)

    def broadcast_to(self, shape: Sequence[int]) -> TensorFrame:
        if len(shape) != self.rank or any(m not in (1, n) for m, n in zip(self.shape, shape, strict=True)):
            raise ValueError(f"{self.shape} does not stretch to {tuple(shape)}")
        df = self.df
        for k, (m, n) in enumerate(zip(self.shape, shape, strict=True)):
            if m != n:
                df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        return TensorFrame(df, shape, self.sparse)

    @staticmethod
    def concat(parts: Sequence[TensorFrame], axis: int) -> TensorFrame:
        k = parts[0]._axis(axis)
        if any(p.rank != parts[0].rank or any(a != b for x, (a, b) in enumerate(zip(p.shape, parts[0].shape, strict=True)) if x != k) for p in parts):
            raise ValueError("all sizes but that of the axis must agree")
        at, out = 0, []
        for p in parts:
            out.append(p.df.select(*[(F.col(c) + at if c == f"i{k}" else F.col(c)).alias(c) for c in p.axes], "v"))
            at += p.shape[k]
        return TensorFrame(reduce(DataFrame.unionByName, out), parts[0].shape[:k] + (at,) + parts[0].shape[k + 1 :], any(p.sparse for p in parts))

    @staticmethod
    def stack(parts: Sequence[TensorFrame], axis: int = 0) -> TensorFrame:
        return TensorFrame.concat([p.unsqueeze(axis) for p in parts], axis)

    def append(self, values: TensorFrame) -> TensorFrame:
        if self.rank != 1 or values.rank != 1:
            raise ValueError("append is for rank 1")
        return TensorFrame.concat([self, values], 0)

    def split(self, size: int, axis: int = 0) -> list[TensorFrame]:
        k = self._axis(axis)
        return [self[tuple([Span()] * k + [Span(a, min(a + size, self.shape[k]) - 1)])] for a in range(0, self.shape[k], size)]

    def chunk_labels(self, n: int, axis: int = 0) -> DataFrame:
        """The rows with the number of the chunk each falls in: the first sizes are one larger if it does not divide."""
        k = self._axis(axis)
        size, extra = divmod(self.shape[k], n)
        i = F.col(f"i{k}")
        edge = extra * (size + 1)
        label = F.when(i < edge, F.call_function("div", i, F.lit(size + 1))).otherwise(F.call_function("div", i - edge, F.lit(max(size, 1))) + extra)
        return self.df.withColumn("chunk", label)

    def chunk(self, n: int, axis: int = 0) -> list[TensorFrame]:
        k = self._axis(axis)
        size, extra = divmod(self.shape[k], n)
        out, at = [], 0
        for c in range(n):
            m = size + (c < extra)
            if m:
                out.append(self[tuple([Span()] * k + [Span(at, at + m - 1)])])
            at += m
        return out

    def roll(self, shift: int, axis: int | None = None) -> TensorFrame:
        if axis is None:
            flat = self.reshape((self.size,)).roll(shift, 0)
            return flat.reshape(self.shape)
        k = self._axis(axis)
        return self._same(self.df.withColumn(f"i{k}", F.pmod(F.col(f"i{k}") + shift, F.lit(self.shape[k]))))

    def repeat_values(self, times: int, axis: int) -> TensorFrame:
        k = self._axis(axis)
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))
        out = self.df.withColumn("_r", copies).withColumn(f"i{k}", F.col(f"i{k}") * times + F.col("_r")).drop("_r")
        return TensorFrame(out, self.shape[:k] + (self.shape[k] * times,) + self.shape[k + 1 :], self.sparse)

    def tile(self, *times: int) -> TensorFrame:
        df = self.df
        for k, t in enumerate(times):
            if t != 1:
                df = df.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(t - 1).cast("bigint")))).withColumn(f"i{k}", F.col(f"i{k}") + F.col("_r") * self.shape[k]).drop("_r")
        return TensorFrame(df, [n * t for n, t in zip(self.shape, times, strict=True)], self.sparse)

    def upsample(self, factor: int, axis: int = -1, phase: int = 0) -> TensorFrame:
        """``factor - 1`` zeros between values; the first value comes after ``phase`` zeros."""
        k = self._axis(axis)
        cells = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(factor - 1).cast("bigint")))
        out = self.df.withColumn("_r", cells).withColumn("v", F.when(F.col("_r") == phase, F.col("v")).otherwise(F.lit(0))).withColumn(f"i{k}", F.col(f"i{k}") * factor + F.col("_r")).drop("_r")
        return TensorFrame(out, self.shape[:k] + (self.shape[k] * factor,) + self.shape[k + 1 :])

    # -- reductions -----------------------------------------------------------------------------

    def reduce(self, f: Callable[[Column], Column], axis: int | None = None) -> TensorFrame:
        """An aggregate of all values, or along an axis, which stays with size one."""
        if axis is None:
            return TensorFrame(self.df.agg(f(F.col("v")).alias("v")).select(F.lit(0).cast("bigint").alias("i0"), "v"), (1,))
        k = self._axis(axis)
        by = [c for c in self.axes if c != f"i{k}"]
        out = self.df.groupBy(*by).agg(f(F.col("v")).alias("v")) if by else self.df.agg(f(F.col("v")).alias("v"))
        return TensorFrame(out.withColumn(f"i{k}", F.lit(0).cast("bigint")).select(*self.axes, "v"), self.shape[:k] + (1,) + self.shape[k + 1 :])

    def sum(self, axis: int | None = None) -> TensorFrame:
        return self.reduce(F.sum, axis)

    def product(self, axis: int | None = None) -> TensorFrame:
        return self.reduce(F.product, axis)

    def mean(self, axis: int | None = None) -> TensorFrame:
        """Of integers: truncated."""
        if dict(self.df.dtypes)["v"] in ("bigint", "int", "smallint", "tinyint"):
            return self.dense().reduce(lambda v: F.call_function("div", F.sum(v), F.count(v)), axis)
        return self.dense().reduce(F.avg, axis)

    def min(self, axis: int | None = None) -> TensorFrame:
        return self.dense().reduce(F.min, axis)

    def max(self, axis: int | None = None) -> TensorFrame:
        return self.dense().reduce(F.max, axis)

    def variance(self, axis: int | None = None) -> TensorFrame:
        """With n - 1; NaN for one value."""
        return self.dense().reduce(lambda v: F.coalesce(F.var_samp(v), F.lit(fx.NAN)), axis)

    def std(self, axis: int | None = None) -> TensorFrame:
        return self.dense().reduce(lambda v: F.coalesce(F.stddev_samp(v), F.lit(fx.NAN)), axis)

    def argmax(self, axis: int) -> tuple[TensorFrame, TensorFrame]:
        """Position of the first largest value along the axis, and the value."""
        k = F.col(f"i{self._axis(axis)}")
        best = self.dense().reduce(lambda v: F.max(F.struct(v.alias("v"), (-k).alias("p"))), axis)
        return best.map(lambda b: -b["p"]), best.map(lambda b: b["v"])

    def argmin(self, axis: int) -> tuple[TensorFrame, TensorFrame]:
        k = F.col(f"i{self._axis(axis)}")
        best = self.dense().reduce(lambda v: F.min(F.struct(v.alias("v"), k.alias("p"))), axis)
        return best.map(lambda b: b["p"]), best.map(lambda b: b["v"])

    def percentile(self, p: int, axis: int | None = None) -> TensorFrame:
        """Linear between neighbours; 0.0 of nothing."""
        share = min(max(p, 0), 100) / 100
        k = self._axis(axis) if axis is not None else 0
        if (self.size if axis is None else self.shape[k]) <= select.FEW:
            return self.dense().reduce(lambda v: F.coalesce(F.percentile(v, share), F.lit(0.0)), axis)
        by = [] if axis is None else [c for c in self.axes if c != f"i{k}"]
        found = select.quantiles(self.dense().df, by, "v", [share], ["v"])
        zero = F.lit(0).cast("bigint")
        if axis is None:
            return TensorFrame(found.select(zero.alias("i0"), "v"), (1,))
        return TensorFrame(found.withColumn(f"i{k}", zero).select(*self.axes, "v"), self.shape[:k] + (1,) + self.shape[k + 1 :])

    def median(self, axis: int | None = None) -> TensorFrame:
        return self.percentile(50, axis)

    def iqr(self, axis: int | None = None) -> TensorFrame:
        return self.percentile(75, axis) - self.percentile(25, axis)

    def all(self, axis: int | None = None) -> TensorFrame:
        return self.dense().reduce(lambda v: F.coalesce(F.bool_and(v.cast("double") != 0), F.lit(True)), axis)

    def any(self, axis: int | None = None) -> TensorFrame:
        return self.reduce(lambda v: F.coalesce(F.bool_or(v.cast("double") != 0), F.lit(False)), axis)

    def fold(self, start, f: Callable[[Column, Column], Column], axis: int) -> TensorFrame:
        """An ordered fold along a short axis: its values must fit one row."""
        k = self._axis(axis)
        row = F.transform(F.array_sort(F.collect_list(F.struct(f"i{k}", "v"))), lambda s: s["v"])
        kind = dict(self.df.dtypes)["v"]
        return self.dense().reduce(lambda _: F.aggregate(row, F.lit(start).cast(kind), f), axis)

    # -- along an axis ------------------------------------------------------------------------------

    def _others(self, axis: int) -> list[str]:
        return [c for c in self.axes if c != f"i{self._axis(axis)}"]

    def _running(self, axis: int, v: Column, agg: Callable[[Column], Column], combine: Callable[[Column, Column], Column], chunk: int | None) -> TensorFrame:
        k = self._axis(axis)
        out = scan.running(self.df, self._others(axis), f"i{k}", self.shape[k], v, agg, combine, "_r", chunk)
        return self._same(out.select(*self.axes, F.col("_r").alias("v")))

    def cumsum(self, axis: int = 0, chunk: int | None = None) -> TensorFrame:
        """Running sums; a long axis goes in chunks, as all functions along an axis."""
        return self._running(axis, F.col("v"), F.sum, lambda a, b: a + b, chunk)

    def cumprod(self, axis: int = 0, chunk: int | None = None) -> TensorFrame:
        """Running products, by true products of doubles: whole numbers stay exact up to 2^53."""
        return self._running(axis, F.col("v").cast("double"), F.product, lambda a, b: a * b, chunk)

    def diff(self, n: int = 1, axis: int = -1, chunk: int | None = None) -> TensorFrame:
        """n-th difference; of booleans: whether neighbours differ."""
        k, out = self._axis(axis), self
        boolean = dict(self.df.dtypes)["v"] == "boolean"
        while n > 0:
            reach = min(n, 8)  # the expression doubles with each order
            df = scan.with_earlier(out.df, out._others(axis), f"i{k}", "v", reach, chunk)
            line = [F.col("v"), *[F.col(f"_e{j}") for j in range(1, reach + 1)]]
            while len(line) > 1:
                line = [(a != b) if boolean else (a - b) for a, b in zip(line, line[1:])]
            df = df.withColumn("v", line[0]).where(F.col(f"i{k}") >= reach).withColumn(f"i{k}", F.col(f"i{k}") - reach)
            out = TensorFrame(df.select(*out.axes, "v"), out.shape[:k] + (max(out.shape[k] - reach, 0),) + out.shape[k + 1 :])
            n -= reach
        return out

    def unwrap(self, period: float = 2 * math.pi, discont: float | None = None, axis: int = -1, chunk: int | None = None) -> TensorFrame:
        """Add multiples of the period so that jumps stay below half of it."""
        k, half = self._axis(axis), period / 2
        limit = half if discont is None else max(discont, half)
        df = scan.with_earlier(self.df, self._others(axis), f"i{k}", "v", 1, chunk)
        step = F.col("v") - F.col("_e1")
        folded = fx.floor_mod(step + half, F.lit(period)) - half
        folded = F.when((folded == -half) & (step > 0), F.lit(half)).otherwise(folded)
        fix = F.when(step.isNull() | (F.abs(step) < limit), 0.0).otherwise(folded - step)
        out = scan.running(df, self._others(axis), f"i{k}", self.shape[k], fix, F.sum, lambda a, b: a + b, "_fix", chunk)
        return self._same(out.select(*self.axes, (F.col("v") + F.col("_fix")).alias("v")))

    def convolve(self, kernel: TensorFrame, mode: str = "full", down: int = 1) -> TensorFrame:
        """Rank 1; modes full, same and valid, keeping every ``down``-th value.

        Two long series are multiplied by blocks; whole numbers stay exact.
        """
        if self.rank != 1 or kernel.rank != 1:
            raise ValueError("convolve is for rank 1")
        if self.size < kernel.size:
            return kernel.convolve(self, mode, down)
        n, m = self.size, kernel.size
        lo, count = {"full": (0, n + m - 1), "same": ((m - 1) // 2, n), "valid": (m - 1, n - m + 1)}[mode]
        if m > SHORT_KERNEL:
            whole = all(dict(t.df.dtypes)["v"] in ("tinyint", "smallint", "int", "bigint") for t in (self, kernel))
            by_transform = not whole and long.suited(self.df, kernel.df, n, m)
            out = long.transformed(self.df, kernel.df, n, m) if by_transform else long.convolve(self.df, kernel.df, whole)
            out = out.withColumn("i0", F.col("i0") - lo)
        else:
            # Each value meets every kernel value once: the smaller side, at most SHORT_KERNEL values, is exploded over.
            small = kernel.df.select(F.col("i0").alias("j"), F.col("v").alias("w"))
            out = self.df.crossJoin(F.broadcast(small)).select((F.col("i0") + F.col("j") - lo).alias("i0"), (F.col("v") * F.col("w")).alias("v")).groupBy("i0").agg(F.sum("v").alias("v"))
        out = out.where((F.col("i0") >= 0) & (F.col("i0") < count) & (F.col("i0") % down == 0))
        return TensorFrame(out.withColumn("i0", F.call_function("div", F.col("i0"), F.lit(down))), (-(-count // down),))

    def correlate(self, kernel: TensorFrame, mode: str = "valid", down: int = 1) -> TensorFrame:
        flipped = kernel[Span(-1, 0, -1)]
        return self.convolve(flipped, mode, down)

    # -- order and sets (rank 1) ----------------------------------------------------------------------

    def argsort(self, descending: bool = False) -> TensorFrame:
        """Positions in value order; ties keep their order either way."""
        v = F.col("v").desc() if descending else F.col("v").asc()
        out = ranked(self.df, [v, F.col("i0").asc()], "_r")
        return TensorFrame(out.select(F.col("_r").alias("i0"), F.col("i0").alias("v")), self.shape)

    def sorted(self, descending: bool = False) -> TensorFrame:
        v = F.col("v").desc() if descending else F.col("v").asc()
        out = ranked(self.df, [v, F.col("i0").asc()], "_r")
        return TensorFrame(out.select(F.col("_r").alias("i0"), "v"), self.shape)

    def unique(self, in_order: bool = False) -> TensorFrame:
        """Distinct values by first appearance, or in value order."""
        first = self.flatten().df.groupBy("v").agg(F.min("i0").alias("_f"))
        out = ranked(first, [F.col("v")] if in_order else [F.col("_f")], "i0").select("i0", "v")
        return TensorFrame(out, (out.count(),))

    def union(self, other: TensorFrame) -> TensorFrame:
        return TensorFrame.concat([self.flatten(), other.flatten()], 0).unique()

    def _set(self, df: DataFrame) -> TensorFrame:
        out = ranked(df, [F.col("v")], "i0").select("i0", "v")
        return TensorFrame(out, (out.count(),))

    def intersection(self, other: TensorFrame) -> TensorFrame:
        return self._set(self.df.select("v").intersect(other.df.select("v")))

    def set_diff(self, other: TensorFrame, symmetric: bool = False) -> TensorFrame:
        a, b = self.df.select("v"), other.df.select("v")
        out = a.subtract(b)
        return self._set(out.unionByName(b.subtract(a)) if symmetric else out)

    # -- contraction ------------------------------------------------------------------------------------

    @staticmethod
    def einsum(spec: str, *ops: TensorFrame) -> TensorFrame:
        df, shape = plan.contract([o.df for o in ops], [o.shape for o in ops], spec, [o.sparse for o in ops])
        if not shape:
            return TensorFrame(df.select(F.lit(0).cast("bigint").alias("i0"), F.coalesce("v", F.lit(0)).alias("v")), (1,))
        return TensorFrame(df, shape, sparse=any(o.sparse for o in ops))

    def dot(self, other: TensorFrame) -> TensorFrame:
        return TensorFrame.einsum("i,i->", self, other)

    def __matmul__(self, other: TensorFrame) -> TensorFrame:
        if self.rank != 2 or other.rank not in (1, 2):
            raise ValueError("a matrix by a matrix or a vector")
        return TensorFrame.einsum("ij,jk->ik" if other.rank == 2 else "ij,j->i", self, other)

    @staticmethod
    def gemm(alpha: float, a: TensorFrame, b: TensorFrame, beta: float, c: TensorFrame) -> TensorFrame:
        """alpha * a @ b + beta * c."""
        return (a @ b).dense() * alpha + c * beta

    def frobenius(self, other: TensorFrame) -> TensorFrame:
        return (self * other).sum()

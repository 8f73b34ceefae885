"""Products of a sparse symmetric matrix and vectors, in packed blocks.

Indices are dealt to chunks by their hash, and the entries of the lower triangle to the
block of their two chunks: one shuffle of the entries and one of their packed rows, after
which they lie still and serve for both triangles.  A product sends each chunk of the vector to the blocks of its
row and column and their sums back, so it shuffles the vector once for each chunk, not
one row for each entry.  A chunk has about ``4 * n**2 / entries`` indices within bounds:
what is shuffled stays below the entries, and a task holds two chunks and one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.plans.tables import Steps

#: Indices of a chunk, at least and at most (as their hash deals them).
CHUNK = (1 << 16, 1 << 20)
#: Entries packed in one row, at most.
PIECE = 1 << 20
#: Entries below which a block is not split for the sake of more tasks.
FEW = 1 << 14
#: Numbers of a result sent back in one batch.
BATCH = 1 << 16

Batches = Iterator[pa.RecordBatch]


@dataclass
class Blocks:
    """Pieces (b, i, j, p, q, v): the block, sorted indices, each entry's places in them, and values; the diagonal is halved."""

    pieces: DataFrame
    chunks: int
    shares: int  # parts of each block, by the hash of its entries
    parts: int
    sent: Steps


def _numbers(x: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    return zip(starts, [*starts[1:], len(keys)])


def _gathered(batches: Batches, limit: int | None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows (key, ...) sorted by key -> the columns of each key, ``limit`` rows of one key at a time."""
    here, held, n = None, [], 0

    def told() -> tuple[int, list[np.ndarray]]:
        return here, [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        ks, *columns = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        for a, z in _runs(ks):
            while a < z:
                if held and (ks[a] != here or n == limit):
                    yield told()
                    held, n = [], 0
                here, end = int(ks[a]), z if limit is None else min(z, a + limit - n)
                held.append([x[a:end] for x in columns])
                n, a = n + end - a, end
    if held:
        yield told()


def _pack(limit: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b, (i, j, v) in _gathered(batches, limit):
            (i, p), (j, q) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            packed = [i, j, p.astype(np.int32), q.astype(np.int32), v]
            yield pa.record_batch([pa.array([b], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], ["b", "i", "j", "p", "q", "v"])

    return run


def _pack_vector(batches: Batches) -> Batches:
    for k, (i, x) in _gathered(batches, None):
        yield pa.record_batch([pa.array([k], pa.int64()), pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["k", "i", "x"])


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, wanted)
    if len(wanted) and (at[-1] >= len(known) or (known[at] != wanted).any()):
        raise ValueError("the vector lacks indices of the matrix")
    return at


def _multiply(chunks: int, shares: int) -> Callable[[Batches], Batches]:
    """Pieces sorted by block, with the vector's chunks of its row and column -> sums (k, b, y) of each block."""

    def run(batches: Batches) -> Batches:
        here, sums = None, {}

        def told() -> pa.RecordBatch:
            ks = list(sums)
            return pa.record_batch([pa.array(ks, pa.int64()), pa.array([here] * len(ks), pa.int64()), pa.array([sums[k].tobytes() for k in ks], pa.binary())], ["k", "b", "y"])

        for batch in batches:
            for b, i, j, p, q, v, ri, rx, ci, cx in zip(*batch.columns):
                b = b.as_py()
                row, column = divmod(b // shares, chunks)
                rx, cx = _numbers(rx), _numbers(cx)
                if b != here:
                    if here is not None:
                        yield told()
                    here, sums = b, {row: np.zeros(len(rx)), column: np.zeros(len(cx))}
                p, q, v = _numbers(p, np.int32), _numbers(q, np.int32), _numbers(v)
                up, left = _places(_numbers(ri, np.int64), _numbers(i, np.int64)), _places(_numbers(ci, np.int64), _numbers(j, np.int64))
                sums[row][up] += np.bincount(p, v * cx[left][q], len(up))
                sums[column][left] += np.bincount(q, v * rx[up][p], len(left))
        if here is not None:
            yield told()

    return run


def _sum(batches: Batches) -> Batches:
    """Per chunk, sorted: its indices (block -1), then sums of its blocks -> rows (i, y)."""
    here, known, total = None, None, None

    def told() -> Batches:
        for a in range(0, len(known), BATCH):
            yield pa.record_batch([pa.array(known[a : a + BATCH]), pa.array(total[a : a + BATCH])], ["i", "y"])

    for batch in batches:
        for k, b, y in zip(*batch.columns):
            if k.as_py() != here:
                if here is not None:
                    yield from told()
                # The batch is gone when the chunk ends.
                here, known = k.as_py(), _numbers(y, np.int64).copy()
                total = np.zeros(len(known))
            else:
                total += _numbers(y)
    if here is not None:
        yield from told()


def _diagonal(batches: Batches) -> Batches:
    for batch in batches:
        for b, i, j, p, q, v in zip(*batch.columns):
            i, j = _numbers(i, np.int64)[_numbers(p, np.int32)], _numbers(j, np.int64)[_numbers(q, np.int32)]
            at = np.flatnonzero(i == j)
            for a in range(0, len(at), BATCH):
                some = at[a : a + BATCH]
                yield pa.record_batch([pa.array(i[some]), pa.array(2 * _numbers(v)[some])], ["i", "d"])


def _members(chunks: int, shares: int) -> Callable[[Batches], Batches]:
    """Pieces -> the indices (k, i) of each block's chunks, packed."""

    def run(batches: Batches) -> Batches:
        here, met = None, {}

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(met), pa.int64()), pa.array([x.tobytes() for x in met.values()], pa.binary())], ["k", "i"])

        for batch in batches:
            for b, i, j in zip(*batch.columns[:3]):
                if b.as_py() != here:
                    if met:
                        yield told()
                    here, met = b.as_py(), {}
                for k, x in zip(divmod(here // shares, chunks), (i, j)):
                    x = _numbers(x, np.int64)
                    met[k] = np.union1d(met[k], x) if k in met else x.copy()
        if met:
            yield told()

    return run


def _union(batches: Batches) -> Batches:
    here, met = None, np.zeros(0, np.int64)

    def told() -> Batches:
        for a in range(0, len(met), BATCH):
            yield pa.record_batch([pa.array(met[a : a + BATCH])], ["i"])

    for batch in batches:
        for k, i in zip(*batch.columns):
            if k.as_py() != here:
                yield from told()
                here, met = k.as_py(), np.zeros(0, np.int64)
            met = np.union1d(met, _numbers(i, np.int64))
    yield from told()


def _chunk(i: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(i), F.lit(chunks).cast("bigint"))


@contextmanager
def blocks(a: DataFrame) -> Iterator[Blocks]:
    """The symmetric matrix ``a`` (i, j, v), of which the lower triangle is read, until the end of the scope; entries of one cell add up."""
    spark = a.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lower = a.where("i >= j").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    # The sizes of chunks hang on the indices' number, no result does: an estimate is enough.
    count, n = lower.agg(F.count("*"), F.approx_count_distinct("i") + F.approx_count_distinct("j")).first()
    size = min(max(4 * n * n // max(count, 1), CHUNK[0]), CHUNK[1])
    chunks = max(1, -(-n // size))
    cells = chunks * (chunks + 1) // 2
    shares = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // cells), count // (cells * FEW)))
    at = lower.select("i", "j", F.when(F.expr("i = j"), F.col("v") / 2).otherwise(F.col("v")).alias("v"), _chunk("i", chunks).alias("ki"), _chunk("j", chunks).alias("kj"))
    turned = F.col("ki") < F.col("kj")
    block = (F.greatest("ki", "kj") * chunks + F.least("ki", "kj")) * shares + F.pmod(F.xxhash64("j", "i"), F.lit(shares).cast("bigint"))
    dealt = at.select(block.alias("b"), F.when(turned, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("j"), "v")
    packed = dealt.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(_pack(PIECE), "b long, i binary, j binary, p binary, q binary, v binary")
    # Packed rows are few and keep their places: spread and sorted again, for the plan to know.
    kept = packed.repartition(parts, "b").sortWithinPartitions("b").persist(StorageLevel.DISK_ONLY)
    sent = Steps(spark, "vectors")
    try:
        yield Blocks(kept, chunks, shares, parts, sent)
    finally:
        kept.unpersist()
        sent.drop_all()


def times(a: Blocks, x: DataFrame, value: Column, out: str) -> DataFrame:
    """(i, out): the matrix times the vector of ``value`` at ``i``, a row for every index of the matrix.

    Read it before the next but one product.
    """
    v = x.select(_chunk("i", a.chunks).alias("k"), F.col("i").cast("bigint").alias("i"), value.cast("double").alias("x"))
    v = a.sent.put(v.repartition(a.parts, "k").sortWithinPartitions("k", "i").mapInArrow(_pack_vector, "k long, i binary, x binary"))
    share = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(a.shares - 1).cast("bigint"))).alias("s")
    zero, last = F.lit(0).cast("bigint"), F.lit(a.chunks - 1).cast("bigint")
    rows = v.withColumn("o", F.explode(F.sequence(zero, F.col("k")))).select("*", share)
    columns = v.withColumn("o", F.explode(F.sequence(F.col("k"), last))).select("*", share)
    rows = rows.select(((F.col("k") * a.chunks + F.col("o")) * a.shares + F.col("s")).alias("b"), F.col("i").alias("ri"), F.col("x").alias("rx"))
    columns = columns.select(((F.col("o") * a.chunks + F.col("k")) * a.shares + F.col("s")).alias("b"), F.col("i").alias("ci"), F.col("x").alias("cx"))
    # Merged by block, so that the pieces of one come one after the other.
    met = a.pieces.join(rows.hint("merge"), "b").join(columns.hint("merge"), "b")
    sums = met.mapInArrow(_multiply(a.chunks, a.shares), "k long, b long, y binary")
    known = v.select("k", F.lit(-1).cast("bigint").alias("b"), F.col("i").alias("y"))
    spread = known.union(sums).repartition(a.parts, "k").sortWithinPartitions("k", "b")
    return spread.mapInArrow(_sum, "i long, y double").withColumnRenamed("y", out)


def diagonal(a: Blocks) -> DataFrame:
    """(i, d): the diagonal, where it has entries."""
    at = F.expr(f"b div {a.shares}")
    inside = a.pieces.where(F.call_function("div", at, F.lit(a.chunks)) == at % a.chunks)
    return inside.mapInArrow(_diagonal, "i long, d double").groupBy("i").agg(F.sum("d").alias("d"))


def indices(a: Blocks) -> DataFrame:
    """(i): every index with an entry, once."""
    met = a.pieces.mapInArrow(_members(a.chunks, a.shares), "k long, i binary")
    return met.repartition(a.parts, "k").sortWithinPartitions("k").mapInArrow(_union, "i long")

"""Convolution of two long series by blocks.

Both series are cut into blocks.  A block of the one meets a block of the other in one
row; their product, by FFT, reaches over two blocks of the result, where the parts are
added.  n * m / BLOCK numbers are shuffled instead of n * m rows.

Of finite doubles, long series go by one Fourier transform of the whole instead: the
places are laid out as a matrix of about sqrt(n + m) rows and columns, transformed down
the columns by some tasks and along the rows by others.  Three shuffles of n + m
numbers, whatever the lengths; a task holds a strip of rows or columns.  Rounding is
relative to the whole of both series, not to the values near a place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in a block.  Blocks of the shorter series are copied into SALTS, so that its few keys spread.
BLOCK, SALTS = 4096, 64
#: Pairs of blocks up to which blocks are used for doubles; rows or columns of the transform's matrix in a strip.
PAIRS, STRIP = 512, 64


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Full convolution of two blocks.  Exact for whole numbers; NaN and infinities stay where a sum meets them."""
    if a.dtype.kind == "i" or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return np.convolve(a, b)
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]


def _blocks(df: DataFrame, name: str, block: int) -> DataFrame:
    """(name, values): blocks as arrays of (place, value), so that absent places need no row."""
    at = F.call_function("div", F.col("i0"), F.lit(block)).cast("bigint")
    return df.groupBy(at.alias(name)).agg(F.collect_list(F.struct((F.col("i0") % block).cast("int").alias("i"), "v")).alias(f"{name}_v"))


def convolve(a: DataFrame, b: DataFrame, whole: bool, block: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """(i0, v): the full convolution of series (i0, v); ``b`` should be the shorter one."""
    kind = "bigint" if whole else "double"
    typed = lambda df: df.select(F.col("i0").cast("bigint").alias("i0"), F.col("v").cast(kind).alias("v"))
    x = _blocks(typed(a), "p", block)
    y = _blocks(typed(b), "q", block)
    # Every block of a meets every block of b, as the result demands: by key, b's blocks copied to all salts.
    numbers = y.agg(F.collect_list("q").alias("qs"))  # one row of block numbers
    salted = x.crossJoin(F.broadcast(numbers)).withColumn("q", F.explode("qs")).withColumn("s", F.pmod(F.xxhash64("p"), F.lit(salts))).drop("qs")
    copied = y.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    # Sent by key: copies of long blocks are far larger than their estimate, which would have them broadcast.
    pairs = salted.join(copied.hint("merge"), ["q", "s"]).select((F.col("p") + F.col("q")).alias("o"), "p_v", "q_v")
    dtype = np.int64 if whole else np.float64

    def values(cell: pa.ListScalar) -> np.ndarray:
        # Up to the last place only: zeros behind it would spread NaN too far.
        at = cell.values.field("i").to_numpy()
        out = np.zeros(at.max() + 1, dtype)
        out[at] = cell.values.field("v").to_numpy(zero_copy_only=False)
        return out

    def run(batches):
        # Arrow, not pandas, lest NaN turn into null on the way back.
        for batch in batches:
            for o, u, w in zip(*(batch.column(c) for c in ("o", "p_v", "q_v"))):
                full = product(values(u), values(w))
                parts = pa.ListArray.from_arrays([0, min(block, len(full)), len(full)], pa.array(full))
                yield pa.RecordBatch.from_arrays([pa.array([o.as_py(), o.as_py() + 1]), parts], ["o", "part"])

    parts = pairs.mapInArrow(run, f"o bigint, part array<{kind}>")
    cells = parts.select("o", F.posexplode("part").alias("i", "v"))
    return cells.groupBy((F.col("o") * block + F.col("i")).alias("i0")).agg(F.sum("v").alias("v"))


def suited(a: DataFrame, b: DataFrame, n: int, m: int) -> bool:
    """Whether the series, of ``n`` and ``m`` places, are long enough for the transform and all their values finite."""
    if -(-n // BLOCK) * -(-m // BLOCK) <= PAIRS:
        return False
    finite = F.bool_and(F.coalesce(F.abs(F.col("v").cast("double")) < float("inf"), F.lit(False)))
    return all(df.agg(finite).first()[0] is not False for df in (a, b))


def transformed(a: DataFrame, b: DataFrame, n: int, m: int, strip: int = STRIP) -> DataFrame:
    """(i0, v): the full convolution of two series (i0, v) of finite doubles, by one transform of the whole."""
    total = n + m - 1
    bits = max(total - 1, 3).bit_length()
    rows, cols = 1 << (bits + 1) // 2, 1 << bits // 2
    half, strip = rows // 2 + 1, min(strip, cols)  # of real input, half of the frequencies down a column are enough
    turn = lambda k, c: np.exp(2j * np.pi / (rows * cols) * (k[:, None] * c[None, :]))

    def down(f: pd.DataFrame) -> pd.DataFrame:
        side, cb = int(f["side"].iloc[0]), int(f["cb"].iloc[0])
        at, x = f["i0"].to_numpy(), np.zeros((rows, strip))
        x[at // cols, at % cols - cb * strip] = f["v"].to_numpy()
        y = np.fft.rfft(x, axis=0)
        y *= turn(np.arange(half), cb * strip + np.arange(strip)).conj()
        return pd.DataFrame([(side, k // strip, cb, y[k : k + strip].tobytes()) for k in range(0, half, strip)], columns=["side", "kb", "cb", "x"])

    def across(f: pd.DataFrame) -> pd.DataFrame:
        kb = int(f["kb"].iloc[0])
        k = np.arange(kb * strip, min((kb + 1) * strip, half))
        x = np.zeros((2, len(k), cols), complex)
        for side, cb, part in zip(f["side"], f["cb"], f["x"]):
            x[side, :, cb * strip : (cb + 1) * strip] = np.frombuffer(part, complex).reshape(len(k), strip)
        x = np.fft.fft(x, axis=2)
        z = np.fft.ifft(x[0] * x[1], axis=1)
        z *= turn(k, np.arange(cols))
        return pd.DataFrame([(kb, cb, np.ascontiguousarray(z[:, cb * strip : (cb + 1) * strip]).tobytes()) for cb in range(cols // strip)], columns=["kb", "cb", "x"])

    def up(f: pd.DataFrame) -> pd.DataFrame:
        cb, x = int(f["cb"].iloc[0]), np.zeros((half, strip), complex)
        for kb, part in zip(f["kb"], f["x"]):
            x[kb * strip : (kb + 1) * strip] = np.frombuffer(part, complex).reshape(-1, strip)
        at = (np.arange(rows)[:, None] * cols + (cb * strip + np.arange(strip))).ravel()
        return pd.DataFrame({"i0": at, "v": np.fft.irfft(x, rows, axis=0).ravel()})[at < total]

    sides = [df.select(F.lit(k).alias("side"), F.col("i0").cast("bigint").alias("i0"), F.col("v").cast("double").alias("v")) for k, df in enumerate((a, b))]
    both = sides[0].unionAll(sides[1]).withColumn("cb", F.call_function("div", F.col("i0") % cols, F.lit(strip)))
    spectra = both.groupBy("side", "cb").applyInPandas(down, "side int, kb bigint, cb bigint, x binary")
    products = spectra.groupBy("kb").applyInPandas(across, "kb bigint, cb bigint, x binary")
    return products.groupBy("cb").applyInPandas(up, "i0 bigint, v double")

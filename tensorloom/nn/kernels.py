"""Batched NumPy kernels, and columns that run them over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _windows(x: np.ndarray, kh: int, kw: int, stride: tuple[int, int]) -> np.ndarray:
    """(n, c, oh, ow, kh, kw) view of sliding windows."""
    v = np.lib.stride_tricks.sliding_window_view(x, (kh, kw), axis=(2, 3))
    return v[:, :, :: stride[0], :: stride[1]]


def conv2d(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None, padding=(0, 0), stride=(1, 1)) -> np.ndarray:
    """Cross-correlation of NCHW input with (out, in, kh, kw) weights."""
    p = np.pad(x, ((0, 0), (0, 0), (padding[0],) * 2, (padding[1],) * 2))
    y = np.einsum("nchwij,ocij->nohw", _windows(p, *w.shape[2:], stride), w, optimize=True)
    return y if b is None else y + b.reshape(1, -1, 1, 1)


def conv2d_backward(g: np.ndarray, x: np.ndarray, w: np.ndarray, padding=(0, 0), stride=(1, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of input, weights and bias."""
    p = np.pad(x, ((0, 0), (0, 0), (padding[0],) * 2, (padding[1],) * 2))
    dw = np.einsum("nchwij,nohw->ocij", _windows(p, *w.shape[2:], stride), g, optimize=True)
    dp = np.zeros_like(p)
    for i in range(w.shape[2]):
        for j in range(w.shape[3]):
            dp[:, :, i : i + stride[0] * g.shape[2] : stride[0], j : j + stride[1] * g.shape[3] : stride[1]] += np.einsum("nohw,oc->nchw", g, w[:, :, i, j])
    h, v = x.shape[2:]
    return dp[:, :, padding[0] : padding[0] + h, padding[1] : padding[1] + v], dw, g.sum(axis=(0, 2, 3))


def maxpool2d(x: np.ndarray, kernel=(2, 2), padding=(0, 0), stride=(2, 2)) -> tuple[np.ndarray, np.ndarray]:
    """Largest values and their flat positions in the padded input; the first of equals wins."""
    p = np.pad(x, ((0, 0), (0, 0), (padding[0],) * 2, (padding[1],) * 2), constant_values=-np.inf)
    v = _windows(p, *kernel, stride)
    flat = v.reshape(*v.shape[:4], -1)
    k = flat.argmax(axis=-1)
    n, c, h, w = np.indices(k.shape)
    row, col = h * stride[0] + k // kernel[1], w * stride[1] + k % kernel[1]
    return np.take_along_axis(flat, k[..., None], -1)[..., 0], ((n * p.shape[1] + c) * p.shape[2] + row) * p.shape[3] + col


def maxpool2d_backward(g: np.ndarray, at: np.ndarray, shape: tuple[int, ...], padding=(0, 0)) -> np.ndarray:
    """Gradients are added where windows overlap."""
    n, c, h, w = shape
    p = np.zeros((n, c, h + 2 * padding[0], w + 2 * padding[1]))
    np.add.at(p.reshape(-1), at.ravel(), g.ravel())
    return p[:, :, padding[0] : padding[0] + h, padding[1] : padding[1] + w]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def gru_cell(x: np.ndarray, h: np.ndarray, w: np.ndarray, u: np.ndarray, bw: np.ndarray, bu: np.ndarray) -> np.ndarray:
    """One step for a batch; gates are packed in the order reset, update, candidate."""
    n = h.shape[-1]
    a, b = x @ w.T + bw, h @ u.T + bu
    r, z = _sigmoid(a[:, :n] + b[:, :n]), _sigmoid(a[:, n : 2 * n] + b[:, n : 2 * n])
    c = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
    return (1 - z) * c + z * h


def gru(x: np.ndarray, h0: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Stacked layers over (time, batch, features): outputs of the last layer and the last states."""
    last = []
    for k, p in enumerate(layers):
        h, out = h0[k], []
        for step in x:
            h = gru_cell(step, h, *p)
            out.append(h)
        x = np.stack(out)
        last.append(h)
    return x, np.stack(last)


def batched(column: Column, f, shape: tuple[int, ...]) -> Column:
    """Apply ``f`` to batches of a flat array column, seen as (n, *shape); rows come back flat."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        x = np.stack(s.to_list()).reshape(len(s), *shape)
        return pd.Series(list(np.asarray(f(x)).reshape(len(s), -1)))

    return run(column.cast("array<double>"))

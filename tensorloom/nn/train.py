"""Optimizers, initialisers, models, and training over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tensorloom.nn.autograd import Variable, linear


class SGD:
    def __init__(self, params: Sequence[Variable], learning_rate: float):
        self.params, self.rate = list(params), learning_rate

    def update(self) -> None:
        for p in self.params:
            p.value = p.value - self.rate * p.grad
            p.grad = np.zeros_like(p.value)


class Momentum:
    """SGD with momentum; the learning rate shrinks by 1 / (1 + decay), and the decay doubles, at each step."""

    def __init__(self, params: Sequence[Variable], learning_rate: float, momentum: float = 0.9, decay: float = 0.0, nesterov: bool = False):
        self.params, self.rate, self.momentum, self.decay, self.nesterov = list(params), learning_rate, momentum, decay, nesterov
        self.speed = [np.zeros_like(p.value) for p in self.params]

    def update(self) -> None:
        self.rate /= 1 + self.decay
        self.decay *= 2
        for k, p in enumerate(self.params):
            self.speed[k] = self.momentum * self.speed[k] - self.rate * p.grad
            p.value = p.value + (self.momentum * self.speed[k] - self.rate * p.grad if self.nesterov else self.speed[k])
            p.grad = np.zeros_like(p.value)


class Adam:
    def __init__(self, params: Sequence[Variable], learning_rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        self.params, self.rate, self.b1, self.b2, self.eps, self.t = list(params), learning_rate, beta1, beta2, eps, 0
        self.m = [np.zeros_like(p.value) for p in self.params]
        self.v = [np.zeros_like(p.value) for p in self.params]

    def update(self) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - self.b2**self.t) / (1 - self.b1**self.t)
        for k, p in enumerate(self.params):
            self.m[k] = self.b1 * self.m[k] + (1 - self.b1) * p.grad
            self.v[k] = self.b2 * self.v[k] + (1 - self.b2) * p.grad**2
            p.value = p.value - rate * self.m[k] / (np.sqrt(self.v[k]) + self.eps)
            p.grad = np.zeros_like(p.value)


def fans(shape: Sequence[int]) -> tuple[int, int]:
    """(in, out) of (out, in) or (out, in, kh, kw) weights."""
    field = int(np.prod(shape[2:])) if len(shape) > 2 else 1
    return shape[1] * field, shape[0] * field


def _scaled(shape: Sequence[int], scale: float, fan: float, normal: bool, seed: int | None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    std = np.sqrt(scale / fan)
    return rng.normal(0, std, shape) if normal else rng.uniform(-std * np.sqrt(3), std * np.sqrt(3), shape)


def kaiming_uniform(shape: Sequence[int], seed: int | None = None) -> np.ndarray:
    return _scaled(shape, 2, fans(shape)[0], False, seed)


def kaiming_normal(shape: Sequence[int], seed: int | None = None) -> np.ndarray:
    return _scaled(shape, 2, fans(shape)[0], True, seed)


def xavier_uniform(shape: Sequence[int], seed: int | None = None) -> np.ndarray:
    return _scaled(shape, 2, sum(fans(shape)), False, seed)


def xavier_normal(shape: Sequence[int], seed: int | None = None) -> np.ndarray:
    return _scaled(shape, 2, sum(fans(shape)), True, seed)


def yann_uniform(shape: Sequence[int], seed: int | None = None) -> np.ndarray:
    return _scaled(shape, 1, fans(shape)[0], False, seed)


def yann_normal(shape: Sequence[int], seed: int | None = None) -> np.ndarray:
    return _scaled(shape, 1, fans(shape)[0], True, seed)


class Linear:
    def __init__(self, n_in: int, n_out: int, seed: int | None = None):
        self.params = [Variable(kaiming_uniform((n_out, n_in), seed)), Variable(np.zeros((1, n_out)))]

    def __call__(self, x: Variable) -> Variable:
        return linear(x, *self.params)


class Sequential:
    """Layers and plain functions of a variable, in order."""

    def __init__(self, *layers: Callable[[Variable], Variable]):
        self.layers = layers
        self.params = [p for layer in layers for p in getattr(layer, "params", [])]

    def __call__(self, x: Variable) -> Variable:
        for layer in self.layers:
            x = layer(x)
        return x


def fit(df: DataFrame, x_col: str, y_col: str, model: Sequential, loss: Callable[[Variable, np.ndarray], Variable], optimizer, epochs: int) -> list[float]:
    """Full-batch gradient steps; the mean loss before each.

    Every task returns the sum of its gradients; these are added by Spark, so
    the driver gets as many numbers as the model has parameters.
    """
    sizes = [p.value.size for p in model.params]
    x = df.select(x_col, y_col)
    history = []
    for _ in range(epochs):

        def part(it: Iterable[pd.DataFrame]):
            total, seen, lost = np.zeros(sum(sizes)), 0, 0.0
            for pdf in it:
                if len(pdf):
                    for p in model.params:
                        p.grad = np.zeros_like(p.value)
                    out = loss(model(Variable(np.stack(pdf[x_col].to_list()))), np.array(pdf[y_col].to_list()))
                    out.backprop()
                    total += len(pdf) * np.concatenate([p.grad.ravel() for p in model.params])
                    lost += len(pdf) * float(out.value)
                    seen += len(pdf)
            yield pd.DataFrame({"k": range(len(total) + 2), "g": [*total, lost, float(seen)]})

        got = x.mapInPandas(part, "k int, g double").groupBy("k").sum("g").toPandas().set_index("k")["sum(g)"].sort_index().to_numpy()
        seen = max(got[-1], 1.0)
        history.append(got[-2] / seen)
        at = 0
        for p, n in zip(model.params, sizes, strict=True):
            p.grad = (got[at : at + n] / seen).reshape(p.shape)
            at += n
        optimizer.update()
    return history


def predict(df: DataFrame, x_col: str, model: Sequential, out: str = "prediction") -> DataFrame:
    from tensorloom.nn.kernels import batched

    first = len(df.select(x_col).first()[0])
    return df.withColumn(out, batched(df[x_col], lambda x: model(Variable(x)).value, (first,)))

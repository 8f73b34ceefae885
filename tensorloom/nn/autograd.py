"""A define-by-run tape over NumPy arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from tensorloom.nn import kernels


class Variable:
    """A value, its gradient, and how it came to be."""

    def __init__(self, value, parents: Sequence[Variable] = (), back: Callable | None = None):
        self.value = np.asarray(value, dtype=float)
        self.grad = np.zeros_like(self.value)
        self.parents, self.back = tuple(parents), back

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def backprop(self, seed=None) -> None:
        """Gradients of this value by all before it, added up in reverse order of making."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, ready = stack.pop()
            if ready:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.value) if seed is None else np.asarray(seed, float)
        for v in reversed(order):
            if v.back is not None:
                for p, g in zip(v.parents, v.back(v.grad), strict=True):
                    if g is not None:
                        p.grad = p.grad + _shrink(g, p.shape)

    def __add__(self, o):
        o = wrap(o)
        return Variable(self.value + o.value, (self, o), lambda g: (g, g))

    def __sub__(self, o):
        o = wrap(o)
        return Variable(self.value - o.value, (self, o), lambda g: (g, -g))

    def __mul__(self, o):
        """Element by element."""
        o = wrap(o)
        return Variable(self.value * o.value, (self, o), lambda g: (g * o.value, g * self.value))

    def __matmul__(self, o):
        o = wrap(o)
        return Variable(self.value @ o.value, (self, o), lambda g: (g @ o.value.T, self.value.T @ g))

    def __getitem__(self, key):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return (out,)

        return Variable(self.value[key], (self,), back)

    def reshape(self, *shape: int):
        return Variable(self.value.reshape(*shape), (self,), lambda g: (g.reshape(self.shape),))

    def flatten(self):
        """All but the batch axis."""
        return self.reshape(self.shape[0], -1)

    def squeeze(self, axis: int):
        return Variable(np.squeeze(self.value, axis), (self,), lambda g: (np.expand_dims(g, axis),))

    def unsqueeze(self, axis: int):
        return Variable(np.expand_dims(self.value, axis), (self,), lambda g: (np.squeeze(g, axis),))

    def sum(self):
        return Variable(self.value.sum(), (self,), lambda g: (np.full(self.shape, g),))

    def mean(self, axis: int | None = None):
        """The gradient of an axis mean is shared by the length of that axis."""
        n = self.value.size if axis is None else self.shape[axis]
        keep = axis is not None
        return Variable(self.value.mean(axis=axis, keepdims=keep), (self,), lambda g: (np.broadcast_to(g, self.shape) / n,))

    def relu(self):
        return Variable(np.maximum(self.value, 0), (self,), lambda g: (g * (self.value > 0),))

    def sigmoid(self):
        y = kernels._sigmoid(self.value)
        return Variable(y, (self,), lambda g: (g * y * (1 - y),))

    def tanh(self):
        y = np.tanh(self.value)
        return Variable(y, (self,), lambda g: (g * (1 - y * y),))

    def softmax(self):
        y = softmax(self.value)
        return Variable(y, (self,), lambda g: (y * (g - (g * y).sum(axis=-1, keepdims=True)),))


def wrap(x) -> Variable:
    return x if isinstance(x, Variable) else Variable(x)


def _shrink(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over axes that broadcasting stretched."""
    g = np.asarray(g)
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(axis=k, keepdims=True)
    return g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def stack(vs: Sequence[Variable], axis: int = 0) -> Variable:
    return Variable(np.stack([v.value for v in vs], axis), vs, lambda g: [np.take(g, k, axis) for k in range(len(vs))])


def chunk(v: Variable, n: int, axis: int = 0) -> list[Variable]:
    out, at = [], 0
    for part in np.array_split(v.value, n, axis):
        key = tuple([slice(None)] * axis + [slice(at, at + part.shape[axis])])
        out.append(v[key])
        at += part.shape[axis]
    return out


def linear(x: Variable, w: Variable, b: Variable | None = None) -> Variable:
    """x Wᵀ + b."""
    y = Variable(x.value @ w.value.T, (x, w), lambda g: (g @ w.value, g.T @ x.value))
    return y if b is None else y + b


def conv2d(x: Variable, w: Variable, b: Variable | None = None, padding=(0, 0), stride=(1, 1)) -> Variable:
    y = kernels.conv2d(x.value, w.value, None if b is None else b.value, padding, stride)

    def back(g):
        dx, dw, db = kernels.conv2d_backward(g, x.value, w.value, padding, stride)
        return (dx, dw) if b is None else (dx, dw, db.reshape(b.shape))

    return Variable(y, (x, w) if b is None else (x, w, b), back)


def maxpool2d(x: Variable, kernel=(2, 2), padding=(0, 0), stride=(2, 2)) -> Variable:
    y, at = kernels.maxpool2d(x.value, kernel, padding, stride)
    return Variable(y, (x,), lambda g: (kernels.maxpool2d_backward(g, at, x.shape, padding),))


def embedding(ids: np.ndarray, table: Variable, padding: int | None = None, by_frequency: bool = False) -> Variable:
    ids = np.asarray(ids)

    def back(g):
        out = np.zeros_like(table.value)
        flat, gs = ids.ravel(), g.reshape(-1, g.shape[-1])
        keep = flat != padding if padding is not None else np.ones(len(flat), bool)
        if by_frequency:
            _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
            gs = gs / count[inverse][:, None]
        np.add.at(out, flat[keep], gs[keep])
        return (out,)

    return Variable(table.value[ids], (table,), back)


def gcn(x: Variable, adjacency: np.ndarray, w: Variable, b: Variable | None = None) -> Variable:
    """A X Wᵀ + b; the gradient passes back through Aᵀ."""
    mixed = Variable(adjacency @ x.value, (x,), lambda g: (adjacency.T @ g,))
    return linear(mixed, w, b)


def gru(x: Variable, h0: Variable, w: Variable, u: Variable, bw: Variable, bu: Variable) -> Variable:
    """One layer over (time, batch, features), on the tape: outputs of all steps."""
    n, h, out = h0.shape[-1], h0, []
    for t in range(x.shape[0]):
        a, b = linear(x[t], w, bw), linear(h, u, bu)
        at = lambda v, k: v[:, k * n : (k + 1) * n]
        r, z = (at(a, 0) + at(b, 0)).sigmoid(), (at(a, 1) + at(b, 1)).sigmoid()
        c = (at(a, 2) + r * at(b, 2)).tanh()
        h = c + z * (h - c)
        out.append(h)
    return stack(out)


def mse_loss(x: Variable, target: np.ndarray) -> Variable:
    d = x.value - target
    return Variable((d * d).mean(), (x,), lambda g: (g * 2 * d / d.size,))


def sigmoid_cross_entropy(x: Variable, target: np.ndarray) -> Variable:
    n = x.shape[0]
    v = x.value
    loss = (np.maximum(v, 0) - target * v + np.log1p(np.exp(-np.abs(v)))).sum() / n
    return Variable(loss, (x,), lambda g: (g * (kernels._sigmoid(v) - target) / n,))


def softmax_cross_entropy(x: Variable, target: np.ndarray) -> Variable:
    """Mean over the batch; ``target`` holds labels or one distribution per row."""
    v, n = x.value, x.shape[0]
    target = np.asarray(target)
    dense = target if target.ndim == 2 else np.eye(v.shape[1])[target.astype(int)]
    top = v.max(axis=1, keepdims=True)
    norm = np.log(np.exp(v - top).sum(axis=1, keepdims=True)) + top
    return Variable(((norm - v) * dense).sum() / n, (x,), lambda g: (g * (softmax(v) * dense.sum(axis=1, keepdims=True) - dense) / n,))


def numerical_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    out = np.zeros_like(x, dtype=float)
    for k in np.ndindex(*x.shape):
        up, down = x.astype(float).copy(), x.astype(float).copy()
        up[k] += h
        down[k] -= h
        out[k] = (f(up) - f(down)) / (2 * h)
    return out

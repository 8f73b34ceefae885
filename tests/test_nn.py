from __future__ import annotations

import numpy as np
import pytest

from tensorloom.nn import autograd as ag
from tensorloom.nn import kernels, train

RNG = np.random.default_rng(0)


def check(f, *xs):
    """Tape gradients of the sum of ``f`` against central differences."""
    vs = [ag.Variable(x) for x in xs]
    f(*vs).sum().backprop()
    for k, x in enumerate(xs):
        g = ag.numerical_gradient(lambda y, k=k: float(f(*[ag.Variable(y if j == k else z) for j, z in enumerate(xs)]).value.sum()), x)
        assert np.allclose(vs[k].grad, g, atol=1e-4)


@pytest.mark.parametrize(
    "f, shapes",
    [
        (lambda a, b: a @ b, [(2, 3), (3, 2)]),
        (lambda a, b: a * b - b, [(2, 3), (1, 3)]),
        (lambda a: a.mean(0) * a.mean(0), [(2, 4)]),
        (lambda a: a.softmax() * a, [(2, 4)]),
        (lambda a: (a.tanh() * a.sigmoid()).relu(), [(3, 2)]),
        (lambda x, w, b: ag.conv2d(x, w, b, (1, 1), (2, 1)), [(2, 2, 5, 4), (3, 2, 3, 2), (3,)]),
        (lambda x: ag.maxpool2d(x, (3, 3), (0, 0), (1, 1)), [(1, 2, 5, 5)]),
        (lambda x, w: ag.gcn(x, np.triu(np.ones((4, 4))), w), [(4, 3), (2, 3)]),
        (lambda x, h, w, u, p, q: ag.gru(x, h, w, u, p, q), [(3, 2, 2), (2, 3), (9, 2), (9, 3), (9,), (9,)]),
        (lambda a: ag.stack(ag.chunk(a, 2, 1), 0), [(2, 4)]),
        (lambda t: ag.embedding(np.array([[0, 2], [2, 1]]), t), [(3, 2)]),
        (lambda x: ag.softmax_cross_entropy(x, np.array([1, 0])), [(2, 3)]),
        (lambda x: ag.sigmoid_cross_entropy(x, np.array([[1.0, 0.0]])), [(1, 2)]),
        (lambda x: ag.mse_loss(x, np.ones((2, 2))), [(2, 2)]),
    ],
)
def test_gradients(f, shapes):
    check(f, *[RNG.normal(size=s) for s in shapes])


def test_gru_layers_agree():
    p = [RNG.normal(size=s) for s in ((9, 2), (9, 3), (9,), (9,))]
    x, h = RNG.normal(size=(4, 2, 2)), RNG.normal(size=(2, 3))
    out, last = kernels.gru(x, h[None], [tuple(p)])
    assert np.allclose(out, ag.gru(*map(ag.Variable, (x, h, *p))).value) and np.allclose(out[-1], last[0])


@pytest.mark.parametrize("make", [lambda p: train.SGD(p, 0.5), lambda p: train.Momentum(p, 0.3, nesterov=True), lambda p: train.Adam(p, 0.1)])
def test_optimizers_descend(make):
    p = ag.Variable(np.array([3.0, -2.0]))
    o = make([p])
    for _ in range(80):
        (p * p).mean().backprop()
        o.update()
    assert np.abs(p.value).max() < 0.3


def test_training_over_a_frame(spark):
    x = RNG.normal(size=(200, 2))
    df = spark.createDataFrame([(a.tolist(), int(a[0] * a[1] > 0)) for a in x], "x array<double>, y int").repartition(3)
    m = train.Sequential(train.Linear(2, 12, 1), lambda v: v.relu(), train.Linear(12, 2, 2))
    h = train.fit(df, "x", "y", m, ag.softmax_cross_entropy, train.Adam(m.params, 0.05), 25)
    assert h[-1] < 0.5 * h[0]
    out = train.predict(df, "x", m).toPandas()
    assert np.mean([np.argmax(p) == y for p, y in zip(out["prediction"], out["y"], strict=True)]) > 0.85

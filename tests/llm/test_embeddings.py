from __future__ import annotations

import math

import numpy as np
import pytest

from tensorloom.llm import embeddings
from tensorloom.llm.embeddings import build_tree, linked, walk
from tensorloom.llm.queries import op12_embedding_dedup


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def clusters(rng: np.random.Generator, n: int, d: int, spread: float) -> np.ndarray:
    centres = rng.normal(size=(max(n // 20, 1), d))
    return unit(centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d)))


def brute(vectors: list) -> tuple[list[int], list[int]]:
    """Number of links and smallest linked place, by all pairs of places."""
    n = len(vectors)
    fit = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    units = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if f else None for v, f in zip(vectors, fit)]
    label, links = list(range(n)), [0] * n
    pairs = [(i, j) for i in range(n) for j in range(i) if fit[i] and fit[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    while True:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return links, label


@pytest.mark.parametrize("d,spread", [(2, 0.05), (3, 0.1), (8, 0.05), (64, 0.03), (64, 1.0)])
def test_tree_covers_its_members_and_nests(d, spread):
    v = clusters(np.random.default_rng(1), 300, d, spread)
    t = build_tree(v, np.zeros(300), np.ones(300, int), np.full(300, d))
    members = [[] for _ in t["parent"]]
    for leaf in range(300):
        node = leaf
        while node >= 0:
            members[node].append(leaf)
            node = t["parent"][node]
    assert len(members[-1]) == 300
    for node, own in enumerate(members):
        angles = np.arccos(np.clip(v[own] @ v[t["centre"][node]], -1, 1))
        assert t["centre"][node] in own and t["weight"][node] == len(own) and angles.max() <= t["radius"][node] + 1e-7
    for (ids, up), (above, _) in zip(t["levels"], t["levels"][1:]):
        assert (np.diff(up) >= 0).all() and all(above[u] in (i, t["parent"][i]) for i, u in zip(ids, up))


@pytest.mark.parametrize("d,spread", [(2, 0.05), (8, 0.05), (64, 0.025)])
def test_walk_finds_all_links_and_prunes(d, spread):
    rng = np.random.default_rng(4)
    v = clusters(rng, 500, d, spread)
    a, b = (build_tree(x, np.zeros(len(x)), np.ones(len(x), int), np.full(len(x), d)) for x in (v[:260], v[260:]))
    for p, q, same, x, y in ((a, b, False, v[:260], v[260:]), (a, a, True, v[:260], v[:260])):
        found, i, _ = walk(p, q, same, 0.95)
        assert not len(i)
        add, _ = linked(p, q, same, found)
        down = add.copy()
        for tree, shift in ((p, 0),) if same else ((p, 0), (q, len(p["parent"]))):
            for node in range(len(tree["parent"]) - 2, -1, -1):
                down[shift + node] += down[shift + tree["parent"][node]]
        near = x @ y.T >= 0.95
        if same:
            np.fill_diagonal(near, False)
        assert (down[: len(x)] == near.sum(1)).all()
        if not same:
            assert (down[len(p["parent"]) : len(p["parent"]) + len(y)] == near.sum(0)).all()
        taken = sum(int(m.sum()) for *_, m in found)
        assert d != 2 or taken < near.sum() / 5  # whole nodes, not pairs of vectors


def write(spark, tmp_path, vectors: list, ids: list, kind: str = "float") -> str:
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for i, v in zip(ids, vectors)]
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, kept string").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("block,spread", [(4096, 0.03), (32, 0.03), (16, 0.004), (16, 0.3)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, block, spread):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(7)
    vectors = [v.astype(np.float32).tolist() for v in clusters(rng, 400, 12, spread)]
    vectors += vectors[:20] + [vectors[3]] * 150 + [[2 * x for x in vectors[5]]]
    vectors += [None, [], [0.0] * 12, [math.nan] + [1.0] * 11, [math.inf] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 0.0], [1.0, 0.1], [1.0] + [0.0] * 11, [-0.0] * 12]
    vectors += [[1e-30] * 12, [1e30] * 12]
    ids = rng.permutation(len(vectors)).tolist()
    got = {r["vec_id"]: tuple(r)[1:] for r in op12_embedding_dedup(spark, write(spark, tmp_path, vectors, ids)).collect()}
    links, label = brute(vectors)
    least: dict[int, int] = {}
    for place, group in enumerate(label):
        least[group] = min(least.get(group, 10**9), ids[place])
    assert got == {ids[k]: (links[k], least[label[k]], ids[k] == least[label[k]]) for k in range(len(vectors))}
    assert sum(links) > 20_000


def test_doubles_that_overflow_when_squared(spark, tmp_path):
    vectors = [[1e200, 1e200], [1e-200, 1e-200], [1.0, 0.9], [-1.0, 1.0]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op12_embedding_dedup(spark, write(spark, tmp_path, vectors, [3, 2, 1, 0], "double")).collect()}
    assert got == {3: (2, 1), 2: (2, 1), 1: (2, 1), 0: (0, 0)}


def test_missing_and_repeated_ids(spark, tmp_path):
    near, far = [1.0, 0.0], [0.0, 1.0]
    got = sorted(map(tuple, op12_embedding_dedup(spark, write(spark, tmp_path, [near, near, near, far, far, [1.0, 1.0]], [None, 5, 5, None, None, 9])).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 1, None, False), (None, 1, None, False), (9, 0, 9, True)], key=str)


def test_a_tight_group_over_many_blocks_costs_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in unit(np.ones((1, 20)) + 0.001 * rng.normal(size=(800, 20)))]
    written = []
    keep = embeddings.materialize
    monkeypatch.setattr(embeddings, "materialize", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    got = op12_embedding_dedup(spark, write(spark, tmp_path, vectors, list(range(800)))).collect()
    assert all(r["n_links"] == 799 and r["component_id"] == 0 for r in got)
    assert sum(df.count() for name, df in written if name == "notes") < 100

from __future__ import annotations

import random

import numpy as np
import pytest

from tensorloom.llm import ngram_join as nj
from tensorloom.llm.components import components
from tensorloom.llm.queries import QUERIES


def brute(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_edge_documents(spark, edge_docs, n, percent):
    df = spark.createDataFrame([(i, t) for i, t, *_ in edge_docs], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.jaccard_components(df, n=n, percent=percent).collect()}
    assert got == brute([(i, t) for i, t, *_ in edge_docs], n, percent)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op2_ngram_join"](spark, sf_dir).collect()}
    assert got == brute([tuple(r) for r in docs], 4, 85)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 3)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for i in range(30):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), n=4, percent=70).collect()}
    assert got == brute(docs, 4, 70)


def test_prefix_tree_and_bitmaps():
    rng = random.Random(5)
    for _ in range(150):
        base = [set(rng.sample(range(10**5), rng.randint(1, 60))) for _ in range(rng.randint(1, 4))]
        sets = []
        for _ in range(rng.randint(2, 25)):
            b = set(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                b.symmetric_difference_update({rng.choice(sorted(b)) if b and rng.random() < 0.5 else rng.randrange(10**5)})
            sets.append(b or {1})
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        percent, cross = rng.choice([50, 80, 85]), rng.choice([None, rng.randint(1, len(sets) - 1)])
        ok = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (cross is None or a < cross <= b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]

        def parts(edges, size=len(sets)):
            root = list(range(size))
            for a, b in edges:
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            out = []
            for x in range(size):
                while root[x] != x:
                    x = root[x]
                out.append(x)
            return out

        found = nj.links(arrays, percent, cross)
        assert {tuple(sorted(p)) for p in found} <= set(ok) and parts(found) == parts(ok)
        may = nj.may_link(list(map(nj.bitmap, arrays)), np.array([len(s) for s in sets]), percent, cross)
        assert all(may[a] and may[b] for a, b in ok)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), *[(100 + k, 101 + k) for k in range(60)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + k: 100 for k in range(61)}}


@pytest.mark.parametrize("small, large, percent", [(100, 400, 20), (70, 1100, 6), (120, 200, 60)])
def test_bitmaps_of_any_two_lengths_meet(small, large, percent):
    rng = np.random.default_rng(7)
    b = np.unique(rng.integers(0, 2**63, large, dtype=np.uint64))
    a = np.sort(b[:small])
    far = np.unique(rng.integers(0, 2**63, large, dtype=np.uint64))
    assert nj.may_link([nj.bitmap(x) for x in (a, b)], np.array([len(a), len(b)]), percent).all()
    assert nj.may_link([nj.bitmap(x) for x in (b, a)], np.array([len(b), len(a)]), percent, 1).all()
    assert not nj.may_link([nj.bitmap(x) for x in (b, far)], np.array([len(b), len(far)]), 90).any()

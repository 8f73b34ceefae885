from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import mixing
from tensorloom.llm.queries import QUERIES


def weights(tokens: dict, a: float) -> dict:
    raw = {k: (n / sum(tokens.values())) ** a for k, n in tokens.items() if n}
    return {k: raw.get(k, 0.0) / sum(raw.values()) for k in tokens}


def entropy(w: dict) -> float:
    return -sum(p * math.log(p) for p in w.values() if p)


def exponent(tokens: dict, budget, target, repeats) -> float:
    """A fine scan in place of the search."""
    live = {k: n for k, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0

    def passes(a):
        w = weights(live, a)
        deal = budget * sum(live.values()) if budget is not None else max(n / w[k] for k, n in live.items())
        return max(w[k] * deal / n for k, n in live.items())

    def first(ok):
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    a = 0.0 if target is None and repeats is not None else 1.0
    if target is not None and entropy(weights(live, 1.0)) < target * math.log(len(live)):
        a = first(lambda x: entropy(weights(live, x)) < target * math.log(len(live)))
    if repeats is not None:
        a = max(a, 0.0 if passes(0.0) <= repeats else first(lambda x: passes(x) <= repeats))
    return a


def shares(spark, tokens: dict) -> mixing.Shares:
    return mixing.Shares(spark.createDataFrame(list(tokens.items()), "_s string, t long"))


@pytest.mark.parametrize("budget", [1.0, None, 0.5])
@pytest.mark.parametrize("target, repeats", [(0.9, None), (None, 3.0), (0.999, 3.0), (0.5, None), (None, 1.25), (1.0, None)])
def test_exponent_meets_targets(spark, budget, target, repeats):
    t = {"a": 9000, "b": 900, "c": 100, "d": 0}
    assert math.isclose(mixing.choose_exponent(shares(spark, t), budget, target, repeats), exponent(t, budget, target, repeats), abs_tol=1e-6)


def test_one_source(spark):
    assert mixing.choose_exponent(shares(spark, {"a": 5}), 1.0, 0.5) == 1.0
    assert mixing.choose_exponent(shares(spark, {"a": 0}), 1.0, 0.5) == 1.0


def scheduled(spark, docs, budget, target, repeats, seed=7):
    """(id, epoch) of every copy, dealt in plain Python; hashes are Spark's."""
    rows = spark.createDataFrame([(str(i), s) for i, s, _ in docs], "k string, s string")
    h = {r["k"]: (r["a"], r["b"]) for r in rows.select("k", F.xxhash64(F.lit(seed), "k").alias("a"), F.xxhash64(F.lit(seed + 1), "k").alias("b")).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in docs}
    by = {}
    for i, s, _ in docs:
        by.setdefault(s, []).append(i)
    tokens = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    a = exponent(tokens, budget, target, repeats)
    w = weights(tokens, a)
    deal = budget * sum(tokens.values()) if budget is not None else max((n / w[s] for s, n in tokens.items() if n), default=0)
    out = Counter()
    for s, ids in by.items():
        goal = round(w[s] * deal)
        n_blocks = max(1, -(-len(ids) // mixing.BLOCK_DOCS))
        blocks = {}
        for i in ids:
            blocks.setdefault(h[str(i)][0] % n_blocks, []).append(i)
        if not tokens[s]:
            out.update((i, 0) for i in ids)
            continue
        for epoch in range(math.ceil(goal / tokens[s])):
            order = spark.createDataFrame([(s, epoch, b) for b in blocks], "s string, e int, b int").select("b", F.xxhash64(F.lit(seed), "s", "e", "b").alias("h")).collect()
            at = epoch * tokens[s]
            for r in sorted(order, key=lambda r: (r["h"] % (1 << 64), r["b"])):
                run = 0
                whole = at + sum(size[i] for i in blocks[r["b"]]) <= goal
                for i in sorted(blocks[r["b"]], key=lambda i: (h[str(i)][1], str(i))):
                    run += size[i]
                    if at < goal and (whole or at + run <= goal) or run == size[i] == 0 and whole:
                        out[i, epoch] += 1
                at += sum(size[i] for i in blocks[r["b"]])
    return a, w, deal, tokens, out


@pytest.mark.parametrize("budget, repeats, target", [(1.0, 4.0, 0.97), (None, 1.5, 0.97), (0.5, 2.0, 0.97), (None, 1.25, 0.9999), (1.0, None, 0.9999)])
def test_mix_against_plain_python(spark, budget, repeats, target):
    docs = [(i, "hot" if i % 3 else f"s{i % 4}" if i % 12 else None, " ".join(["w"] * (1 + i % 7))) for i in range(2400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    rows = mixing.mix(df, budget=budget, max_repeats=repeats, target_entropy=target).collect()
    a, w, deal, tokens, want = scheduled(spark, docs, budget, target, repeats)
    assert Counter((r["doc_id"], r["epoch"]) for r in rows) == want
    got = Counter()
    for r in rows:
        got[r["source"]] += r["n_tokens"]
        assert math.isclose(r["weight"], w[r["source"]], rel_tol=1e-9) and 0 <= r["mix_key"] <= 1
    # The realised shares are the weights, up to the text that the budget ends in.
    assert all(w[s] * deal - 8 <= n <= w[s] * deal + 1 for s, n in got.items()) and set(got) == set(tokens)
    if budget is None:
        assert len({r["doc_id"] for r in rows}) == len(docs)


def test_query_tempers(spark):
    """The registered query has an exponent strictly between 0 and 1 and realises it."""
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    a, w, deal, tokens, want = scheduled(spark, docs, None, 0.9999, 1.25)
    assert 0.05 < a < 0.95
    rows = QUERIES["op9_mixing"](spark, d).collect()
    got = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert not got - want and not want - got and any(r["epoch"] == 1 for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(docs)


def test_many_sources_and_clashing_columns(spark):
    docs = [(i, f"s{i // 3}", "x y", 5, 6) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, _total int, Epoch int")
    out = mixing.mix(df, budget=None, max_repeats=2.0)
    assert out.count() == 3000 and out.where("epoch > 0").count() == 0


def test_sources_are_dealt_side_by_side(spark):
    docs = [(i, "a" if i % 4 else "b", "x y z") for i in range(4000)]
    rows = sorted(mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), max_repeats=1.0).collect(), key=lambda r: r["mix_key"])
    for k in range(0, 4000, 1000):
        assert 0.15 < sum(r["source"] == "b" for r in rows[k : k + 1000]) / 1000 < 0.35


def test_texts_without_tokens_and_rows_without_ids(spark):
    docs = [(1, "a", None), (2, "a", ""), (3, "b", "x y"), (None, None, "z"), (None, None, "z"), (3, "b", "x y")]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), budget=None, max_repeats=1.0).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, _, t in docs)

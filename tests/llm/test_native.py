"""Line dedup, license scan, sharding and fingerprints."""

from __future__ import annotations

import functools
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import fingerprint as fp
from tensorloom.llm import license_scan as ls
from tensorloom.llm.line_dedup import line_dedup
from tensorloom.llm.queries import QUERIES
from tensorloom.llm.sharding import shard_documents


@pytest.mark.parametrize("name", ["op3_license_scan", "op6_line_dedup", "op7_sharding", "op8_fingerprints"])
def test_no_python_in_plans(spark, edge_dir, name):
    plan = QUERIES[name](spark, edge_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_line_dedup_texts(spark):
    same = "The same line in each document."
    docs = [(k, f"own {k}\n {same.upper() if k == 2 else same}\t\nend") for k in range(4)] + [(9, None)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (3, 1, "own 0\nend"), 1: (3, 1, "own 1\nend"), 2: (3, 1, "own 2\nend"), 3: (3, 0, docs[3][1]), 9: (1, 0, "")}


def test_line_dedup_rows_without_or_with_repeated_ids(spark):
    """Rows without an id count towards no line and lose none; rows of one id are one document."""
    same, other = "The same line in each document.", "Another line of some length."
    schema, at = "doc_id long, text string", lambda df: sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    two = [(1, same), (2, same), (None, same), (2, same)]
    assert at(line_dedup(spark.createDataFrame(two, schema))) == sorted([(i, 1, 0, t) for i, t in two], key=str)
    three = [*two, (3, f"{same}\n{other}\n{same}"), (2, f"x\n{same.upper()}\ny"), (None, f"{same}\n{same}")]
    want = [(1, 1, 1, ""), (2, 1, 1, ""), (2, 1, 1, ""), (2, 3, 1, "x\ny"), (3, 3, 0, three[4][1]), (None, 1, 0, same), (None, 2, 0, f"{same}\n{same}")]
    assert at(line_dedup(spark.createDataFrame(three, schema))) == sorted(want, key=str)


def test_line_dedup_is_linear_in_a_text(spark):
    text = "\n".join(f"a line that three documents have, number {k}" for k in range(50_000))
    docs = spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")
    started = time.time()
    got = {r["doc_id"]: (r["n_dropped"], len(r["kept_text"])) for r in line_dedup(docs).collect()}
    assert got == {0: (50_000, 0), 1: (50_000, 0), 2: (0, len(text))} and time.time() - started < 60


def test_license_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose = "\n".join(f"some unrelated words number {k} here" for k in range(10))
    files = [("a/LICENSE", mit), ("a/x.txt", prose), ("a/b/c/y.txt", prose), ("a/b/z.txt", f"{gpl}\n{prose}"), ("a/d/COPYING", f"{gpl}\n{prose}"), ("a/d/e/w.txt", ""), ("q/v.txt", None), ("a/m.txt", f"{prose}\nthey mention the MIT building and a driving license in one long line of text")]
    got = {r["path"]: (r["license"], r["license_from"], r["license_dir"]) for r in ls.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "file", None),
        "a/x.txt": ("MIT", "inherited", "a"),
        "a/b/c/y.txt": ("MIT", "inherited", "a"),
        "a/b/z.txt": ("GPL-3.0", "header", None),
        "a/d/COPYING": ("GPL-3.0", "file", None),
        "a/d/e/w.txt": ("GPL-3.0", "inherited", "a/d"),
        "q/v.txt": (None, "none", None),
        "a/m.txt": ("MIT", "inherited", "a"),
    }


def test_license_anchors_lose_nothing():
    import math
    import random

    rng = random.Random(1)
    w = {("x", 0): {f"t{k}": rng.uniform(0.2, 5) for k in range(9)}, ("y", 0): {"a": 1.0}}
    need = ls.anchors(w, 0.7)
    for t in w.values():
        for _ in range(2000):
            line = {k: rng.uniform(0, 3) for k in rng.sample(sorted(t), rng.randint(1, len(t)))}
            cos = sum(v * t[k] for k, v in line.items()) / math.sqrt(sum(v * v for v in line.values()) * sum(v * v for v in t.values()))
            assert cos < 0.7 or need & set(line)


def check_shards(rows, docs, n):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and max(counts.values()) - min(counts.get(k, 0) for k in range(n)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_sharding(spark, edge_dir, edge_docs):
    rows = QUERIES["op7_sharding"](spark, edge_dir).collect()
    check_shards(rows, edge_docs, 8)
    text = {i: (t or "").encode() for i, t, *_ in edge_docs}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["size"] == len(text[r["doc_id"]]) + 1 and r["law"] == "rows" and r["grown_shard"] is None for r in rows)


@pytest.mark.parametrize("hot", [0, 300, 900])
def test_sharding_keeps_groups_together(spark, hot):
    docs = [(i, "hot" if i < hot else f"group {i // 3}") for i in range(1000)]
    rows = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check_shards(rows, docs, 8)
    where, text = defaultdict(set), dict(docs)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    split = [g for g, s in where.items() if len(s) > 1 and g != "hot"]
    # About one group for each shard that gives or takes what exceeds an even share.
    assert len(split) <= 9
    assert len(where["hot"]) <= {0: 0, 300: 6, 900: 8}[hot]


def least_cut(sizes, n):
    """The fewest groups cut in any even split, by trying all ways to pack them whole."""
    total = sum(sizes)
    goals = tuple(sorted(total // n + (k < total % n) for k in range(n)))

    @functools.cache
    def most(k, room):
        if k == len(sizes):
            return 0
        best = most(k + 1, room)
        for j, r in enumerate(room):
            if r >= sizes[k] and r not in room[:j]:
                best = max(best, 1 + most(k + 1, tuple(sorted(room[:j] + (r - sizes[k],) + room[j + 1 :]))))
        return best

    return len(sizes) - most(0, goals)


@pytest.mark.parametrize("seed", range(3))
def test_sharding_against_all_packings(spark, seed):
    """On tiny corpora, near the best of all even splits; sums, slots and counts exact."""
    rng = random.Random(seed)
    sizes = [rng.randint(2, 5) for _ in range(8)]
    texts = [f"g{k}" for k, m in enumerate(sizes) for _ in range(m)] + [f"alone {k}" for k in range(rng.choice([0, 3, 12]))]
    docs = list(enumerate(texts))
    rows = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), n_shards=3).collect()
    check_shards(rows, docs, 3)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    cut = sum(len(s) > 1 for s in where.values())
    assert least_cut(tuple(sizes + [1] * (len(texts) - sum(sizes))), 3) <= cut <= 3


def shingles(t, n=5):
    w = t.encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(spark, rows, docs):
    """Rows as (n_chars, edited, a, b, c) against brute force; equal ids go by the hash of their texts."""
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, hashes[d[1]]))
    want = Counter()
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        want[i, len(t), t[: len(t) - half] + after[:half], t, after] += 1
    texts = sorted({x for w in want for x in w[2:]})
    sketch = {r["t"]: tuple(r["s"]) for r in fp.with_sketch(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), "s").collect()}
    got = Counter((r["doc_id"], r["n_chars"], r["edited"], tuple(r["a"]), tuple(r["b"]), tuple(r["c"])) for r in rows)
    assert got == Counter({(i, n, e, sketch[t], sketch[e], sketch[x]): m for (i, n, e, t, x), m in want.items()})
    return sketch


def test_fingerprints(spark, edge_dir, edge_docs):
    """Whole rows against brute force, and the estimates against exact similarities."""
    docs = [(i, t or "") for i, t, *_ in edge_docs]
    sketch = check_fingerprints(spark, fp.edited_fingerprints(spark.read.parquet(f"{edge_dir}/documents.parquet")).collect(), docs)
    for t, s in sketch.items():
        # Below K shingles a sketch holds one hash for each.
        assert len(s) == min(fp.K, len(shingles(t))) and list(s) == sorted(set(s))
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, edge_dir).collect()}
    docs, seen = sorted(docs), {}
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited, r = t[: len(t) - half] + after[:half], got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            both = len(shingles(t) | shingles(other))
            # Exact as long as the union fits the sketch.
            assert abs(near - jaccard(shingles(t), shingles(other))) < (1e-9 if both <= fp.K else 0.2)
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_fingerprints_keep_every_row(spark, n):
    """Repeated rows, repeated and missing ids, over more ranges than rows and fewer."""
    docs = [(None if k % 3 == 0 else k // 4, f"text {k % 5} of some words and {k % 2} more of them") for k in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check_fingerprints(spark, fp.edited_fingerprints(df).collect(), docs)


def test_fingerprint_ranges_are_not_in_the_plan(spark):
    """The plan does not grow with the shuffle partitions, and any number of ranges gives the same rows."""
    docs = [(None if k % 9 == 0 else k // 2, f"text {k} of some words and {k % 2} more of them") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        sizes = []
        for parts in (4, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            out = fp.edited_fingerprints(df)
            sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
            check_fingerprints(spark, out.collect(), docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # A step of the bisection for each doubling.
    assert sizes[1] < 3 * sizes[0]


def test_fingerprints_of_one_hot_row(spark):
    docs = [(None, "the same few words again")] * 25_000 + [(1, "x")]
    rows = fp.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows.count() == 25_001


def test_sketches_merge(spark):
    a, b = [" ".join(f"w{k}" for k in range(lo, hi)) for lo, hi in ((0, 900), (300, 1200))]
    df = spark.createDataFrame([(1, a), (1, b), (2, "")], "g long, t string")
    df = fp.with_sketch(df, F.col("t"), "s")
    m = {r["g"]: r["s"] for r in fp.merged(df, "g", "s").collect()}
    parts = [r["s"] for r in df.where("g = 1").collect()]
    assert m[1] == sorted(set(parts[0]) | set(parts[1]))[: fp.K] and m[2] == []
    row = df.where("g = 1").agg(F.collect_list("s").alias("x")).select(fp.resemblance(F.col("x")[0], F.col("x")[1]).alias("j"), fp.containment(F.col("x")[0], F.col("x")[1]).alias("c"), fp.distinct_shingles(F.col("x")[0]).alias("n"), fp.read(fp.written(F.col("x")[0])).alias("back"), F.col("x")[0].alias("s")).first()
    assert abs(row["j"] - 596 / 1196) < 0.15 and abs(row["c"] - 596 / 896) < 0.2 and abs(row["n"] - 896) < 250 and row["back"] == row["s"]


def test_sharding_with_ballast_cuts_no_group(spark):
    docs = [(i, f"group {i // 3}" if i < 300 else f"alone {i}") for i in range(1000)]
    rows = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    check_shards(rows, docs, 8)
    where, text = defaultdict(set), dict(docs)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())

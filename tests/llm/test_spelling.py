from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tensorloom.llm.queries import op11_spelling_variants
from tensorloom.llm.spelling import KEY_CHARS, roots, slipped_words, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(texts: list[tuple]) -> dict[str, tuple]:
    counts: Counter[str] = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)

    def root(w: str) -> str:
        return w if out[w][0] is None else root(out[w][0])

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def rows(df) -> dict[str, tuple]:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def made_texts() -> list[tuple]:
    rng = random.Random(5)
    stems = ["aabbcc", "aabbcd", "aabbcé", "bananas", "banana", "bananass", "ététété", "Ététété", "wonder", "wonders", "wanders", "wander"]
    out = []
    for k in range(300):
        ws = []
        for _ in range(30):
            w = rng.choice(stems)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abnñ") + w[at:], w[:at] + rng.choice("aboe") + w[at + 1 :]])
            ws.append(rng.choice([w, w, w.upper(), w + "7", w + "×"]))
        out.append((k if k % 50 else None, rng.choice([" ", "-", "\n", "1"]).join(ws)))
    out += [(2000, "alphabet " * 160), (2001, "Alphabex " * 31), (2002, "alphaxex," * 6)]
    out += [(7, out[7][1])] * 3 + [(1000, None), (1001, ""), (1002, "x" * 300_000)]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = made_texts()
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = rows(op11_spelling_variants(spark, str(tmp_path))), brute(texts)
    assert got == want
    assert any(f for f, *_ in want.values()) and any(v[1] not in (w, v[0]) for w, v in want.items())


def test_long_words_go_by_hashes(spark):
    long = "ab" * KEY_CHARS
    words = [(long, 60), (long[:-1], 5), (long[:-1] + "c", 10), (long[:70] + "z" + long[71:], 7), (long + "a", 6), ("#" * 3 + "abc", 5)]
    got = rows(spelling_variants(spark.createDataFrame(words, "word string, n long")))
    near_long = [w for w, _ in words if near(w, long)]
    assert got[long][3] == len(near_long) == 4
    assert all(got[w][0] == long for w in near_long)


def test_counts_of_a_word_add_up_over_rows(spark):
    got = rows(spelling_variants(spark.createDataFrame([("banana", 2), ("banana", 3), ("bananas", 4)], "word string, n long")))
    assert got == {"banana": (None, "banana", 5, 0, None)}


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8])
def test_chains_end_at_their_roots(spark, length):
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(length)]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string"), length).collect()}
    assert got == {f"w{k:02}": f"w{length:02}" for k in range(length)}


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "banana banana", 3.0, "x")], "doc_id long, text string, n double, word string")
    assert {r["word"]: r["n"] for r in slipped_words(docs, 6).groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"banana": 2}

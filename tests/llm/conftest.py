from __future__ import annotations

import random

import pytest

WORDS = "stone river green often light paper seven window quiet morning table under bridge winter apple cloud market singing horse north".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs():
    """Nulls, empty and very long texts, ties, repeated texts and near copies."""
    rng = random.Random(3)
    base = [sentence(rng, n) for n in (60, 80, 120, 30)]
    shared = "A line that several documents have in common."
    texts = [None, "", " \t\n ", "one", "two words", "ÀÉ ñ σΣ ß 日本", base[0], base[0], base[0] + " tail end", base[1], base[1].upper()]
    words = base[2].split()
    for k in range(6):
        w = list(words)
        w[k * 7] = "changed"
        texts.append(" ".join(w))
    texts += [f"{sentence(rng, 25)}\n{shared}\n{sentence(rng, 25)}" for _ in range(5)]
    texts += [f"  {shared.upper()}  \nshort\nshort", "x " * 3000 + "y", "\n".join([base[3]] * 40), "a\r\nb\x0bc\x0cd", "Licensed under the Apache License, Version 2.0.", f"{base[3]}\nReleased under the MIT License.\n{base[1]}"]
    texts += ["mail bob.smith@example.org or +1 (017) 555-7713, card 4952935900253052, host 10.1.2.3."] * 3
    texts += [sentence(rng, 40) for _ in range(20)]
    return [(i * 3 + 1, t, rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TALK = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def others(spark, d, talk: list[tuple], vectors: list[tuple], extra: str = "", values: tuple = ()) -> None:
    spark.createDataFrame([(*r, *values) for r in talk], TALK + extra).write.parquet(str(d / "conversations.parquet"))
    spark.createDataFrame([(*r, *values) for r in vectors], VECTORS + extra).write.parquet(str(d / "embeddings.parquet"))


EDGE_TALK = [(c, t, ("user", "assistant")[t % 2], x) for c in range(9) for t, x in enumerate(["Hi.", "Yes?", "", None, "Hi.", "cut"])] + [(20, None, None, None), (None, 1, "user", "x.")]
EDGE_VECTORS = [(k, v, 1) for k, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 0.0], None, [], [float("nan"), 1.0], [None, 1.0], [1.0, 0.0], [1.0], [0.0, 1.0]])]


@pytest.fixture(scope="session")
def edge_dir(spark, edge_docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("edge")
    spark.createDataFrame(edge_docs, SCHEMA).repartition(3).write.parquet(str(d / "documents.parquet"))
    labels = [(i, 1, int(k % 4 == 0)) for k, (i, *_) in enumerate(edge_docs)] + [(10**6, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    others(spark, d, EDGE_TALK, EDGE_VECTORS)
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    others(spark, d, [], [])
    return str(d)


@pytest.fixture(scope="session")
def odd_dir(spark, edge_docs, tmp_path_factory):
    """Missing and repeated ids, and columns whose names clash with added ones."""
    d = tmp_path_factory.mktemp("odd")
    rows = [(None if k % 11 == 0 else i if k % 5 else edge_docs[max(k - 1, 0)][0], *rest, "clash", 0.5) for k, (i, *rest) in enumerate(edge_docs)]
    spark.createDataFrame(rows, SCHEMA + ", kept_text string, Score double").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    others(spark, d, EDGE_TALK * 2, [(None if k % 3 == 0 else 1, *rest) for k, *rest in EDGE_VECTORS], ", Kept string, AT double, form string, n int", ("clash", 0.5, "clash", 3))
    return str(d)

from __future__ import annotations

import itertools
import math
import random
import zlib

import pytest

from tensorloom.llm import toxicity as tox
from tensorloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def restorer():
    words = "idiot stupid moron window table morning people nothing trash clown bridge little better letter".split()
    counts = {}
    for w in words * 50:
        p = f"  {w} "
        for k in range(len(p) - 2):
            counts[p[k : k + 3]] = counts.get(p[k : k + 3], 0) + 1
    return tox.Restorer(counts)


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("m0r0n!", "moron"), ("stuuuupid", "stupid"), ("tr4$h", "trash"), ("c|own", "clown"), ("letter", "letter"), ("2024", "2024"), ("b2b", None)])
def test_tokens(restorer, seen, meant):
    got = restorer.token(seen)
    assert meant is None or got == meant


def test_spelled_and_texts(restorer):
    assert [x for *_, x in restorer.spelled("you i d i o t now")] == ["idiot"]
    assert restorer.text("You M-O-R-O-N, 1d10t!") == "you moron, idiot!"
    assert restorer.text(None) == ""


def test_disguises_of_any_length(restorer):
    words = "people window table morning nothing bridge little better moron".split() * 40
    run = " ".join("".join(words))
    assert len(run) > 3000 and {"moron"} <= set("".join(x for *_, x in restorer.spelled(f"say {run} now")).split())
    assert restorer.token("m" + "0" * 60 + "ron") == "moron" and restorer.token("1d10" + "t" * 90) == "idiot"
    assert restorer.token("-".join(["m0r0n"] * 20)) == "moron" * 20


@pytest.mark.parametrize("seen, meant", [("i d ! o t", "idiot"), ("s t u p ! d", "stupid"), ("t r @ $ h", "trash"), ("| d i o t", "idiot"), ("m-0-r-*-n", "moron"), ("m o r o n !", "moron")])
def test_spelled_with_leet_signs(restorer, seen, meant):
    assert [x for *_, x in restorer.spelled(f"you {seen} now")] == [meant]


def test_signs_alone_are_no_spelled_run(restorer):
    assert not list(restorer.spelled("* * * * * | | | | ! ! ! !  *********"))


def test_disguised_words_are_scored(spark):
    bad, good = ["idiot", "moron", "stupid"], "the people had a better window on this little bridge every morning".split()
    docs = [(i, f"{' '.join(good[i % 5 :])} {bad[i % 3] if i % 4 == 0 else 'table'}") for i in range(400)] + [(900, "such an 1d10t there"), (901, "you m o r o n there"), (902, "such a table there"), (903, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(12345, 1)]
    out = tox.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["predicted"] for i in (900, 901, 902, 903)] == [1, 1, 0, 0]
    assert all(got[i]["predicted"] == y for i, y in labels if i < 400)


@pytest.mark.parametrize("sf, recall", [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_held_out_rows(spark, sf, recall):
    """Recall and precision by themselves: with one toxic row in eight, accuracy would hide either."""
    d = f"/root/testdata/{sf}"
    rows = QUERIES["op10_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    toxic, clean = ([r["predicted"] for r in rows if r["held_out"] and r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_viterbi_against_all_strings(restorer):
    """The decoded string is the best of all that a small lattice holds."""
    rng = random.Random(8)
    model = restorer.model
    for _ in range(300):
        token = "".join(rng.choice("1d0tm$a!ooo@n*e") for _ in range(rng.randint(2, 7)))
        options = tox.lattice(token)
        best = -math.inf
        for way in itertools.product(*options):
            text, score, two = "".join(x for x, _ in way), -sum(c for _, c in way), "  "
            for c in text + " ":
                score += model.logp(two, c)
                two = two[1] + c
            best = max(best, score)
        text, per_letter = model.best(options)
        assert math.isclose(per_letter * (len(text) + 1), best, rel_tol=1e-9)


def test_scores_against_plain_counting(spark):
    """Evidence counted and scored without memo, batches or Spark."""
    bad, good = ["idiot", "moron", "stupid"], "the people had a better window on this little bridge every morning".split()
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(good, k=rng.randint(3, 40)) + ([bad[i % 3]] * (1 + i % 4) if i % 4 == 0 else []))) for i in range(300)] + [(300, ""), (301, None), (302, "1d10t " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = [(i, int(i % 4 == 0)) for i in range(300)]
    model = tox.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    restorer, text = tox.Restorer(model.counts), dict(docs)
    size = [sum(len((text[i] or "").split()) for i, y in labels if y == k) for k in (1, 0)]
    for f, w in model.weights.items():
        c = [sum(f in tox.evidence(restorer.token(t)) for i, y in labels if y == k for t in text[i].split()) for k in (1, 0)]
        assert math.isclose(w, min(math.log(c[0] / size[0] / ((c[1] + 0.5) / size[1])), tox.MOST), rel_tol=1e-9)
    assert {"=idiot", "=moron", "=stupid"} <= set(model.weights)
    for r in df.withColumn("score", model.score(tox.F.col("text"))).collect():
        found = [max((model.weights.get(f, 0.0) for f in tox.evidence(restorer.token(w))), default=0.0) for w in (r["text"] or "").lower().split()]
        hits = sum(v > 0 for v in found)
        ways = [math.exp(sum(found) + hits * math.log(x) - (x * model.rates[0] - model.rates[1]) * len(found)) for x in tox.STRENGTHS]
        odds = model.prior / (1 - model.prior) * (sum(ways) / len(ways) if found else 1)
        assert math.isclose(r["score"], odds / (1 + odds), rel_tol=1e-9)


def test_repeats_in_one_text_are_no_evidence():
    assert tox._least_gain([(0, 1000), (90, 1)], 0.1) == math.inf and tox._least_gain([(0, 1000), (90, 10)], 0.1) == 9.0


def test_labels_are_no_inputs(spark, edge_dir):
    a = {r["doc_id"]: r["score"] for r in QUERIES["op10_toxicity"](spark, edge_dir).collect()}
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{edge_dir}/labels.parquet").select("doc_id", "toxic").where(~tox.held_out(tox.F.col("doc_id")))
    assert a == {r["doc_id"]: r["score"] for r in tox.toxicity(docs, labels).collect()}


def test_the_largest_label_of_an_id_counts(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{edge_dir}/labels.parquet").select("doc_id", "toxic")
    twice = labels.unionAll(labels.where("toxic = 1").selectExpr("doc_id", "0 AS toxic"))
    once, again = ({r["doc_id"]: r["score"] for r in tox.toxicity(docs, x).collect()} for x in (labels, twice))
    assert once == again

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
from tensorloom.llm.ngram_join import jaccard_components


def test_stages(spark, sf_dir):
    """Each stage against what its operator says about its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.count()]
    for _, stage in cp.STAGES[:4]:
        before = docs
        docs = cp.materialize(stage(spark, docs, sf_dir))
        assert docs.columns == cp.COLUMNS
        kept.append(docs.count())
        if stage is cp.drop_near_copies:
            got = Counter(r["component_id"] for r in jaccard_components(before).collect())
            assert sorted(got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
            assert jaccard_components(docs).where("doc_id <> component_id").count() == 0
    assert kept[0] > kept[1] == kept[2] > kept[3] <= kept[4]
    ids = {r["doc_id"] for r in before.collect()}
    assert ids == {r["doc_id"] for r in docs.collect()}
    last = cp.encode(spark, docs, sf_dir)
    assert last.count() == kept[4] and last.where("octet_length(ids_packed) <> 4 * n_tokens").count() == 0


def test_edge_and_empty(spark, edge_dir, empty_dir, odd_dir):
    assert cp.run(spark, empty_dir).count() == 0
    assert cp.run(spark, edge_dir).count() > 0
    assert cp.run(spark, odd_dir).count() > 0


def test_near_copies_go_by_rows(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " tail"), (5, c), (5, d), (9, a), (7, d), (None, None), (3, None), (3, ""), (4, "e")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = cp.drop_near_copies(spark, docs, "")
    got = Counter((r["doc_id"], (r["text"] or "")[:2]) for r in kept.collect())
    assert got == Counter({(9, "a0"): 1, (None, "b0"): 1, (5, "c0"): 1, (5, "d0"): 1, (None, ""): 1, (3, ""): 2, (4, "e"): 1})
    # Mixing and encoding lose none of them.
    mixed = cp.materialize(cp.mix_sources(spark, kept, ""))
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} == {(r["doc_id"], r["text"]) for r in kept.collect()}


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import pii
from tensorloom.llm.queries import QUERIES


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at, covered, seen, dup = {}, set(), set(), 0
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            for i in v:
                covered.update(range(i, i + 8))
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality(spark, edge_dir, edge_docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_rules"](spark, edge_dir).collect()}
    for i, t, *_ in edge_docs:
        m = measured(t)
        assert tuple(got[i])[1:6] == m
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_quality_follows_labels(spark, sf_dir):
    out = QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    rows = [(r["quality"], r["kept"]) for r in out.collect()]
    assert all(kept for q, kept in rows if q == 1) and sum(kept for q, kept in rows if q == 0) <= 0.1 * sum(q == 0 for q, _ in rows)


def plain_spans(t):
    t = t or ""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice(rng.choice(["a@b._-%+ ", "0123456789.", "1234 -", "+1( )234-5.", "a@b.c"])) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []


def plain_terms(texts, share=0.7):
    """Disclosing words, counted in the plainest way."""
    spans = [plain_spans(t) for t in texts]
    words = []
    for t, found in zip(texts, spans):
        inside = lambda m, found=found: any(m.start() < e and s < m.end() for s, e, _ in found)
        words.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", t or "")])
        words[-1] = [(w, inside(m)) for w, m in zip(words[-1], re.finditer(r"[^\W_]{3,}", t or ""))]
    docs, together, kinds = Counter(), Counter(), Counter()
    for found, ws in zip(spans, words):
        docs.update({w for (_, _, w), _ in ws})
        has = {k for _, _, k in found} | ({4} if found else set())
        kinds.update(has)
        together.update((w, k) for w in {w for (_, _, w), hid in ws if not hid} for k in has)
    out = set()
    for (w, k), x in together.items():
        n, p, z = docs[w], x / docs[w], pii.Z
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        p_kind = kinds[k] / len(texts)
        if p_kind < 1 and math.log2(low / p_kind) >= share * -math.log2(p_kind) - 1e-12:
            out.add(w)
    return [sorted([*found, *[(a, b, -1) for (a, b, w), hid in ws if not hid and w in out]], key=lambda s: (s[0], s[2] % 8, s[1])) for found, ws in zip(spans, words)]


def plain_clean(t, spans):
    out, at, t = "", 0, t or ""
    for a, b, k in spans:
        if a >= at:
            out += t[at:a] + ("[TERM]" if k < 0 else f"[{pii.KINDS[k].upper()}]")
        at = max(at, b)
    return out + t[at:]


def check_pii(got, docs):
    assert len(got) == len(docs)
    found = 0
    for (i, t), spans in zip(docs, plain_terms([t for _, t in docs])):
        base = [s for s in spans if s[2] >= 0]
        named = lambda ss: ",".join(f"{pii.KINDS[k] if k >= 0 else 'term'}:{a}:{b}" for a, b, k in ss)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        assert (r["base_sha256"], r["spans"], r["sanitised_sha256"]) == (sha(named(base)), named(spans), sha(plain_clean(t, spans)))
        assert (r["n_terms"], r["n_spans"]) == (len(spans) - len(base), len(spans))
        found += r["n_terms"]
    return found


def test_pii_query(spark, edge_dir, edge_docs):
    check_pii({r["doc_id"]: r for r in QUERIES["op5_pii"](spark, edge_dir).collect()}, [(i, t) for i, t, *_ in edge_docs])


def test_terms_of_a_corpus(spark):
    """The whole query against brute force where words do disclose: secrets and their carriers are found."""
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op5_pii"](spark, d).collect()}
    assert check_pii(got, docs) > 10
    secret = [i for i, t in docs if t and re.search(r'token = "[0-9a-f]{40}"', t)]
    assert secret and all(got[i]["n_terms"] > 0 for i in secret)


ZEBULON = [f"{' '.join(random.Random(i).choices([f'word{chr(97 + k)}' for k in range(20)], k=9))} {'agent zebulon ' if i % 10 == 0 else ''}{'a.b@c.de' if i % 10 == 0 and i else ''}" for i in range(200)]


@pytest.mark.parametrize("sent", [pii.SENT_WORDS, 0])
def test_disclosing_words_and_sanitising(spark, sent):
    """Both ways of looking words up; the word goes where no entity stands beside it, too."""
    df = spark.createDataFrame(list(enumerate(ZEBULON)), "doc_id long, text string").withColumns({"Spans": F.lit(1), "_row": F.lit(2)})
    rows = {r["doc_id"]: r for r in pii.find_pii(df, sent_words=sent).collect()}
    assert len(rows) == 200
    assert [(ZEBULON[0][s["s"] : s["e"]], s["k"]) for s in rows[0]["spans"]] == [("agent", -1), ("zebulon", -1)]
    assert [(ZEBULON[10][s["s"] : s["e"]], s["k"]) for s in rows[10]["spans"]] == [("agent", -1), ("zebulon", -1), ("a.b@c.de", 0)]
    assert not rows[1]["spans"] and rows[1]["sanitised"] == ZEBULON[1]
    assert rows[10]["sanitised"].endswith("[TERM] [TERM] [EMAIL]")
    gone = pii.find_pii(df, mode="remove", sent_words=sent).where("doc_id = 10").first()["sanitised"]
    assert gone.strip() == ZEBULON[10].split(" agent")[0]


def test_words_on_other_lines_and_long_words(spark):
    rng = random.Random(5)
    filler = [f"word{chr(97 + k)}" for k in range(20)]
    far, long = " ".join(rng.choices(filler, k=60)), "zebulon" * 20
    docs = [(i, f"{long}\n{far}\na.b@c.de\nsigned {long.upper()}" if i % 10 == 0 else far) for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [docs[0][1][s["s"] : s["e"]] for s in got[0]] == [long, "a.b@c.de", "signed", long.upper()] and not got[1]


def test_rare_words_disclose_rare_kinds(spark):
    docs = [(i, "mails of quorx a.b@c.de" if i < 2 else "mails of table") for i in range(400)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [docs[1][1][s["s"] : s["e"]] for s in got[1]] == ["quorx", "a.b@c.de"] and not got[2]

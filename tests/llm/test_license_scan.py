"""License scan against plain Python: TF-IDF cosine of every passage, and ancestors walked one by one."""

from __future__ import annotations

import math
import random
import textwrap
from collections import Counter

import pytest
import regex

from tensorloom.llm import license_scan as ls
from tensorloom.llm.queries import QUERIES

PROSE = "\n".join(f"the of and to in is that {k} with for are this onle thati erwh" for k in range(40))


def words(t):
    return regex.findall(ls.WORD, (t or "").lower())


def wrapped(t, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(t, 70))


def plain_scan(files):
    """(license, score, from, dir) of each (path, text)."""
    tf = {(lic, k): Counter(words(t)) for lic, ts in ls.TEMPLATES.items() for k, t in enumerate(ts)}
    vocab = {w for t in tf.values() for w in t}
    df = Counter(w for _, t in files for w in set(words(t)) & vocab)
    idf = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1
    weigh = lambda c: {w: (1 + math.log(n)) * idf(w) for w, n in c.items()}
    norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
    templates = {k: weigh(c) for k, c in tf.items()}
    need = ls.anchors(templates, ls.COSINE)
    # An anchor is a whole run of letters and digits, which may be a part of a word.
    starts = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, sorted(need))) + r")(?![\p{L}\p{N}])")
    own = []
    for path, text in files:
        text = text or ""
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if starts.search(x.lower())]
        passages = ["\n".join(lines[i : i + w]) for i in at for w in ls.WINDOWS if i + w <= len(lines)] + ([text] if at else [])
        best = None
        for p in passages:
            x = weigh(Counter(words(p)))
            for (lic, _), t in templates.items():
                dot = sum(v * t[w] for w, v in x.items() if w in t)
                score = round(dot / (norm(x) * norm(t)), 6) if dot else 0.0
                if score >= ls.COSINE:
                    best = min(best or (0,), (-score, lic, -len(words(p)))) if best else (-score, lic, -len(words(p)))
        name = path.split("/")[-1] if path is not None else ""
        share = -best[2] / len(words(text)) if best else 0
        own.append((best, bool(best) and (share >= ls.FILE_SHARE or regex.search(ls.LICENSE_NAMES, name) is not None)))
    by_dir = {}
    for (path, _), (best, is_file) in zip(files, own):
        if is_file and path is not None:
            d = path.rpartition("/")[0]
            by_dir[d] = min(by_dir.get(d, best[:2]), best[:2])
    out = []
    for (path, _), (best, is_file) in zip(files, own):
        if best:
            out.append((best[1], -best[0], "file" if is_file else "header", None))
            continue
        d = path.rpartition("/")[0] if path is not None else None
        while d is not None and d not in by_dir:
            d = (d.rpartition("/")[0] if "/" in d else "") if d else None
        out.append((by_dir[d][1], None, "inherited", d) if d is not None else (None, None, "none", None))
    return out


def rows(df, key):
    return {r[key]: (r["license"], r["license_score"], r["license_from"], r["license_dir"]) for r in df.collect()}


def same(got, want):
    return got[0] == want[0] and got[2:] == want[2:] and (got[1] is None) == (want[1] is None) and (got[1] is None or abs(got[1] - want[1]) < 2e-6)


TREE = [
    ("mit/LICENSE", "Copyright (c) 2020 Some Body\n\n" + wrapped(ls.MIT)),
    ("mit/sub/deep/x.c", PROSE),
    ("mit/sub/y.c", ""),
    ("bsd/LICENSE.txt", wrapped(ls.BSD_HEAD + ls.BSD_TWO + ls.BSD_THIRD + ls.BSD_TAIL)),
    ("bsd/two/LICENSE", wrapped(ls.BSD_HEAD + ls.BSD_TWO + ls.BSD_TAIL)),
    ("bsd/two/z.c", PROSE),
    ("isc/COPYING", wrapped(ls.ISC)),
    ("heads/lesser.c", "/*\n" + wrapped(ls._gnu("Lesser ")[3], " * ") + "\n */\n" + PROSE),
    ("heads/affero.c", wrapped(ls._gnu("Affero ")[2], "// ") + "\n" + PROSE),
    ("heads/bsd.c", PROSE + "\n" + wrapped(ls.BSD_HEAD) + "\n" + PROSE),
    ("heads/apache.c", wrapped(f"{ls.APACHE_HEAD} {ls.APACHE_TAIL}", "# ") + "\n" + PROSE),
    ("heads/long.c", (PROSE + "\n") * 40 + wrapped(ls.MIT) + ("\n" + PROSE) * 40),
    ("top.txt", PROSE),
    (None, "Released under the MIT License."),
    (None, PROSE),
    ("mit/other", "they mention the MIT building and a driving license in one long line of text"),
]


def test_tree(spark):
    files = [(k, p, t) for k, (p, t) in enumerate(TREE)]
    df = spark.createDataFrame(files, "n int, path string, text string").selectExpr("*", "'x' AS License", "1 AS _dir", "2 AS score")
    got, want = rows(ls.license_scan(df), "n"), plain_scan(TREE)
    assert [k for k in got if not same(got[k], want[k])] == []
    names = {TREE[k][0]: v[0] for k, v in got.items() if TREE[k][0]}
    assert names["mit/LICENSE"] == names["mit/sub/deep/x.c"] == names["heads/long.c"] == "MIT" and names["bsd/two/z.c"] == "BSD-2-Clause"
    assert (names["heads/lesser.c"], names["heads/affero.c"], names["heads/bsd.c"], names["heads/apache.c"]) == ("LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "Apache-2.0")


def test_repeated_paths_are_judged_apart(spark):
    files = [("a/x", "Released under the MIT License."), ("a/x", PROSE), ("a/x", "Released under the MIT License."), ("a/x", None)]
    got = Counter((r["license"], r["license_from"]) for r in ls.license_scan(spark.createDataFrame(files, "path string, text string")).collect())
    assert got == {("MIT", "file"): 2, ("MIT", "inherited"): 2}


@pytest.mark.parametrize("seed", range(1))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    notices = [t for ts in ls.TEMPLATES.values() for t in ts]
    files = []
    for k in range(24):
        path = "/".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) + f"/{rng.choice(['LICENSE', 'f', 'g'])}{k}"
        parts = [rng.choice([PROSE, wrapped(rng.choice(notices)), rng.choice(notices), ""]) for _ in range(rng.randint(0, 3))]
        files.append((path.lstrip("/"), "\n".join(parts)))
    df = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "n int, path string, text string").repartition(3)
    got, want = rows(ls.license_scan(df), "n"), plain_scan(files)
    assert [(got[k], want[k]) for k in got if not same(got[k], want[k])] == []


def test_query_inherits(spark):
    """The registered query against plain Python; inheritance shows in its rows."""
    d = "/root/testdata/sf0.01"
    out = QUERIES["op3_license_scan"](spark, d)
    found = rows(out, "doc_id")
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    paths = [f"{s}/{i // 1024}/" + (f"{i // 128}/" if i % 64 else "") + ("LICENSE-" if i % 8 == 0 else "doc-") + f"{i}.txt" for i, s, _ in docs]
    want = plain_scan([(p, t) for p, (_, _, t) in zip(paths, docs)])
    assert [i for (i, _, _), w in zip(docs, want) if not same(found[i], w)] == []
    assert Counter(v[2] for v in found.values())["inherited"] > 20

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from tensorloom.llm import conversations
from tensorloom.llm.conversations import ACCEPTING, join_ways, repaired_hashes, ways_through
from tensorloom.llm.queries import op13_conversation_repair

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def every_edit(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least (cost, audit) by writing down all edits of (initial, must go, truncated) rows, insertions included."""
    gaps = [("", 0, ""), ("u", 5, "I"), ("a", 5, "I"), ("ua", 10, "II"), ("au", 10, "II")]
    best = None
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(len(g[0]) for g in ins) > 3:
            continue
        options = []
        for initial, gone, cut in rows:
            kept = [("", 2, "D")]
            if not gone:
                more = 5 if cut else 0
                kept += [(initial, more, "K"), ("u", 1 + more, "R"), ("a", 1 + more, "R")]
            options.append(kept)
        for edits in itertools.product(*options):
            parts = [x for pair in zip(ins, edits) for x in pair] + [ins[-1]]
            if LEGAL.fullmatch("".join(p[0] for p in parts)):
                way = (sum(p[1] for p in parts), "".join(p[2] for p in parts))
                best = way if best is None else min(best, way)
    return best


def code(initial: str, gone: bool, cut: bool) -> str:
    known = initial if initial in ("s", "u", "a") else "?"
    return "-" if gone else known.translate(str.maketrans("sua?", "SUA!")) if cut else known


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits_equal_all_edits(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaaX"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
    codes = "".join(code(*r) for r in rows)
    ends = ways_through(codes, 0, accept=True)
    assert min(ends[s] for s in ACCEPTING if ends[s]) == every_edit(rows)


def test_pieces_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(30):
        codes = "".join(rng.choice("suaSUA-?!") for _ in range(24))
        cuts = sorted(rng.sample(range(1, 24), 3))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, 24])]
        ends = ways_through(codes, 0, accept=True)
        assert join_ways([[ways_through(p, s) for s in range(4)] for p in parts]) == min(ends[s] for s in ACCEPTING if ends[s])


def solve(rows: list[tuple]) -> tuple[int, str]:
    """The whole lattice row by row, no queue: best (cost, audit) per state."""
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best: dict) -> dict:
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = to[s, step[s]]
                best[t] = min(best.get(t, (10**9, "")), (c + 5, a + "I"))
        return best

    best = {0: (0, "")}
    for initial, fault in rows:
        best, now = inserted(best), {}
        for s, (c, a) in best.items():
            ways = [(s, c + 2, a + "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                ways.append((to[s, step[s]], c + 1 + more, a + "R"))
                if (s, initial) in to:
                    ways.append((to[s, initial], c + more, a + "K"))
            for t, *w in ways:
                now[t] = min(now.get(t, (10**9, "")), tuple(w))
        best = now
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows: list[tuple]) -> dict:
    conv: dict = {}
    for c, t, role, text in rows:
        out = conv.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [] if kind == 0 else [(t, role, text)] * (2 if kind == 3 else 1)
    result = {}
    for c, turns in conv.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        judged, seen = [], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role[:1], fault))
        cost, audit = solve(judged)
        lines, state, at = [], 0, 0
        for op in audit:
            said = ("assistant", 3) if state == 2 else ("user", 2)
            if op == "I":
                lines.append(f"{said[0]}:")
                state = said[1]
                continue
            _, role, text = turns[at]
            at += 1
            if op == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif op == "R":
                role, state = said
            if op != "D":
                lines.append(f"{role}:{text}")
        known = [t for t, *_ in turns if t is not None]
        count = lambda f: sum(x == f for _, x in judged)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        result[c] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def made_rows() -> list[tuple]:
    rng = random.Random(9)
    out = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "User", "écho"])
            text = rng.choice(["Fine.", "Why?", "cut off", "日本!", "", " \t\n", None, "Fine. \n", "a\r\nb."])
            out.append((c, rng.choice([t, t, t, t * 3, None, 2]), role, text))
    out += out[:30]
    out += [(500, k, ("user", "assistant")[k % 2 if rng.random() < 0.9 else 0], f"Row {k % 900}" + rng.choice(["", ".", ".", "."])) for k in range(1500)]
    out += [(501, 1, "user", "long. " * 300_000), (501, 2, "assistant", "answer " * 300_000)]
    return out


def query(spark, tmp_path, rows: list[tuple]) -> dict:
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    return {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("piece", [256, 3])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = made_rows()
    got, want = query(spark, tmp_path, rows), brute(rows)
    assert got == want
    assert {"D", "K", "R"} <= {op for r in want.values() for op in r[6]}


def test_insertions_are_written():
    """At these costs a deletion always undercuts an insertion; the writer takes any audit."""
    audits = {(False, 1): "KI", (False, 2): "IKRI", (True, 0): ""}
    rows = [(True, 0, "", None, None), (False, 1, "KI", "", ""), (False, 1, None, "user", "Hi."), (False, 2, "IKRI", "", ""), (False, 2, None, "assistant", "x"), (False, 2, None, "tool", "y")]
    frames = [pd.DataFrame(rows[:3], columns=["none", "conv", "audit", "role", "text"]), pd.DataFrame(rows[3:], columns=["none", "conv", "audit", "role", "text"])]
    got = {(r.none, r.conv): r.repaired_sha256 for f in repaired_hashes(iter(frames)) for r in f.itertuples()}
    want = {(False, 1): "user:Hi.\nassistant:", (False, 2): "user:\nassistant:x\nuser:y\nassistant:", (True, 0): ""}
    assert got == {k: hashlib.sha256(want[k].encode()).hexdigest() for k in audits}


def test_a_conversation_without_rows_after_damage(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert query(spark, tmp_path, [(gone, 1, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from tensorloom.llm.bpe import Automaton, Codec, bpe_decode, bpe_encode, unpack
from tensorloom.llm.queries import QUERIES, tokenizer_path

ALPHABET = "abcdeiostrnSTİΣσς ßéé'’<|>0123½²٣  \x1c\x85\n\t!?#$😀日本語"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts(name):
    path = tokenizer_path(name)
    t, c, rng = Tokenizer.from_file(path), Codec(open(path, encoding="utf-8").read()), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * n for n in range(40)] + ["!" * 3000, "", "<|startoftext|>Hi<|endoftext|> there", "x<|endoftext|>y"]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        got = c.encode(x)
        assert unpack(got) == e.ids, x
        assert c.decode(got) == t.decode(e.ids, skip_special_tokens=False), x


def test_automaton_accepts_what_merging_makes():
    """All words over two letters: the automaton against merging by rank."""
    merges = [("a", "b"), ("b", "b"), ("ab", "a"), ("a", "a"), ("bb", "ab"), ("aa", "aba"), ("bb", "bb")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*"ab", *(u + v for u, v in merges)]))}
    auto, rank = Automaton(vocab, merges), {m: k for k, m in enumerate(merges)}

    def merge(w):
        parts = list(w)
        while len(parts) > 1:
            k, i = min((rank.get((parts[i], parts[i + 1]), 99), i) for i in range(len(parts) - 1))
            if k == 99:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [vocab[p] for p in parts]

    for n in range(1, 11):
        for bits in range(1 << n):
            w = "".join("ab"[bits >> k & 1] for k in range(n))
            assert auto.encode_word(w) == merge(w), w


def test_query(spark, edge_dir, edge_docs):
    t = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, edge_dir).collect()}
    assert len(got) == len(edge_docs)
    for i, text, *_ in edge_docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_byte_level_round_trip(spark, edge_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t) for i, t, *_ in edge_docs], "doc_id long, text string")
    for r in bpe_decode(bpe_encode(df, path), path).collect():
        assert r["decoded"] == (r["text"] or "")

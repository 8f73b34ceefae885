"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over
tokens that accepts exactly the sequences which byte-pair encoding produces.
It starts with one state that loops over all base symbols.  The gadget of rule
``(u, v)`` makes a copy of the state behind ``u`` without the arc ``v``,
redirects ``u`` to the copy, and lets the new token ``uv`` leave every state
that ``u`` leaves and arrive where ``v`` arrived.  A copy differs from its
original by one arc, so states are kept as chains of removed arcs; arcs are
looked up along the chains and the outcome is put in the transition table.

As exactly one tokenization of each prefix is accepted, a word is encoded from
left to right: at each position the one token is found that ends there and has
an arc from the state of the prefix before it.  Decoding emits arc labels.

Defined results: null counts as empty text; empty text has no ids and decodes
to ``""``.  Texts are processed whole, however long; equal texts get equal ids, so
repeated rows and rows without an id are encoded as others; an empty table gives
an empty result; columns of the input that clash with added ones are replaced.
Memory per worker is bounded by ``CACHE`` words and four times as many table entries.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tensorloom.llm.common import hold, without

#: Words of a generation; a worker remembers two, and four times as many transitions.
CACHE = 60_000

_FOREVER = 1 << 60


def byte_symbols() -> list[str]:
    """One visible character for each byte: itself if printable Latin-1, else from U+0100 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Automaton:
    """The compiled merges: tokens are ids, ``labels[id]`` is the arc label."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_of_word: str = ""):
        self.vocab, self.end = vocab, end_of_word
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.labels[i] = token
        # A state is (state it was copied from, removed arc, rank of the gadget).
        self.behind: dict[int, int] = {}
        self.copied_from, self.removed, self.rank = [-1], [-1], [-1]
        self.made: dict[int, tuple[int, int, int]] = {}
        #: Token -> arcs its own gadgets removed behind it -> rank.
        self._gone: dict[int, dict[int, int]] = {}
        self._chains: dict[int, list] = {}
        self._spines: dict[int, list] = {}
        self.table: dict[int, bool] = {}
        for k, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], k)
        self.start = self._grow()

    def _gadget(self, u: int, v: int, uv: int, k: int) -> None:
        if uv in self.made:
            raise ValueError("a token that two merges produce has no deterministic gadget")
        arrives = self.behind.get(v, 0)
        self.copied_from.append(self.behind.get(u, 0))
        self.removed.append(v)
        self.rank.append(k)
        self._gone.setdefault(u, {})[v] = k
        self.behind[u] = len(self.rank) - 1
        self.behind[uv] = arrives
        self.made[uv] = (u, v, k)

    def _segments(self, t: int) -> list[tuple[int, int]]:
        """The chain behind ``t`` by the token whose gadgets made each part, and the rank it ends before."""
        out, until = [(t, _FOREVER)], _FOREVER
        while t in self.made:
            _, t, until = self.made[t]
            out.append((t, until))
        return out

    def _spine(self, t: int) -> list[tuple[int, int]]:
        """``t`` and what its arc was derived from, with the rank at which it was."""
        out = [(t, _FOREVER)]
        while t in self.made:
            t, _, at = self.made[t]
            out.append((t, at))
        return out

    def has_arc(self, after: int, token: int) -> bool:
        """Whether the state behind ``after`` has an arc for ``token``."""
        key = after << 32 | token
        found = self.table.get(key)
        if found is None:
            segments = self._chains.get(after)
            if segments is None:
                segments = self._chains[after] = self._segments(after)
            spine = self._spines.get(token)
            if spine is None:
                spine = self._spines[token] = self._spine(token)
            gone, found = self._gone, True
            for s, until in segments:
                removed = gone.get(s)
                if removed:
                    for c, at in spine:
                        k = removed.get(c)
                        if k is not None and k < until and k <= at:
                            found = False
                            break
                    if not found:
                        break
            if len(self.table) >= 4 * CACHE:
                self.table.clear()
            self.table[key] = found
        return found

    def _grow(self) -> tuple:
        """Labels as a table of transitions character by character; a state has its arcs, and the tokens that end there inside a word and at its end."""
        start: tuple = ({}, [None, None])
        for token, i in self.vocab.items():
            ends = bool(self.end) and token.endswith(self.end)
            state = start
            for ch in token.removesuffix(self.end) if ends else token:
                state = state[0].setdefault(ch, ({}, [None, None]))
            state[1][1 if ends or not self.end else 0] = i
            if not self.end:
                state[1][0] = i
        return start

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word, given as byte symbols."""
        n, table, has_arc, first = len(word), self.table, self.has_arc, self.start[0]
        last, start = [0] * (n + 1), [0] * (n + 1)
        # Tokens that end at each place, by where they start, longest first.
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for k, t in ends[j]:
                if k:
                    found = table.get(last[k] << 32 | t)
                    if not (has_arc(last[k], t) if found is None else found):
                        continue
                last[j], start[j] = t, k
                break
            else:
                if j:
                    raise ValueError(f"no symbol for {word[j - 1]!r}")
            arcs, i = first, j
            for ch in word[j:]:
                state = arcs.get(ch)
                if state is None:
                    break
                arcs, tokens = state
                i += 1
                t = tokens[i == n]
                if t is not None:
                    ends[i].append((j, t))
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]


class _Words(dict):
    """Word -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.symbols = automaton, byte_symbols()
        #: The words of the last generation: those still in use come back from there.
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            symbols = self.symbols
            packed = pack(self.automaton.encode_word("".join([symbols[b] for b in word.encode()])))
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed


def pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        raise OSError("array('I') is not 32 bits wide here")
    import sys

    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpack(packed: bytes) -> list[int]:
    import sys

    a = array("I")
    a.frombytes(packed)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tolist()


# The public pre-splitting pattern of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Normalising, pre-splitting, encoding and decoding as a tokenizer file says."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        m = j["model"]
        if m["type"] != "BPE" or m.get("byte_fallback") or m.get("dropout") or m.get("continuing_subword_prefix"):
            raise ValueError("this tokenizer file needs features that the automaton lacks")
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.automaton = Automaton(m["vocab"], merges, m.get("end_of_word_suffix") or "")
        self.words = _Words(self.automaton)
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.labels = self.automaton.labels + [""] * max(0, max(self.special.values(), default=-1) + 1 - len(self.automaton.labels))
        for t, i in self.special.items():
            self.labels[i] = t
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        steps = [x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])] or ([j["normalizer"]["type"]] if j["normalizer"] else [])
        if steps not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"unknown normalizer {steps}")
        self.lower = bool(steps)
        splits = [x for x in j["pre_tokenizer"].get("pretokenizers", [j["pre_tokenizer"]]) if x["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"] if splits else BYTE_LEVEL
        if "(?" not in pattern:
            plain = pattern.replace("\\p{L}", "a-z" if self.lower else "A-Za-z").replace("\\p{N}", "0-9")
            self._ascii = re.compile(plain.replace("\\s", " \\t-\\r")).findall
        else:
            self._ascii = None
        self._any = regex.compile(pattern.replace("[^\\s", "[^\\p{White_Space}")).findall
        kind = (j.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {kind}")
        self.bytes_out = {c: b for b, c in enumerate(byte_symbols())} if kind else None

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return (self._ascii or self._any)(text.lower() if self.lower else text)
        if self.lower:
            # Final sigma has no form of its own here: each character is lowered alone.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self._any(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = self.words
        if self._special is None or not any(s in text for s in self.special):
            return b"".join([words[w] for w in self._pieces(text)])
        out = []
        for k, part in enumerate(self._special.split(text)):
            out.append(pack([self.special[part]]) if k % 2 else b"".join([words[w] for w in self._pieces(part)]))
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        labels = self.labels
        if self.bytes_out is None:
            return " ".join([labels[i] for i in unpack(packed or b"")])
        raw = bytearray()
        for i in unpack(packed or b""):
            t = labels[i]
            raw += t.encode() if t in self.special else bytes(self.bytes_out[c] for c in t)
        return raw.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


#: Rows that a worker turns into Python objects at a time.
ROWS = 256


def _sent(df: DataFrame, path: str):
    """The tokenizer file, broadcast: its size is that of the vocabulary, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, path: str, column: str, added: dict[str, str], make) -> DataFrame:
    """``df`` plus columns made from one column, a slice of each Arrow batch at a time."""
    spec, df = _sent(df, path), without(df, *added)
    at = [c.lower() for c in df.columns].index(column.lower())
    types = {"binary": pa.binary(), "string": pa.string()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words and transitions last from task to task, until the worker turns to another operator.
        hold("bpe", _codecs.clear)
        c = codec(spec.value)
        for b in parts:
            for k in range(0, b.num_rows, ROWS):
                piece = b.slice(k, ROWS)
                new = zip(*[make(c, x) for x in piece.column(at).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([*piece.columns, *[pa.array(x, types[t]) for x, t in zip(new, added.values(), strict=True)]], [*piece.schema.names, *added])

    schema = StructType([*df.schema.fields, *[StructField(n, BinaryType() if t == "binary" else StringType()) for n, t in added.items()]])
    return df.mapInArrow(run, schema)


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_tokens", F.floor(F.octet_length("ids_packed") / 4).cast("long"))


def bpe_encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ids_packed (binary; little-endian unsigned 32-bit integers) and n_tokens (long)."""
    return _counted(_mapped(without(df, "n_tokens"), path, text_col, {"ids_packed": "binary"}, lambda c, t: (c.encode(t),)))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids_packed") -> DataFrame:
    """``df`` plus decoded (string)."""
    return _mapped(df, path, ids_col, {"decoded": "string"}, lambda c, x: (c.decode(x),))


def bpe_round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` plus ids_packed, n_tokens and decoded, which is made from the ids: both ways in one worker."""

    def both(c: Codec, t: str | None) -> tuple[bytes, str]:
        ids = c.encode(t)
        return ids, c.decode(ids)

    return _counted(_mapped(without(df, "n_tokens"), path, text_col, {"ids_packed": "binary", "decoded": "string"}, both))

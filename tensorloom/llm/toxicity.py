"""Toxicity behind obfuscation: a noisy channel, then a score of the restored text.

A character trigram model is counted over the words of every document.  Words
that look disguised become lattices: leet signs stand for letters, stretched
letters for one or two, signs between single letters for nothing or a space.
Runs and tokens of any length are decoded: time grows with their length only.
The Viterbi path under the character model and the channel costs is the restored
word.  Evidence is then taken from restored words: whole words and word
beginnings that are many times as frequent in toxic labelled texts as in clean
ones, and are found in more toxic documents than chance among all candidates
explains.  The score is the posterior of the toxic class: words of evidence come
at their rates in either class, in toxic texts at full strength or diluted to
parts of it, so a long text needs more of them than a short one.

Sizes: the character model has at most 27**3 entries whatever the corpus; the
classifier is fitted on at most ``max_labels`` labelled rows, picked by hash.
Candidates are counted and judged in Spark; what passes reaches the driver.  Texts
are processed whole, however long.

Defined results: null, empty and wordless texts get the share of toxic rows
among the labelled ones, or a small constant if nothing was labelled, as do all
texts if nothing passes as evidence; equal texts get equal scores, so repeated
rows and rows without an id are scored as others; rows without an id are not held
out and have no label; labels for unknown documents and rows with null labels are
ignored; an empty table gives an empty result; clashing input columns
(``held_out``, ``score``, ``predicted``) are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tensorloom.llm.common import discard, hold, materialize, without

# What a sign may stand for in disguised words.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
GAPS = " .-_*"

#: Labelled rows at most, and toxic documents that must hold a piece of evidence.
MAX_LABELS, MIN_TOXIC = 20_000, 3
PREFIXES = range(4, 8)
#: Evidence is so many times as frequent in toxic texts, and so large a share of it may be due to chance.
LEAST_RATIO, CHANCE = 8.0, 0.1
#: Tokens of a document that count towards the gain of a piece of evidence: some, as one text may repeat anything.
REPEATS = 2
#: Strengths at which a toxic text may hold its evidence, and the most that one word may say (a logarithm).
STRENGTHS, MOST = (1.0, 0.3, 0.1), 8.0
#: Words whose evidence a worker remembers, and pieces of evidence it counts before it passes them on.
CACHE, COUNTED = 150_000, 60_000

_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_SIGNS = frozenset(LEET)
_STRETCHED = re.compile(r"([a-z])\1\1")
# Single letters, or signs that stand for one, with one sign between each two; a star beside a star stands for none.
_SINGLE = r"(?:[^\W_]|[@$!|+(]|(?<!\*)\*(?!\*))"
_SPELLED = re.compile(rf"(?<!\w)(?:{_SINGLE}[ .\-_*]){{3,}}{_SINGLE}(?!\w)")
_EDGE = " \t\r\n.,;:?!\"'()[]{}<>«»„“”‚‘’…*#%&$|-_/\\="


def plain(word: str) -> str:
    """``word`` without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class CharModel:
    """Smoothed log probabilities of a letter after two others; a space marks word ends."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two: Counter = Counter()
        for k, n in counts.items():
            self.two[k[:2]] += n
        self.memo: dict[str, float] = {}

    def logp(self, two: str, c: str) -> float:
        k = two + c
        if k not in self.memo:
            self.memo[k] = math.log((self.three.get(k, 0) + 0.1) / (self.two.get(two, 0) + 2.7))
        return self.memo[k]

    def best(self, lattice: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """The cheapest string through the lattice and its log probability per letter.

        States are the last two letters.  Each keeps a link to its last piece of
        text, so paths share what they have in common and time is linear.
        """
        paths: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        for options in lattice:
            after: dict[str, tuple[float, tuple | None]] = {}
            for two, (score, last) in paths.items():
                for letters, cost in options:
                    s, t = score - cost, two
                    for c in letters:
                        s += self.logp(t, c)
                        t = t[1] + c
                    if t not in after or s > after[t][0]:
                        after[t] = (s, (last, letters) if letters else last)
            paths = after
        score, last = max(((s + self.logp(t, " "), x) for t, (s, x) in paths.items()), key=lambda p: p[0])
        pieces = []
        while last is not None:
            last, piece = last
            pieces.append(piece)
        text = "".join(reversed(pieces))
        return text, score / (len(text) + 1)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Options (letters, cost) for each run of equal signs of a disguised token."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, run = token[i], j - i
        if c in _LETTERS:
            out.append([(c, 0.0 if run == 1 else 0.7)] + ([(c * 2, 0.0)] if run > 1 else []))
        elif c in LEET:
            out.append([(x, 0.7) for x in LEET[c]] + [("", 3.0)])
        else:
            out.append([("", 1.5)])
        i = j
    return out


def spelled_lattice(run: str) -> list[list[tuple[str, float]]]:
    """Options for a spelled run: every second sign is a gap; punctuation at its ends may go for nothing."""
    out: list[list[tuple[str, float]]] = []
    real = [k for k in range(0, len(run), 2) if run[k].isalnum()]
    for k, sign in enumerate(run):
        if k % 2:
            out.append([("", 0.0), (" ", 2.0)])
            continue
        for options in map(lattice, plain(sign)):
            out += options if real[0] <= k <= real[-1] else [[(x, cost) for x, cost in options[0] if x] + [("", 0.0)]]
    return out


def disguised(core: str) -> bool:
    """Whether a lower-case token mixes letters with leet signs or stretches a letter."""
    if core.isalpha():
        return _STRETCHED.search(core) is not None
    letters = sum(c in _LETTERS for c in core)
    return len(core) >= 3 and letters >= 1 and any(c in _SIGNS for c in core) and letters + sum(c in _SIGNS or c in GAPS for c in core) == len(core)


class Restorer:
    """Restores tokens and texts; remembers at most ``CACHE`` tokens."""

    def __init__(self, counts: dict[str, int], floor: float = -4.5):
        self.model, self.floor = CharModel(counts), floor

    def token(self, token: str) -> str:
        """A lower-case token without its edge signs, restored if it is disguised."""
        core = token.strip(_EDGE)
        if core.isalpha() and core.isascii() and not _STRETCHED.search(core):
            return core
        for form in dict.fromkeys((plain(token.lstrip(_EDGE.replace("$", "").replace("!", "").replace("|", "").replace("(", "")).rstrip(_EDGE)), plain(core))):
            if disguised(form):
                text, per_letter = self.model.best(lattice(form))
                if text and per_letter >= self.floor:
                    return text
        return core

    def spelled(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Runs of single letters with signs between them, restored."""
        for m in _SPELLED.finditer(text):
            if any(map(str.isalnum, m[0])):
                yield m.start(), m.end(), self.model.best(spelled_lattice(m[0]))[0]

    def text(self, text: str | None) -> str:
        low = (text or "").lower()
        out, at = [], 0
        for a, b, found in self.spelled(low):
            out += [low[at:a], found]
            at = b
        low = "".join([*out, low[at:]])
        return re.sub(r"\S+", lambda m: m[0].replace(m[0].strip(_EDGE), self.token(m[0]), 1) if m[0].strip(_EDGE) else m[0], low)


def evidence(word: str) -> set[str]:
    """What a restored word is evidence of: itself and its beginnings."""
    out = set()
    for w in word.split():
        out.add("=" + w)
        out.update("^" + w[:n] for n in PREFIXES if len(w) > n)
    return out


def doc_tokens(text: str | None, restorer: Restorer) -> list[str]:
    """Tokens of a text, repeats included, and the words of its spelled runs."""
    low = (text or "").lower()
    found = low.split()
    for _, _, run in restorer.spelled(low):
        found += run.split()
    return found


def _trigrams(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("toxicity")
    total: Counter = Counter()
    seen: Counter = Counter()

    def fold() -> None:
        for w, n in seen.items():
            w = plain(w.strip(_EDGE))
            if w.isascii() and w.isalpha():
                w = f"  {w} "
                for i in range(len(w) - 2):
                    total[w[i : i + 3]] += n
        seen.clear()

    for b in parts:
        for t in b.column(0).to_pylist():
            if t:
                seen.update(t.lower().split())
            if len(seen) > CACHE:
                fold()
    fold()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])


def char_counts(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Trigram counts over all documents; at most 27**3 of them."""
    counted = df.select(F.col(text_col)).mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


#: Stands for all documents and tokens in the table of evidence.
_ALL = ""
_FIELDS = ["f", "k1", "k0", "g1", "g0", "c1", "c0"]


def _count(sent):
    """Per piece of evidence, in toxic and clean texts: documents that hold it, its tokens up to REPEATS a document, all its tokens."""

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        restorer, memo = Restorer(sent.value), {}
        n: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *[pa.array([v[k] for v in n.values()], pa.int64()) for k in range(6)]], _FIELDS)
            n.clear()
            return out

        for b in parts:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = doc_tokens(t, restorer)
                has = Counter({_ALL: len(tokens)})
                for w, m in Counter(tokens).items():
                    found = memo.get(w)
                    if found is None:
                        if len(memo) >= COUNTED:
                            memo.clear()
                        found = memo[w] = tuple(evidence(restorer.token(w)))
                    for f in found:
                        has[f] += m
                at = 0 if toxic else 1
                for f, m in has.items():
                    v = n.get(f)
                    if v is None:
                        v = n[f] = [0] * 6
                    v[at] += 1
                    v[at + 2] += m if m < REPEATS else REPEATS
                    v[at + 4] += m
                if len(n) > COUNTED:
                    yield flush()
        yield flush()

    return count


def posterior(total: float, hits: int, tokens: int, rates: tuple[float, float], prior: float) -> float:
    """Probability of the toxic class, given the sum of log ratios of ``hits`` tokens of evidence among ``tokens``."""
    if not tokens:
        return prior
    r1, r0 = rates
    each = [total + hits * math.log(x) - (x * r1 - r0) * tokens for x in STRENGTHS]
    top = max(each)
    llr = top + math.log(math.fsum(math.exp(x - top) for x in each) / len(each)) + math.log(prior / (1 - prior))
    return 1 / (1 + math.exp(-llr)) if llr > -700 else 0.0


class ToxicityModel:
    """Character counts, log ratios of evidence, its rates in toxic and clean texts, and the share of toxic texts."""

    def __init__(self, spark, counts: dict[str, int], weights: dict[str, float], rates: tuple[float, float], prior: float):
        self.counts, self.weights, self.rates, self.prior = counts, weights, rates, prior
        self._sent = spark.sparkContext.broadcast((counts, weights, rates, prior))

    def evidence(self, text: Column) -> Column:
        """Struct of the sum of log ratios, the tokens of evidence and all tokens."""
        sent = self._sent

        @F.pandas_udf("total double, hits long, tokens long")
        def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            hold("toxicity")
            counts, weights, _, _ = sent.value
            restorer = Restorer(counts)

            class Memo(dict):
                def __missing__(self, w: str) -> float:
                    v = max((weights.get(f, 0.0) for f in evidence(restorer.token(w))), default=0.0)
                    if len(self) >= CACHE:
                        self.clear()
                    self[w] = v
                    return v

            memo = Memo()
            for s in parts:
                rows = []
                for t in s:
                    found = [memo[w] for w in doc_tokens(t, restorer)]
                    rows.append((math.fsum(found), len(found) - found.count(0.0), len(found)))
                yield pd.DataFrame(rows, columns=["total", "hits", "tokens"]).astype({"total": "float64", "hits": "int64", "tokens": "int64"})

        return look(text)

    def score(self, text: Column) -> Column:
        sent = self._sent

        @F.pandas_udf(DoubleType())
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            _, _, rates, prior = sent.value
            for d in parts:
                yield pd.Series([posterior(*r, rates, prior) for r in d.itertuples(index=False, name=None)], dtype="float64")

        return score(self.evidence(text)) if self.weights else F.lit(self.prior)

    def restore(self, text: Column) -> Column:
        sent = self._sent

        @F.pandas_udf(StringType())
        def restore(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            restorer = Restorer(sent.value[0])
            for s in parts:
                yield pd.Series([restorer.text(t) for t in s], dtype=object)

        return restore(text)


def _least_gain(gains: list[tuple[int, int]], chance: float) -> float:
    """The smallest gain at which at most a ``chance`` share of what passes is expected to pass by chance.

    ``gains`` are (gain in tenths, number of candidates); a gain of g comes by
    chance with odds of about exp(-g).
    """
    total, least, above = sum(n for _, n in gains), math.inf, 0
    for g, n in sorted(gains, reverse=True):
        above += n
        if total * math.exp(-g / 10) <= chance * above:
            least = g / 10
    return least


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = MAX_LABELS, min_toxic: int = MIN_TOXIC) -> ToxicityModel:
    """Count characters over all of ``df`` and fit evidence on at most ``max_labels`` rows of ``labels``."""
    spark = df.sparkSession
    counts = char_counts(df, text_col)
    rows = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("_toxic")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    # At most max_labels rows of 16 bytes: small enough for every executor.
    train = materialize(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_text", "_toxic"), "labelled")
    sent = spark.sparkContext.broadcast(counts)
    table = materialize(train.mapInArrow(_count(sent), "f string, " + ", ".join(f"{x} long" for x in _FIELDS[1:])).groupBy("f").agg(*[F.sum(x).alias(x) for x in _FIELDS[1:]]), "evidence")
    every = table.where(F.col("f") == _ALL).first()
    n1, n0 = (every["k1"], every["k0"]) if every else (0, 0)
    prior = min(max((n1 + 0.5) / (n1 + n0 + 1), 0.001), 0.5) if n1 + n0 else 0.01
    if not n1 or not n0:
        discard(table, train)
        return ToxicityModel(spark, counts, {}, (0.0, 0.0), prior)
    t1, t0 = max(every["c1"], 1), max(every["c0"], 1)
    # Gain: how much better its counts fit a share of their own than the common one.
    share, q = n1 / (n1 + n0), F.col("g1") / (F.col("g1") + F.col("g0"))
    gain = F.col("g1") * F.log(q / share) + F.when(F.col("g0") > 0, F.col("g0") * F.log((1 - q) / (1 - share))).otherwise(0.0)
    ratio = (F.col("c1") / t1) / ((F.col("c0") + 0.5) / t0)
    seen = table.where((F.col("f") != _ALL) & (F.col("k1") + F.col("k0") >= min_toxic))
    judged = seen.withColumns({"gain": F.when(q > share, gain).otherwise(0.0), "ratio": ratio}).where(F.col("gain").isNotNull())
    tenths = [(int(r["g"]), r["n"]) for r in judged.groupBy(F.floor(F.col("gain") * 10).alias("g")).agg(F.count("*").alias("n")).collect()]
    kept = judged.where((F.col("k1") >= min_toxic) & (F.col("gain") >= _least_gain(tenths, CHANCE)) & (F.col("ratio") >= LEAST_RATIO)).select("f", "ratio").collect()
    weights = {r["f"]: min(math.log(r["ratio"]), MOST) for r in kept}
    rates = (0.0, 0.0)
    if weights:
        probe = ToxicityModel(spark, counts, weights, rates, prior)
        found = train.select("_toxic", probe.evidence(F.col("_text")).alias("e")).groupBy("_toxic").agg(F.sum("e.hits").alias("h")).collect()
        hits = {r["_toxic"]: r["h"] or 0 for r in found}
        rates = (hits.get(True, 0) / t1, (hits.get(False, 0) + 0.5) / t0)
    discard(table, train)
    return ToxicityModel(spark, counts, weights, rates, prior)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` plus held_out, score and predicted; fitted on rows that are not held out."""
    df = without(df, "held_out", "score", "predicted")
    model = fit(df, labels.where(~held_out(F.col(id_col))), id_col, text_col)
    out = df.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", model.score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Personal data and the words that give it away.

Base spans of four kinds are found by fixed patterns.  Corpus statistics decide
what else must go.  The protected entities are the kinds, and personal data of
any kind.  For each word, the number of documents that hold it along with an
entity, wherever in the text, is compared with the number of all documents that
hold it.  The information that a word carries about an entity being there,
log2(p(entity | word) / p(entity)), is its disclosure; words above a share of the
entity's own information content, log2(1 / p(entity)), are sanitised at each
place of every document, whether or not an entity stands beside them there:
generalised to ``[TERM]``, or removed, as base spans are to the name of their
kind.  p(entity | word) is the lower end of Wilson's interval, so rare words take
part, at the confidence that their number of documents gives.

Counts cover all documents and are combined before any shuffle.  A word that
would fall short even if all its documents held the entity needs no count; the
others are told by a bit filter of fixed size, whose false positives cost time
and nothing else.  The words that are left are sent to all tasks if they are few
(their number is checked), and joined by key if not; both ways give the same rows.

Defined results: null and empty texts hold nothing and are sanitised to ``""``;
words are runs of three letters or digits or more, of any length, compared in
lower case; overlapping base spans of different kinds all stay, and where spans
overlap one name replaces all of them; a word inside a base span adds no span of
its own; ties at a threshold count as disclosing; repeated rows count as
documents of their own; texts are processed whole, however long; an empty table
gives an empty result; a missing id is kept as null; columns of the input that
clash with added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tensorloom.llm.common import discard, materialize

# The kinds, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No start inside a run of digits: such a start could only repeat a failure.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")
CACHE = 200_000
#: Normal quantile of the one-sided confidence of 99 %.
Z = 2.33
#: Number of the entity that stands for personal data of any kind.
ANY = len(KINDS)
#: Bits of the filter of words to count, and the most words that are sent to every task.
FILTER_BITS, SENT_WORDS = 1 << 24, 200_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number), sorted, in code points with an exclusive end."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    # Emails by their signs: leftmost matches start at the run of local characters before one.
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        else:
            # Nothing that starts before this sign can match, so the next run begins behind it.
            free = at + 1
        at = text.find("@", free)
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p[-400:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def outside_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-case word) of the words outside all spans."""
    covered: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    k = 0
    for m in _WORD.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or m.end() <= covered[k][0]:
            yield m.start(), m.end(), m[0].lower()


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
_SPAN_TYPE = ArrayType(StructType([StructField(x, IntegerType()) for x in "sek"]))


def _near(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document with a base span: the entities in it and the distinct words outside its spans."""
    for b in parts:
        kinds, words = [], []
        for t in b.column(0).to_pylist():
            spans = base_spans(t)
            if spans:
                kinds.append([*sorted({k for _, _, k in spans}), ANY])
                words.append(sorted({w for _, _, w in outside_words(t, spans)}))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.string()))], ["kinds", "near"])


def _document_words(filled):
    """Documents per word that the filter lets through, counted within the task."""

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, n = filled.value, Counter()

        class Wanted(dict):
            def __missing__(self, w: str) -> str | None:
                at = zlib.crc32(w.lower().encode("utf-8", "replace")) % FILTER_BITS
                if len(self) >= CACHE:
                    self.clear()
                found = self[w] = w.lower() if bits[at >> 3] >> (at & 7) & 1 else None
                return found

        wanted = Wanted()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])
            n.clear()
            return out

        for b in parts:
            for t in b.column(0).to_pylist():
                if t:
                    n.update({wanted[w] for w in set(_WORD.findall(t))} - {None})
            if len(n) > CACHE:
                yield flush()
        yield flush()

    return count


def sanitised(text: str | None, spans: list[tuple[int, int, int]], mode: str) -> str:
    """``text`` with each group of overlapping spans replaced by the name of the first, or removed."""
    out, at, text = [], 0, text or ""
    for s, e, k in spans:
        if s >= at:
            out.append(text[at:s])
            if mode == "generalise":
                out.append("[TERM]" if k < 0 else f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mark(mode: str, sent=None):
    """Base spans, all spans and the sanitised text; disclosing words are those sent, or those of column _gone."""

    def mark(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            base, spans, clean = [], [], []
            texts = b.column("_text").to_pylist()
            gone = [sent.value] * len(texts) if sent is not None else b.column("_gone").to_pylist()
            for t, words in zip(texts, gone, strict=True):
                found = base_spans(t)
                marked = found
                if words and t:
                    words = words if sent is not None else set(words)
                    if not words.isdisjoint(map(str.lower, _WORD.findall(t))):
                        marked = sorted([*found, *[(x, y, -1) for x, y, w in outside_words(t, found) if w in words]], key=lambda s: (s[0], s[2] % 8, s[1]))
                base.append([{"s": x, "e": y, "k": k} for x, y, k in found])
                spans.append([{"s": x, "e": y, "k": k} for x, y, k in marked])
                clean.append(sanitised(t, marked, mode))
            kept = [c for c in b.schema.names if c not in ("_text", "_gone")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(base, _SPANS), pa.array(spans, _SPANS), pa.array(clean, pa.string())], [*kept, "base", "spans", "sanitised"])

    return mark


def _all_words(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row number and distinct words of each document."""
    for b in parts:
        words = [sorted(set(map(str.lower, _WORD.findall(t or "")))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["_row", "words"])


def _lower_end(hits: Column, n: Column) -> Column:
    """Lower end of Wilson's interval for hits of n."""
    n = n.cast("double")
    p, zz = hits / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + zz / (4 * n * n))) / (1 + zz / n)


def disclosing_words(texts: DataFrame, share: float) -> DataFrame:
    """Words (w) and entities (k) above the disclosure threshold in the one column of ``texts``, with the figures behind it."""
    spark = texts.sparkSession
    found = materialize(texts.mapInArrow(_near, "kinds array<int>, near array<string>"), "near")
    total = texts.count()
    kinds = found.select(F.explode("kinds").alias("k")).groupBy("k").agg(F.count("*").alias("with_kind"))
    p_kind = F.col("with_kind") / F.lit(float(max(total, 1)))
    # At most one row per entity.  disclosure >= share * information, without logarithms.
    kinds = F.broadcast(kinds.withColumn("least", F.pow(p_kind, F.lit(1.0 - share))).where(p_kind < 1))
    together = found.select("kinds", F.explode("near").alias("w")).select("w", F.explode("kinds").alias("k")).groupBy("w", "k").agg(F.count("*").alias("together"))
    hopeful = materialize(together.join(kinds, "k").where(_lower_end(F.col("together"), F.col("together")) >= F.col("least")), "hopeful")
    at = F.crc32(F.encode("w", "UTF-8")) % FILTER_BITS
    # At most FILTER_BITS / 64 rows, whatever the corpus.
    slots = hopeful.groupBy(F.floor(at / 64).cast("int").alias("s")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(crc32(encode(w, 'UTF-8')) % {FILTER_BITS} % 64 as int))")).alias("m")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, "<i8")
    bits[slots.column("s").to_numpy()] = slots.column("m").to_numpy()
    counted = texts.mapInArrow(_document_words(spark.sparkContext.broadcast(bits.tobytes())), "w string, n long").groupBy("w").agg(F.sum("n").alias("docs"))
    out = hopeful.join(counted, "w").withColumn("low", _lower_end(F.col("together"), F.col("docs"))).where("low >= least")
    table = materialize(out.select("w", "k", "together", "docs", "with_kind", (F.log2("low") - F.log2(p_kind)).alias("disclosure"), (-F.log2(p_kind)).alias("information")), "terms")
    discard(found, hopeful)
    return table


def find_pii(df: DataFrame, text_col: str = "text", share: float = 0.7, mode: str = "generalise", sent_words: int = SENT_WORDS) -> DataFrame:
    """``df`` without its text, plus base and spans (arrays of s, e, k) and the sanitised text.

    k is a kind number or, for disclosing words, -1; ``mode`` is generalise or remove.
    """
    if mode not in ("generalise", "remove"):
        raise ValueError(mode)
    spark = df.sparkSession
    keep = [c for c in df.columns if c.lower() not in {text_col.lower(), "base", "spans", "sanitised", "_text", "_gone", "_row"}]
    src = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    fields = [f for f in src.schema.fields if f.name != "_text"]
    schema = StructType([*fields, StructField("base", _SPAN_TYPE), StructField("spans", _SPAN_TYPE), StructField("sanitised", StringType())])
    table = disclosing_words(src.select("_text"), share)
    words = [r["w"] for r in table.select("w").distinct().limit(sent_words + 1).collect()]
    if len(words) <= sent_words:
        discard(table)
        return src.mapInArrow(_mark(mode, spark.sparkContext.broadcast(frozenset(words))), schema)
    rows = materialize(src.withColumn("_row", F.monotonically_increasing_id()), "pii")
    held = rows.select("_row", "_text").mapInArrow(_all_words, "_row long, words array<string>").select("_row", F.explode("words").alias("w"))
    gone = held.join(table.select("w").distinct(), "w").groupBy("_row").agg(F.collect_set("w").alias("_gone"))
    return rows.join(gone, "_row", "left").drop("_row").mapInArrow(_mark(mode), schema)


def spans_of_kind(spans: Column, kind: int) -> Column:
    """Number of spans of one kind number (-1: words)."""
    return F.size(F.filter(spans, lambda s: s["k"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined; words that give an entity away are of kind term."""

    def name(k: Column) -> Column:
        out = F.when(k < 0, F.lit("term"))
        for i, kind in enumerate(KINDS):
            out = out.when(k == i, F.lit(kind))
        return out

    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")

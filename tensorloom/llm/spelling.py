"""Spelling variants of words: near words by wildcard groups and deletions, without pairs.

A word of L letters joins L wildcard groups (position, prefix, suffix); those who
share a group differ by one replaced letter.  A group keeps its size and its two
best words, and tells each member how many others there are and which of them is
best.  A word with one letter left out is looked up among the words: both sides of
a hit differ by one inserted or deleted letter.  So each word costs its length in
rows, however many near words it has.

Defined results: null texts have no words, a missing id counts as an empty one,
every row counts (repeated ids and texts add up), ties go to the smallest word in
code-point order, and an empty table gives no row.  Texts and words have no length
limit: parts of a word of more than ``KEY_CHARS`` letters stand in keys by their
SHA-256, so keys stay short; hashing them takes time with the square of the word's
length.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import LOWER, UPPER, discard, materialize

LETTERS = "A-Za-z\u00C0-\u00FF"
#: Longer parts of words are named by their hash.
KEY_CHARS = 64
#: One run in so many loses a letter before it is counted.
SLIP_EVERY = 199
#: Different words that a task sums before it passes them on.
HELD = 200_000


def _count_runs(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of (id, text) -> (word, n), summed over a batch or ``HELD`` words at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lower = re.compile(f"[{LETTERS}]{{{min_chars},}}"), str.maketrans(UPPER, LOWER)
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                start = f"{doc.as_py()}:".encode()
                for run, n in Counter(runs.findall(text.as_py())).items():
                    run = run.lower() if run.isascii() else run.translate(lower)
                    h = zlib.crc32(run.encode(), zlib.crc32(start))
                    if h % SLIP_EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_chars:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield told()
        if held:
            yield told()

    return count


def slipped_words(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n), n occurrences each, of runs of letters: lower-cased, one letter less where the hash of id and run says so.

    A word has several rows, whose n add up.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_count_runs(min_chars), "word string, n long")


def key_of(part: Column) -> Column:
    return F.when(F.length(part) <= KEY_CHARS, part).otherwise(F.concat(F.lit("#"), F.sha2(part, 256)))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n) with distinct words -> (word, n_near, best_n, best) for words with a near word."""
    places = vocabulary.select("word", "n", F.explode(F.expr("sequence(1, length(word))")).alias("k"))
    parts = places.select("word", "n", "k", F.expr("substring(word, 1, k - 1)").alias("left"), F.expr("substring(word, k + 1)").alias("right"))

    # Replacements.  A group has one word per letter of the alphabet at most, so its list is short.
    by_group = parts.groupBy(F.concat(key_of(F.col("left")), F.lit("*"), key_of(F.col("right"))).alias("group"))
    groups = by_group.agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "word"))).alias("by_n")).where("size > 1")
    member = F.explode("by_n").alias("m")
    first, second = F.col("by_n")[0], F.col("by_n")[1]
    replaced = groups.select("size", first.alias("first"), second.alias("second"), member).select(
        F.col("m.word").alias("word"),
        (F.col("size") - 1).alias("near"),
        F.when(F.col("m.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"),
    )

    # Deletions.  Of equal letters in a row one is left out, so a shorter word comes once from each longer one.
    left_out = parts.where("substring(word, k, 1) <> substring(word, k + 1, 1)")
    left_out = left_out.select("word", "n", key_of(F.concat("left", "right")).alias("key"))
    shorter = vocabulary.select(key_of(F.col("word")).alias("key"), F.struct((-F.col("n")).alias("r"), "word").alias("short"))
    hits = left_out.join(shorter, "key").select(F.struct((-F.col("n")).alias("r"), "word").alias("long"), "short")
    both = F.array(F.struct(F.col("long.word").alias("word"), F.col("short").alias("best")), F.struct(F.col("short.word").alias("word"), F.col("long").alias("best")))
    moved = hits.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("bigint").alias("near"), "x.best")

    told = replaced.unionByName(moved).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return told.select("word", "n_near", (-F.col("best.r")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last by doubling; no chain has more than ``longest`` steps."""
    now, reach = materialize(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while reach < longest:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = materialize(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        discard(now)
        now, reach = then, reach * 2
    return now


def spelling_variants(words: DataFrame, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, n), n occurrences each -> (word, n, n_near, form, form_n, root) per word seen ``min_count`` times.

    ``form`` is the near word seen most often, if at least ``ratio`` times as often as the word.
    """
    counted = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    vocabulary = materialize(counted, "vocabulary")
    near = near_words(vocabulary)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = materialize(found, "forms")
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    longest = 0  # each step multiplies the count
    while min_count * ratio ** (longest + 1) <= most:
        longest += 1
    last = roots(found.where("form IS NOT NULL"), longest)
    discard(vocabulary)
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))

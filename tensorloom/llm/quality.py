"""Quality rules: one table of thresholds, compiled into one projection.

Counting is done by built-in functions inside a single ``select``; nothing is
shuffled and no user function runs.  Each rule is a ratio with a lower and an
upper bound; a document is kept if it passes the base test and every rule.

Defined results: null, empty or blank text has no words, so every count is 0,
``base_failed`` is true and ``kept`` false; rows are judged one by one, so ties,
repeated rows and rows without an id get equal verdicts for equal texts; texts are
measured whole, however long; an empty table gives an empty result; clashing input
columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE, windows, without, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have he her his in is it not of on or that the this to was were with".split(),
    "de": "aber als am auch auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sie sich sind und von war zu".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les mais ne nous on ou par pas pour que qui se son sur un une".split(),
    "es": "al como con de del el en es esta las la lo los más no o para pero por que se sin su sus un una y ya".split(),
}

#: Rule -> (lower bound, upper bound); None leaves a side open.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "n_words": (20, 1_000_000),
    "mean_word_chars": (2.0, 14.0),
    "symbols_per_word": (None, 0.3),
    "dup_line_ratio": (None, 0.5),
    "repeat_word_ratio": (None, 0.3),
    "upper_ratio": (None, 0.6),
    "stop_word_ratio": (0.004, None),
}


def _repeats(grams: Column, n: int) -> Column:
    """Words covered by the ``n``-word windows whose hash occurs twice or more."""
    tagged = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    size = F.size(tagged)
    # Neighbours in hash order decide; shifting by one keeps this a single pass.
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(nothing, F.slice(tagged, 1, F.greatest(size - 1, F.lit(1))))
    after = F.concat(F.slice(tagged, 2, size), nothing)
    seen = F.zip_with(F.arrays_zip(tagged.alias("t"), before.alias("b")), after, lambda tb, a: F.when((tb["t"]["h"] == tb["b"]["h"]) | (tb["t"]["h"] == a["h"]), tb["t"]["i"]))
    at = F.array_sort(F.filter(seen, lambda i: i.isNotNull()))
    step = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    return F.aggregate(at, step, lambda s, i: F.struct((i + n).alias("end"), (s["sum"] + (i + n) - F.greatest(s["end"], i)).alias("sum")), lambda s: s["sum"])


def measures(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``df`` with the counts that the rules are made of."""
    df = without(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stop", "n_lines", "_w", "_g", "_l")
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    bare = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = df.withColumns({"_w": words(F.col(text_col)), "_l": lines, "word_chars": F.length(bare).cast("long")})
    n = F.size("_w")
    grams = F.when(n >= window, windows(F.col("_w"), window)).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_g", grams)
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(_repeats(F.col("_g"), window)).cast("long"),
            "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
            "n_stop": F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).cast("long"),
        }
    ).drop("_w", "_g", "_l")


def verdict(thresholds: dict[str, tuple[float | None, float | None]] | None = None) -> Column:
    """The threshold table as one boolean expression over :func:`measures`."""
    c = {k: F.col(k).cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stop")}
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    known = {
        "n_words": c["n_words"],
        "mean_word_chars": ratio(c["word_chars"], c["n_words"]),
        "symbols_per_word": ratio(c["n_symbols"], c["n_words"]),
        "dup_line_ratio": ratio(c["n_dup_lines"], c["n_lines"]),
        "repeat_word_ratio": ratio(c["n_repeat_words"], c["n_words"]),
        "upper_ratio": ratio(c["n_upper"], c["word_chars"]),
        "stop_word_ratio": ratio(c["n_stop"], c["n_words"]),
    }
    ok = F.lit(True)
    for name, (low, high) in (THRESHOLDS if thresholds is None else thresholds).items():
        if low is not None:
            ok = ok & (known[name] >= low)
        if high is not None:
            ok = ok & (known[name] <= high)
    return ok


def quality_rules(df: DataFrame, text_col: str = "text", thresholds: dict | None = None) -> DataFrame:
    """``df`` plus counts, ``base_failed`` and ``kept``."""
    out = measures(without(df, "base_failed", "kept"), text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))

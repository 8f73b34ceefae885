"""Line dedup across documents, in DataFrame functions only.

Lines are normalised, hashed and exploded once per document; the documents that
hold each hash are counted with map-side combining, so a line that a third of
the corpus repeats costs one partial row per task.  Lines at or over the
threshold go, except in the largest document id that holds them, and the rest
is put together again by position.

Defined results: null or empty text is one empty line and is kept as ``""``;
an empty table gives an empty result; repeated document ids count as one
document, whose rows lose and keep lines together; rows without an id count
towards no line and keep all of theirs; texts are split whole, however long;
columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE, ascii_lower, let, materialize, without


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    """96 bits of two unrelated hashes."""
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _distinct(hashes: Column) -> Column:
    """Sorted, without neighbours that are equal: array_distinct compares all pairs of structs."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1) != x)))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Hashes of normalised lines held by at least ``min_docs`` documents: k, n_docs, keeper."""
    keys = F.filter(F.transform(_lines(F.col(text_col)), _key), lambda k: F.length(k) >= min_chars)
    held = df.select(F.col(id_col).alias("id"), F.explode(_distinct(F.transform(keys, _hash))).alias("k"))
    if not id_is_unique(df, id_col):
        held = held.distinct()
    return held.groupBy("k").agg(F.count("id").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def id_is_unique(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own (one aggregation over the id column)."""
    return not df.groupBy(id_col).count().where("count > 1").take(1)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``df`` plus n_lines, n_dropped and kept_text."""
    df = without(df, "n_lines", "n_dropped", "kept_text", "_drop", "_id", "_text")
    hot = materialize(repeated_lines(df, id_col, text_col, min_chars, min_docs), "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows of one id and text have the same lines at the same positions.
    keys = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.transform(_lines(text), _key).alias("keys"))
    # Apart from the step above, else each line would carry and hash its whole text.
    lines = keys.select("_id", "_text", F.posexplode("keys").alias("pos", "key"))
    held = lines.where((F.length("key") >= min_chars) & F.col("_id").isNotNull()).select("_id", "_text", "pos", _hash(F.col("key")).alias("k"))
    drops = held.join(hot, "k").where(F.col("_id") != F.col("keeper")).groupBy("_id", "_text").agg(F.collect_list("pos").alias("_drop"))
    joined = df.withColumns({"_id": F.col(id_col), "_text": F.xxhash64(text)}).join(drops, ["_id", "_text"], "left")

    def rest(all_lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_drop"))
        return F.transform(stay, lambda k: all_lines[k])

    n_lines = F.size(_lines(text))
    kept = F.when(F.col("_drop").isNull(), F.array(text)).otherwise(let(_lines(text), rest))
    out = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("_kept", kept)
    dropped = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept"))
    out = out.withColumn("n_dropped", dropped.cast("long")).withColumn("kept_text", F.array_join("_kept", "\n"))
    return out.select(*[out[f"`{c}`"] for c in df.columns], "n_lines", "n_dropped", "kept_text")

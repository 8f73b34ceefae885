"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest distinct 48-bit hashes of a
text's word shingles.  Sketches of parts merge to the sketch of the whole, and
estimate resemblance, containment and the number of distinct shingles; below
``K`` shingles all three are exact up to hash collisions.

Defined results: null, empty and wordless texts have the empty sketch, written
``""``; two empty sketches resemble each other fully and an empty sketch is
contained in any; texts under five words have one shingle; equal texts have
equal sketches; texts are sketched whole, however long; repeated rows and rows
without an id each have a row in the result; an empty table gives an empty result;
only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import ascii_lower, materialize, windows, words

K, SHINGLE = 128, 5
BITS = 48


def with_sketch(df: DataFrame, text: Column, name: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """``df`` plus the sketch of ``text`` as array<bigint>."""
    low = F.transform(windows(words(ascii_lower(text)), n), lambda h: F.shiftrightunsigned(h, 64 - BITS))
    return df.withColumn(name, F.slice(F.array_distinct(F.sort_array(low)), 1, k))


def written(sketch: Column) -> Column:
    """The sketch as a string of 12 hexadecimal digits a hash, in ascending order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def read(text: Column) -> Column:
    """The sketch that :func:`written` made."""
    d = BITS // 4
    at = F.sequence(F.lit(0), F.greatest((F.length(text) / d).cast("int") - 1, F.lit(0)))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(text.substr(i * d + 1, F.lit(d)), 16, 10).cast("long")))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(sketch, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(u, a), b))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def merged(df: DataFrame, group: str, sketch: str, k: int = K, salts: int = 16) -> DataFrame:
    """One sketch per group.  Salting keeps a group of any size out of one task."""
    h = df.select(group, F.explode(sketch).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(salts)))
    few = lambda d, *by: d.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= k).drop("r")
    low = few(few(h, group, "salt"), group).groupBy(group).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    empty = F.coalesce(sketch, F.array().cast("array<bigint>"))
    return df.select(group).distinct().join(low, group, "left").withColumn(sketch, empty)


def _bounds(keys: DataFrame, ranges: int) -> DataFrame:
    """One row with the first keys (no id, id, h) of ranges of about equal size, in order: at most ``ranges`` of them.

    They are found and put in order by the executors, and written, so that all later tasks see the same ones.
    """
    dealt = keys.repartitionByRange(ranges, F.col("none"), F.col("id"), F.col("h")).withColumn("_b", F.spark_partition_id())
    first = dealt.groupBy("_b").agg(F.min(F.struct("none", "id", "h")).alias("k"))
    return materialize(first.agg(F.sort_array(F.collect_list("k")).alias("bounds")), "bounds")


def _with_range(df: DataFrame, bounds: Column, ranges: int) -> DataFrame:
    """``df`` plus _at, the number of the range that the row belongs to, and _first, whether it is the range's first row.

    Bisection, a projection or two for each step, as a subquery may not stand in a lambda function.
    """
    out = df.withColumn("_at", F.lit(0))
    for k in range(max(ranges - 1, 1).bit_length() - 1, -1, -1):
        out = out.withColumn("_bound", F.get(bounds, F.col("_at") + (1 << k)))
        # A null id stands behind all others and is equal to itself.
        same = F.col("id").eqNullSafe(F.col("_bound.id")) & (F.col("h") >= F.col("_bound.h"))
        later = F.coalesce(F.col("id") > F.col("_bound.id"), F.lit(False)) | same
        beyond = (F.col("none") > F.col("_bound.none")) | ((F.col("none") == F.col("_bound.none")) & later)
        out = out.withColumn("_at", F.when(F.coalesce(beyond, F.lit(False)), F.col("_at") + (1 << k)).otherwise(F.col("_at")))
    out = out.withColumn("_bound", F.get(bounds, F.col("_at")))
    first = (F.col("none") == F.col("_bound.none")) & F.col("id").eqNullSafe(F.col("_bound.id")) & (F.col("h") == F.col("_bound.h"))
    return out.withColumn("_first", F.coalesce(first, F.lit(False))).drop("_bound")


#: Copies of a row that are written out side by side, and ranges of the order for each task.
COPIES, RANGES_PER_TASK = 10_000, 4


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half replaced by the head of the next document.

    Returns one row per row: id_col, n_chars, edited (string), a, b (sketches of
    text and edited text), c (sketch of the next text).  Order is by id, rows
    without an id last; equal ids are ordered by a hash of their texts.

    Rows are dealt by ranges of the order; the first row of each range also goes,
    as a guest, to the range before it, so every row finds its successor in its
    own range and texts are shuffled once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys, key = base.select("none", "id", "h"), ["none", "id", "h"]
    repeated = bool(keys.groupBy(*key).count().where("count > 1").take(1))
    if repeated:
        # Rows with equal id and text are one row with a number, whatever their share.
        base = base.groupBy(*key).agg(F.min("t").alias("t"), F.count("*").alias("m"))
        keys = base.select(*key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several ranges for each task, lest chance leave some tasks without any.  Their bounds reach
    # the tasks as the value of a scalar subquery: the plan is the same whatever their number.
    ranges = RANGES_PER_TASK * parts
    bounds = _bounds(keys, ranges).select("bounds").scalar()
    own = F.struct(F.col("_at").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_at") - 1, F.size(bounds)).alias("r"), F.lit(True).alias("guest"))
    homes = F.when(F.col("_first"), F.array(own, guest)).otherwise(F.array(own))
    dealt = _with_range(base, bounds, ranges).withColumn("_to", F.explode(homes)).withColumns({"_r": F.col("_to.r"), "_guest": F.col("_to.guest")}).drop("_at", "_first", "_to").repartition(parts, "_r")
    sketched = with_sketch(dealt, F.col("t"), "a", k)
    w = Window.partitionBy("_r").orderBy("_guest", *key)
    both = sketched.withColumns({"_t": F.lead("t").over(w), "c": F.lead("a").over(w)}).where(~F.col("_guest"))
    if repeated:
        # All copies but the last are followed by a copy.
        both = both.withColumn("_self", F.explode(F.when(F.col("m") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        both = both.withColumns({"_t": F.when(F.col("_self"), F.col("t")).otherwise(F.col("_t")), "c": F.when(F.col("_self"), F.col("a")).otherwise(F.col("c"))})
    both = both.withColumn("n", F.length("t"))
    both = both.withColumn("edited", F.concat(F.expr("substring(t, 1, n - n div 2)"), F.expr("substring(_t, 1, cast(n div 2 as int))"))).drop("t", "_t")
    out = with_sketch(both, F.col("edited"), "b", k)
    if repeated:
        times = F.when(F.col("_self"), F.col("m") - 1).otherwise(F.lit(1).cast("long"))
        chunks = F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / COPIES))
        few = out.withColumn("_times", times).withColumn("_chunk", F.explode(chunks)).repartition(parts, "_chunk", *key)
        here = F.least(F.lit(COPIES).cast("long"), F.col("_times") - F.col("_chunk") * COPIES)
        out = few.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), here)))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited", "a", "b", "c")

"""Short inner vectors: one array column per row, handled inside the row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import elementwise as fx


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def logsumexp(a: Column) -> Column:
    """Stable in one step: the largest value is taken out first."""
    sums = lambda v, top: F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return F.when(F.size(a) == 0, -fx.INF).otherwise(let(doubles(a), lambda v: let(F.array_max(v), lambda top: sums(v, top))))


def softmax(a: Column) -> Column:
    """Linear in the length: maximum, exponentials and their sum are each made once."""
    parts = lambda v, top: F.transform(v, lambda x: F.exp(x - top))
    shares = lambda e: let(total(e), lambda norm: F.transform(e, lambda x: x / norm))
    return let(doubles(a), lambda v: let(F.array_max(v), lambda top: let(parts(v, top), shares)))


def argmax(a: Column) -> Column:
    """First position of the largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("bigint")


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0, squared: bool = False) -> Column:
    """manhattan, euclidean (or its square), minkowski of order p, or jaccard on the sets of values."""
    if metric == "jaccard":
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)
    diff = F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))
    if metric == "manhattan" or metric == "minkowski" and p == 1:
        return total(diff)
    if metric == "minkowski" and math.isinf(p):
        return F.coalesce(F.array_max(diff), F.lit(0.0))
    if metric == "minkowski" and p != 2:
        return F.pow(total(F.transform(diff, lambda x: F.pow(x, F.lit(p)))), F.lit(1.0 / p))
    if metric not in ("euclidean", "minkowski"):
        raise ValueError(metric)
    square = total(F.transform(diff, lambda x: x * x))
    return square if squared else F.sqrt(square)


def softmax_cross_entropy(logits: Column, label: Column) -> Column:
    """Loss of one row for a label index; average it over the batch."""
    return logsumexp(logits) - F.element_at(doubles(logits), (label + 1).cast("int"))


def softmax_cross_entropy_dense(logits: Column, target: Column) -> Column:
    """Loss of one row for a target distribution."""
    return logsumexp(logits) * total(target) - dot(logits, target)


def sigmoid_cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of one row, stable on both sides."""
    both = F.zip_with(doubles(logits), doubles(target), lambda x, t: F.greatest(x, F.lit(0.0)) - t * x + F.log1p(F.exp(-F.abs(x))))
    return total(both)


def softmax_cross_entropy_backward(logits: Column, label: Column, batch: Column) -> Column:
    return F.transform(softmax(logits), lambda p, i: (p - F.when(i == label, 1.0).otherwise(0.0)) / batch)


def linear(x: Column, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    """W x + b for a small W given on the driver, as literals."""
    rows = []
    for k, w in enumerate(weight):
        y = dot(x, F.array(*[F.lit(float(v)) for v in w]))
        rows.append(y + float(bias[k]) if bias is not None else y)
    return F.array(*rows)


def tokenize(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def embedding(ids: DataFrame, table: DataFrame, id_col: str, vocab_col: str) -> DataFrame:
    """Rows of ``table`` by id, in a join that Spark broadcasts if the table is small."""
    return ids.join(table.withColumnRenamed(vocab_col, "_vocab"), F.col(id_col) == F.col("_vocab")).drop("_vocab")


def embedding_backward(grads: DataFrame, id_col: str, grad_col: str, padding: int | None = None, by_frequency: bool = False) -> DataFrame:
    """(id, pos, grad): gradients summed per id and position; padding gets none, frequent ids a share each if asked."""
    g = grads.where(F.col(id_col) != padding) if padding is not None else grads
    out = g.select(F.col(id_col).alias("id"), F.posexplode(grad_col).alias("pos", "g")).groupBy("id", "pos").agg(F.sum(F.col("g").cast("double")).alias("grad"), F.count("*").alias("_n"))
    return out.withColumn("grad", F.col("grad") / F.col("_n") if by_frequency else F.col("grad")).drop("_n")

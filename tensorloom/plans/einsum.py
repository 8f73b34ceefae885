"""Einstein summation as a tree of equi-joins and sums.

Operands are relations of coordinates.  The planner contracts two operands at a
time: it prefers pairs that share an index, then the pair whose result is
smallest; an index that no later operand and no output needs is summed as soon
as it can be, so partial sums shrink what is shuffled next.  Products of dense
matrices, seen as such by their shapes, go by tiles (``blocks.py``).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.plans import blocks


@dataclass
class Operand:
    """A relation with one column per index name, and the value ``v``."""

    df: DataFrame
    names: tuple[str, ...]
    sparse: bool = False


def parse(spec: str) -> tuple[list[list[str]], list[str] | None]:
    """``"ij,jk->ik"`` or with no arrow: repeated indices are summed, others kept in order of appearance."""
    left, arrow, right = spec.replace(" ", "").partition("->")
    ins = [re.findall(r"[A-Za-z]", p) for p in left.split(",")]
    if any(len(p) != len(q) for p, q in zip(ins, left.split(","), strict=True)):
        raise ValueError(f"bad einsum {spec!r}")
    return ins, re.findall(r"[A-Za-z]", right) if arrow else None


def output_of(ins: list[list[str]], out: list[str] | None) -> list[str]:
    every = [x for p in ins for x in p]
    if out is None:
        return [x for x in dict.fromkeys(every) if every.count(x) == 1]
    if len(set(out)) != len(out) or not set(out) <= set(every):
        raise ValueError("output indices must be distinct and appear in an operand")
    return out


def sizes_of(ins: list[list[str]], shapes: list[tuple[int, ...]]) -> dict[str, int]:
    sizes: dict[str, int] = {}
    for p, shape in zip(ins, shapes, strict=True):
        if len(p) != len(shape):
            raise ValueError("an operand has another rank than its indices")
        for x, n in zip(p, shape, strict=True):
            if sizes.setdefault(x, n) != n:
                raise ValueError(f"index {x} has sizes {sizes[x]} and {n}")
    return sizes


def _diagonal(df: DataFrame, index: list[str], sparse: bool) -> Operand:
    """Repeated indices within one operand select its diagonal."""
    first: dict[str, str] = {}
    for k, x in enumerate(index):
        if x in first:
            df = df.where(F.col(f"i{k}") == F.col(first[x]))
        else:
            first[x] = f"i{k}"
    return Operand(df.select(*[F.col(c).alias(f"x_{x}") for x, c in first.items()], "v"), tuple(first), sparse)


def _sum_out(op: Operand, keep: set[str]) -> Operand:
    names = tuple(x for x in op.names if x in keep)
    if names == op.names:
        return op
    cols = [f"x_{x}" for x in names]
    return Operand(op.df.groupBy(*cols).agg(F.sum("v").alias("v")), names, op.sparse)


def _dense_enough(op: Operand, sizes: dict[str, int]) -> bool:
    return not op.sparse or op.df.count() >= blocks.DENSE * math.prod(sizes[x] for x in op.names)


def _product(a: Operand, b: Operand, needed: set[str], sizes: dict[str, int]) -> Operand:
    """Both contracted: in tiles where that pays, else one row per product."""
    names = (*a.names, *(x for x in b.names if x not in a.names))
    floating = all(dict(o.df.dtypes)["v"] in ("double", "float") for o in (a, b))
    split = blocks.split(a.names, b.names, needed, sizes) if floating else None
    if split and blocks.worth(split) and _dense_enough(a, sizes) and _dense_enough(b, sizes):
        return Operand(blocks.contract(a.df, b.df, split), (*split.kept, *split.left, *split.right))
    shared = [f"x_{x}" for x in a.names if x in b.names]
    right = b.df.withColumnRenamed("v", "v2")
    # Without a shared index the product is an outer product, as the user asked.
    both = a.df.join(right, shared) if shared else a.df.crossJoin(right)
    both = both.select(*[f"x_{x}" for x in names], (F.col("v") * F.col("v2")).alias("v"))
    return _sum_out(Operand(both, names, a.sparse or b.sparse), needed)


def contract(dfs: list[DataFrame], shapes: list[tuple[int, ...]], spec: str, sparse: list[bool] | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """The result as coordinates i0, i1, ... and v, with its shape; ``sparse`` tells which operands may lack rows."""
    ins, out = parse(spec)
    if len(ins) != len(dfs):
        raise ValueError("einsum needs one list of indices per operand")
    out = output_of(ins, out)
    sizes = sizes_of(ins, shapes)
    ops = [_diagonal(df, p, sp) for df, p, sp in zip(dfs, ins, sparse or [False] * len(dfs), strict=True)]

    def needed(rest: list[Operand]) -> set[str]:
        return set(out) | {x for o in rest for x in o.names}

    ops = [_sum_out(o, needed(ops[:k] + ops[k + 1 :])) for k, o in enumerate(ops)]
    while len(ops) > 1:

        def cost(pair: tuple[int, int]) -> tuple:
            a, b = ops[pair[0]], ops[pair[1]]
            rest = [o for k, o in enumerate(ops) if k not in pair]
            left = (set(a.names) | set(b.names)) & needed(rest)
            return (not set(a.names) & set(b.names), math.prod(sizes[x] for x in left), pair)

        i, j = min(((i, j) for i in range(len(ops)) for j in range(i + 1, len(ops))), key=cost)
        a, b = ops[i], ops[j]
        ops = [o for k, o in enumerate(ops) if k not in (i, j)]
        ops.append(_product(a, b, needed(ops), sizes))
    final = _sum_out(ops[0], set(out))
    return final.df.select(*[F.col(f"x_{x}").alias(f"i{k}") for k, x in enumerate(out)], "v"), tuple(sizes[x] for x in out)

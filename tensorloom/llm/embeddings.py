"""Near copies among vectors by cosine: exact threshold links from a dual traversal of cover trees.

Equal vectors are one class.  Classes are put in order along the nearest pivots and
cut into blocks; each block gets a cover tree whose levels have halving radii, in
angles.  The roots of blocks are leaves of trees one tier up, and so on to one root.
Two trees are then walked together from their roots: a pair of nodes is dropped if
even their nearest members must be too far apart, taken as a whole if even their
farthest members must be near, and otherwise replaced by the pairs of their
children.  What is taken is noted at the two nodes, as a sum of weights; the sums
go down to the vectors at the end, so no pair of vectors is ever a row.

A pair of blocks that is neither dropped nor taken is one task over two arrays of
at most ``BLOCK`` vectors.  Where vectors have no clusters (as random ones in many
dimensions) no bound drops a pair of blocks, and the pairs of blocks grow with the
square of the number of vectors: the price of an exact answer there.

Defined results: null and zero vectors and those with null or non-finite components
link with nothing; vectors of different lengths do not link; copies link with each
other; rows with equal ids stay apart, each with its vector's links, and rows
without an id count as links but do not name a component (null if no row of it has
an id); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import discard, materialize
from tensorloom.llm.components import components

#: Vectors of a block, and blocks or trees under one tree of the next tier.
BLOCK = 4096
#: Vectors, picked by hash, along which blocks are laid out; every vector is then placed and compared.
PIVOTS = 256
#: Angles of the levels of a tree, from the leaves upwards: each is twice the one below.
RADII = [math.pi / 2**k for k in range(6, 0, -1)]
#: Rows of a matrix of node pairs that are computed at a time.
STRIP = 512
#: Bounds give way by this much, so that rounding never decides; vectors themselves are compared exactly.
SLACK = 1e-7
NODE_BITS, TIER_BITS = 15, 44
ROOT = (1 << NODE_BITS) - 1


def node_id(tier: int, block: int, node: np.ndarray, root: int) -> np.ndarray:
    """Ids of nodes over all trees; a tree's root has the same number in each tree."""
    return (((tier << TIER_BITS) + block) << NODE_BITS) + np.where(node == root, ROOT, node)


def cover(vectors: np.ndarray, dims: np.ndarray, radius: float) -> np.ndarray:
    """For each vector the first one that was chosen within ``radius`` of it; the chosen ones are farther apart."""
    owner, free, least = np.full(len(vectors), -1), np.arange(len(vectors)), math.cos(radius)
    while len(free):
        some = free[:STRIP]
        near = vectors[some] @ vectors[free].T >= least
        near &= (dims[some][:, None] == dims[free][None, :]) & (dims[some] >= 0)[:, None]
        for k, one in enumerate(some):
            if owner[one] < 0:
                owner[free[near[k] & (owner[free] < 0)]] = one
                owner[one] = one
        free = free[owner[free] < 0]
    return owner


def build_tree(vectors: np.ndarray, reach: np.ndarray, weight: np.ndarray, dims: np.ndarray) -> dict:
    """Nested levels over unit vectors; ``reach`` is the angle that a leaf's own members keep to it.

    Nodes are numbered leaves first and the root last; ``levels`` has, from the leaves
    up, the nodes of a level and the place of each one's parent in the next level.
    """
    n = len(vectors)
    centre, radius, heavy, kind, parent = list(range(n)), list(reach), list(weight), list(dims), [-1] * n
    alive, raw, under = np.arange(n), [], np.arange(n)  # under: place of each leaf's ancestor in ``alive``
    for r in [*RADII, None]:
        at = np.asarray(centre)[alive]
        owner = cover(vectors[at], np.asarray(kind)[alive], r) if r else np.zeros(len(alive), int)
        chosen, up = np.unique(owner, return_inverse=True)
        raw.append((alive, up))
        under = up[under]
        children, leaves = by_place(up, len(chosen)), by_place(under, len(chosen))
        above = []
        for k, first in enumerate(chosen):
            if len(children[k]) == 1 and r:
                above.append(alive[children[k][0]])
                continue
            own = leaves[k]
            one = len(set(dims[own].tolist())) == 1 and dims[own[0]] >= 0
            spread = np.arccos(np.clip(vectors[own] @ vectors[at[first]], -1, 1)) + reach[own]
            centre.append(int(at[first]))
            radius.append(min(float(spread.max()), math.pi) if one else math.pi)
            heavy.append(int(weight[own].sum()))
            kind.append(int(dims[own[0]]) if one else -1)
            parent.append(-1)
            above.append(len(parent) - 1)
            for child in alive[children[k]]:
                parent[child] = len(parent) - 1
        alive = np.asarray(above)
    levels, place = [(alive, np.zeros(1, int))], np.zeros(1, int)
    for ids, up in reversed(raw):
        order = np.argsort(place[up], kind="stable")
        levels.append((ids[order], place[up][order]))
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
    return {"v": vectors, "centre": np.asarray(centre), "radius": np.asarray(radius), "weight": np.asarray(heavy), "dims": np.asarray(kind), "parent": np.asarray(parent), "levels": levels[::-1]}


def by_place(place: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of ``n`` places who stands there."""
    return np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place, minlength=n))[:-1])


def padded(v: np.ndarray, width: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, width - v.shape[1]))) if v.shape[1] < width else v


def judge(a: dict, ia: np.ndarray, b: dict, ib: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of node pairs: which are near as a whole, and which are still open."""
    far = math.acos(cosine)
    width = max(a["v"].shape[1], b["v"].shape[1])
    cos = padded(a["v"][a["centre"][ia]], width) @ padded(b["v"][b["centre"][ib]], width).T
    ra, rb = a["radius"][ia], b["radius"][ib]
    da, db = a["dims"][ia], b["dims"][ib]
    alpha, inner = far + ra, far - ra
    taken = cos >= np.outer(np.cos(inner), np.cos(rb)) + np.outer(np.sin(inner), np.sin(rb)) + SLACK
    taken &= inner[:, None] >= rb[None, :]
    open_ = cos >= np.outer(np.cos(alpha), np.cos(rb)) - np.outer(np.sin(alpha), np.sin(rb)) - SLACK
    open_ |= alpha[:, None] + rb[None, :] >= math.pi
    exact = np.outer(ra == 0, rb == 0)
    if exact.any():
        taken = np.where(exact, cos >= cosine, taken)
        open_ &= ~exact
    if (da.min(initial=0) != da.max(initial=0)) or (db.min(initial=0) != db.max(initial=0)) or (len(da) and len(db) and da[0] != db[0]) or (da < 0).any():
        same = da[:, None] == db[None, :]
        known = (da >= 0)[:, None] & (db >= 0)[None, :]
        taken &= same & known
        open_ &= same | ~known
    return taken, open_ & ~taken


def walk(a: dict, b: dict, same: bool, cosine: float) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Dual traversal: (nodes of a, nodes of b, matrix of pairs taken as a whole) and the open pairs of leaves."""
    found, mask = [], np.ones((1, 1), bool)
    for level in range(len(a["levels"]) - 1, -1, -1):
        (ids_a, up_a), (ids_b, up_b) = a["levels"][level], b["levels"][level]
        now = np.zeros((len(ids_a), len(ids_b)), bool)
        for start in range(0, len(ids_a), STRIP):
            rows = np.arange(start, min(start + STRIP, len(ids_a)))
            given = mask[up_a[rows]]
            rows = rows[given.any(1)]
            cols = np.flatnonzero(given.any(0)[up_b])
            if not len(rows) or not len(cols):
                continue
            asked = mask[np.ix_(up_a[rows], up_b[cols])]
            if same:
                asked &= rows[:, None] <= cols[None, :]
            taken, open_ = judge(a, ids_a[rows], b, ids_b[cols], cosine)
            taken &= asked
            if taken.any():
                r, c = taken.any(1), taken.any(0)
                found.append((ids_a[rows[r]], ids_b[cols[c]], taken[np.ix_(r, c)]))
            now[np.ix_(rows, cols)] = open_ & asked
        mask = now
        if not mask.any():
            return found, np.empty(0, int), np.empty(0, int)
    ids_a, ids_b = a["levels"][0][0], b["levels"][0][0]
    i, j = np.nonzero(mask)
    return found, ids_a[i], ids_b[j]


def linked(a: dict, b: dict, same: bool, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Per node of a, then of b: weight linked to it, and a node of its group by these links."""
    shift = 0 if same else len(a["parent"])
    add = np.zeros(shift + len(b["parent"]), np.int64)
    label = np.arange(len(add))
    for ia, ib, pairs in found:
        count = pairs.astype(np.float64)
        np.add.at(add, ia, (count @ b["weight"][ib]).astype(np.int64))
        np.add.at(add, ib + shift, (a["weight"][ia] @ count).astype(np.int64))
        if same:
            own = ia[(pairs & (ia[:, None] == ib[None, :])).any(1)]
            np.subtract.at(add, own, a["weight"][own] + 1)
    while found:
        before = label.copy()
        for ia, ib, pairs in found:
            most = np.int64(len(label))
            low = np.where(pairs, label[ib + shift][None, :], most).min(1)
            np.minimum.at(label, ia, low)
            low = np.where(pairs, label[ia][:, None], most).min(0)
            np.minimum.at(label, ib + shift, low)
        label = label[label]
        if (label == before).all():
            break
    return add, label


def traverse(tier: int, cosine: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of blocks with their trees -> rows (kind, x, y, n): links added to a node, edges, and pairs of blocks one tier down."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, q, packed_p, packed_q in zip(frame["p"], frame["q"], frame["tree_p"], frame["tree_q"]):
                same = p == q
                a = pickle.loads(packed_p)
                b = a if same else pickle.loads(packed_q)
                found, i, j = walk(a, b, same, cosine)
                add, label = linked(a, b, same, found)
                na = len(a["parent"])
                ids = node_id(tier, p, np.arange(na), na - 1)
                if not same:
                    ids = np.concatenate([ids, node_id(tier, q, np.arange(len(b["parent"])), len(b["parent"]) - 1)])
                linked_, tied = np.flatnonzero(add), np.flatnonzero(label != np.arange(len(label)))
                yield pd.DataFrame({"kind": 0, "x": ids[linked_], "y": 0, "n": add[linked_]})
                yield pd.DataFrame({"kind": 1, "x": ids[tied], "y": ids[label[tied]], "n": 0})
                if tier:
                    yield pd.DataFrame({"kind": 2, "x": p * BLOCK + i, "y": q * BLOCK + j, "n": 0})

    return run


def settle_down(tier: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks with what was noted at their nodes -> rows (kind, x, y, n): sums at leaves (roots of blocks one tier down), and edges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, packed, nodes, sums in zip(frame["block"], frame["tree"], frame["nodes"], frame["sums"]):
                t = pickle.loads(packed)
                n, leaves = len(t["parent"]), len(t["v"])
                add = np.zeros(n, np.int64)
                nodes = np.asarray(nodes)
                add[np.where(nodes == ROOT, n - 1, nodes)] = sums
                own, near = add > 0, np.full(n, -1)
                for node in range(n - 2, -1, -1):  # parents have greater numbers
                    up = t["parent"][node]
                    add[node] += add[up]
                    near[node] = up if own[up] else near[up]
                ids = node_id(tier, block, np.arange(n), n - 1)
                hit = np.flatnonzero(add[:leaves])
                tied = np.flatnonzero((near >= 0) & (own | (np.arange(n) < leaves)))
                below = node_id(tier - 1, block * BLOCK + hit, np.full(len(hit), ROOT), ROOT) if tier else ids[hit]
                yield pd.DataFrame({"kind": 0, "x": below, "y": 0, "n": add[hit]})
                yield pd.DataFrame({"kind": 1, "x": ids[tied], "y": ids[near[tied]], "n": 0})
                if tier:
                    yield pd.DataFrame({"kind": 1, "x": ids[hit], "y": below, "n": 0})

    return run


def plant(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks as arrays -> (block, tree) with what the block's root is one tier up."""
    for frame in frames:
        for block, leaves in zip(frame["block"], frame["leaves"]):
            parts = [np.frombuffer(x["unit"]) for x in leaves]
            width = max(map(len, parts))
            vectors = np.stack([np.pad(v, (0, width - len(v))) for v in parts])
            t = build_tree(vectors, *[np.array([x[c] for x in leaves]) for c in ("reach", "weight", "dims")])
            root = len(t["parent"]) - 1
            unit = vectors[t["centre"][root]].tobytes()
            yield pd.DataFrame([(block, pickle.dumps(t), unit, float(t["radius"][root]), int(t["weight"][root]), int(t["dims"][root]))], columns=["block", "tree", "unit", "reach", "weight", "dims"])


TREES = "block long, tree binary, unit binary, reach double, weight long, dims int"
NOTES = "kind int, x long, y long, n long"


def unit_of(values: list | np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def placed(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Classes plus their unit vector and their place: length, nearest pivot, angle to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units = [unit_of(e) for e in frame.pop("embedding")]
            frame["dims"] = [len(u) for u in units]
            frame["pivot"], frame["angle"] = -1, 0.0
            for d, own in frame.groupby("dims").groups.items():
                if d in pivots:
                    cos = np.stack([units[k] for k in own]) @ pivots[d].T
                    frame.loc[own, "pivot"] = cos.argmax(1)
                    frame.loc[own, "angle"] = np.arccos(np.clip(cos.max(1), -1, 1))
            frame["unit"] = [u.tobytes() for u in units]
            yield frame

    return run


def classes_of(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Distinct vectors that can link, with their number of rows; a class goes by 128 bits of hash."""
    return vectors.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first(vector_col).alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, array of numbers) -> (vec_id, n_links, component_id, kept), one row per row."""
    spark = vectors.sparkSession
    values = F.col(vector_col).cast("array<double>")
    fit = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(values, lambda x: x != 0)
    hashed = lambda v: F.when(fit, F.xxhash64(v))
    rows = vectors.select(F.col(id_col).alias("vec_id"), hashed(values).alias("h1"), hashed(F.reverse(values)).alias("h2"), values.alias("embedding"))
    classes = materialize(classes_of(rows, "embedding"), "classes")

    chosen: dict[int, list] = {}
    for row in classes.orderBy("h1", "h2").select("embedding").limit(PIVOTS).collect():
        chosen.setdefault(len(row[0]), []).append(unit_of(row[0]))
    schema = "h1 long, h2 long, weight long, least {}, dims int, pivot int, angle double, unit binary".format(classes.schema["least"].dataType.simpleString())
    put = classes.select("h1", "h2", "weight", "least", "embedding").mapInPandas(placed({d: np.stack(v) for d, v in chosen.items()}), schema)
    order = ["dims", "pivot", "angle", "h1", "h2"]
    dealt = materialize(put.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    discard(classes)

    # Dense places: one row per range tells how many classes stand before it.
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, n = [], 0
    for r in sizes:
        before.append((r["part"], n))
        n += r["n"]
    starts = spark.createDataFrame(before, "part long, start long")
    place = F.expr(f"(at & {(1 << 33) - 1}) + start")
    leaves = dealt.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", place)
    leaves = leaves.select("h1", "h2", "weight", "least", "dims", "unit", F.lit(0.0).alias("reach"), "place")

    trees, below, size = [], leaves, n
    while not trees or size > 1:
        leaf = F.struct("place", "unit", "reach", "weight", "dims")
        blocks = below.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
        trees.append(materialize(blocks.mapInPandas(plant, TREES), "trees"))
        below = trees[-1].withColumnRenamed("block", "place").drop("tree")
        size = -(-size // BLOCK)

    notes = []
    pairs = spark.range(1 if n else 0).select(F.col("id").alias("p"), F.col("id").alias("q"))
    for tier in range(len(trees) - 1, -1, -1):
        left = trees[tier].select(F.col("block").alias("p"), F.col("tree").alias("tree_p"))
        right = trees[tier].select(F.col("block").alias("q"), F.col("tree").alias("tree_q"))
        met = pairs.join(left, "p").join(right, "q").select("p", "q", "tree_p", "tree_q")
        notes.append(materialize(met.mapInPandas(traverse(tier, cosine), NOTES), "notes"))
        pairs = notes[-1].where("kind = 2").select(F.col("x").alias("p"), F.col("y").alias("q"))

    edges = notes[0].where("kind = 1")
    for note in notes[1:]:
        edges = edges.unionByName(note.where("kind = 1"))
    sums = None
    for tier, note in zip(range(len(trees) - 1, -1, -1), notes):
        noted = note.where("kind = 0").select("x", "n")
        if sums is not None:
            noted = noted.unionByName(sums.where("kind = 0").select("x", "n"))
        each = noted.groupBy("x").agg(F.sum("n").alias("n"))
        block = F.expr(f"(x >> {NODE_BITS}) & {(1 << TIER_BITS) - 1}").alias("block")
        node = F.expr(f"x & {ROOT}").alias("node")
        of_block = each.select(block, F.struct(node, "n").alias("s")).groupBy("block").agg(F.collect_list("s").alias("s"))
        of_block = of_block.select("block", F.col("s.node").alias("nodes"), F.col("s.n").alias("sums")).join(trees[tier].select("block", "tree"), "block")
        sums = materialize(of_block.select("block", "tree", "nodes", "sums").mapInPandas(settle_down(tier), NOTES), "sums")
        edges = edges.unionByName(sums.where("kind = 1"))

    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    leaf_id = F.expr(f"(place div {BLOCK}) * {1 << NODE_BITS} + place % {BLOCK}")
    links = sums.where("kind = 0").select(F.col("x").alias("leaf"), F.col("n").alias("n_links"))
    named = leaves.select("h1", "h2", "least", leaf_id.alias("leaf")).join(links, "leaf", "left").join(groups.withColumnRenamed("node", "leaf"), "leaf", "left")
    named = materialize(named.select("h1", "h2", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "leaf").alias("root")), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "root").select("h1", "h2", "n_links", "component_id", F.lit(True).alias("found"))
    out = rows.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""N-gram Jaccard join: prefix trees over globally ordered n-gram sets.

1. Every document's distinct word n-grams are hashed to 64 bits; documents with
   equal sets become one node.  N-grams are counted over the whole corpus as
   packed 32-bit fingerprints, and the most frequent ``ORDERED`` of them are
   ranked.  The global order is: unranked n-grams first, then by rising count.
   Any order gives the same links; this one keeps frequent passages at the end.
2. Two sets with Jaccard similarity t share an n-gram among the first
   ``n - ceil(t * n) + 1`` of each, so nodes meet in groups by those n-grams.
   Each group is named after its smallest node, which merges groups of the same
   copies.  Large groups are cut into blocks, which meet a few members of the
   group first; only if that leaves the group in parts do blocks meet pairwise.
3. In a group the ordered sets form a path-compressed prefix tree.  A node walks
   down with its own set, the overlap so far is shared by all sets below a
   branch, and a branch is left when its sizes or its remaining lengths rule the
   threshold out.  What arrives at a leaf is compared exactly by integers.  Only
   links that join two parts of a group are kept, so a task of m nodes yields
   fewer than m links however many pairs agree.
4. Links are contracted to components.

Before sets travel, the nodes of a group compare parity bitmaps of their sets:
the bits in which two differ are a lower bound of the symmetric difference, so
what this rules out cannot link.  Sets are made again only for the documents of
nodes that are left; those are told by a bit filter of fixed size, whose false
positives cost time and nothing else.  Results are exact up to 64-bit hashing.

Defined results: null, empty or wordless texts have no n-gram and link with
nothing; shorter texts than n words have one; equal texts and repeated rows
share their component; rows without an id take part with no say in the smallest
id; texts are cut into n-grams whole, however long; an empty table gives an empty
result; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import discard, hold, materialize
from tensorloom.llm.components import components

#: Ranked n-grams (12 bytes each in the broadcast), the ranges in which they are counted, and fingerprints held before they are.
ORDERED, RANGES, HELD = 1 << 20, 4096, 4_000_000
#: Bits of the filter of documents whose sets are needed, and nodes in a block of a large group.
FILTER_BITS, BLOCK = 1 << 26, 512
#: Members of a large group that all its blocks meet first, about.
PIVOTS = 8
#: Low bits of an n-gram's row that hold the size of its set; larger sizes meet all.
SIZE_BITS = 20
TOP_SIZE = (1 << SIZE_BITS) - 1
CACHE = 200_000

_M = [np.uint64(x | 1) for x in np.frombuffer(hashlib.sha512(b"n-gram multipliers").digest() * 2, "<u8")]


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        v = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) >= CACHE:
            self.clear()
        self[w] = v
        return v


def grams(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of ``text`` in ASCII lower case."""
    # bytes.lower and bytes.split know ASCII letters and white space only.
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    size = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            x = w[k : len(w) - size + 1 + k]
            h = (h ^ (h >> np.uint64(31))) * _M[k % 8] + x * _M[(k + 3) % 8]
        h ^= h >> np.uint64(32)
        h *= _M[7]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    hold("ngram_join")
    for b in parts:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _counting(n: int):
    """Packed fingerprints by range: the high 32 bits of each hash, once per document."""

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = _WordHash(), [], 0

        def flush() -> pa.RecordBatch:
            fp = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint32)
            cuts = np.searchsorted(fp, np.arange(RANGES, dtype=np.uint64) << np.uint64(33 - RANGES.bit_length())).tolist() + [len(fp)]
            some = [k for k in range(RANGES) if cuts[k] < cuts[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([fp[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())], ["r", "fp"])

        for _, t in _texts(parts):
            s = grams(t, n, cache)
            if len(s):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return count


def _ranking(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, the most frequent fingerprints that occur twice or more.

    What is held is counted whenever it grows over HELD, so memory is bounded by
    the fingerprints that a range can have, whatever the corpus.
    """
    now, held, size = None, [], 0
    known = (np.empty(0, np.uint32), np.empty(0, np.int64))

    def counted() -> tuple[np.ndarray, np.ndarray]:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        if not len(known[0]):
            return u, c
        both, at = np.unique(np.concatenate([known[0], u]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([known[1], c])).astype(np.int64)

    def top() -> pa.RecordBatch:
        u, c = counted()
        k = np.flatnonzero(c > 1)
        k = k[np.lexsort((u[k], -c[k]))][: ORDERED // RANGES]
        return pa.RecordBatch.from_arrays([pa.array(u[k].astype(np.int64)), pa.array(c[k].astype(np.int64))], ["fp", "n"])

    for b in parts:
        for r, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != now and held:
                yield top()
                held, size, known = [], 0, (np.empty(0, np.uint32), np.empty(0, np.int64))
            elif size > HELD:
                known, held, size = counted(), [], 0
            now = r
            held.append(np.frombuffer(fp, np.uint32))
            size += len(held[-1])
    if held:
        yield top()


def ordered(s: np.ndarray, fps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``s`` in the global order."""
    if not len(fps):
        return s
    f = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(fps, f), len(fps) - 1)
    return s[np.argsort(np.where(fps[at] == f, counts[at], 0), kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of hashes that fall on each bit; about one bit for one or two hashes, a power of two in all."""
    bits = 1 << max(6, len(s).bit_length() - 1)
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(bitmaps: list[bytes], sizes: np.ndarray, percent: int, cross: int | None = None) -> np.ndarray:
    """Which rows have a partner that sizes and bitmaps do not rule out; with ``cross``, across that position only.

    Of two bitmaps the longer one's halves are folded onto each other until both
    have the same length, which keeps parities.
    """
    out = np.zeros(len(sizes), bool)
    length = np.array([len(b) for b in bitmaps])
    side = np.zeros(len(sizes), bool) if cross is None else np.arange(len(sizes)) >= cross
    rows = {n: np.flatnonzero(length == n) for n in np.unique(length).tolist()}
    words = {n: np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64 if n >= 8 else np.uint8).reshape(len(at), -1) for n, at in rows.items()}

    def meet(k: int, own: np.ndarray, others: np.ndarray, bits: np.ndarray) -> None:
        n, m = int(sizes[k]), sizes[others]
        ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        if cross is not None:
            ok &= side[others] != side[k]
        some = np.flatnonzero(ok)
        if len(some):
            near = (100 + percent) * np.bitwise_count(own ^ bits[some]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n + m[some])
            if near.any():
                out[k] = True
                out[others[some[near]]] = True

    for n, at in rows.items():
        for i, k in enumerate(at.tolist()):
            meet(k, words[n][i], at[i + 1 :], words[n][i + 1 :])
        folded, m = np.ascontiguousarray(words[n]).view(np.uint8), n
        while m > min(rows):
            m //= 2
            folded = folded[:, :m] ^ folded[:, m:]
            if m in rows and 100 * int(sizes[rows[m]].max()) >= percent * int(sizes[at].min()):
                own = np.ascontiguousarray(folded).view(words[m].dtype)
                for i, k in enumerate(at.tolist()):
                    meet(k, own[i], rows[m], words[m])
    return out


def _postings(n: int, percent: int, order):
    def emit(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document a row with its id; per new node its first n-grams."""
        cache, (fps, counts), seen = _WordHash(), order.value, set()
        for b in parts:
            ids, nodes, sizes, bits, toks, owner = [], [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = grams(t, n, cache)
                node = node_of(s)
                ids.append(i)
                nodes.append(node)
                sizes.append(len(s))
                bits.append(None)
                if len(s) and node not in seen:
                    seen.add(node)
                    bits[-1] = bitmap(s)
                    p = ordered(s, fps, counts)[: prefix_length(len(s), percent)]
                    # The size takes the place of the low bits: a shorter n-gram hash only makes more candidates.
                    toks.append(((p >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS)) | np.uint64(min(len(s), TOP_SIZE))).view(np.int64))
                    owner.append(np.full(len(p), node, np.int64))
            tok = np.concatenate([np.empty(0, np.int64), *toks])
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(tok), np.int8), np.ones(k, np.int8)])),
                    pa.chunked_array([pa.array(tok), pa.array(ids, pa.int64())]).combine_chunks(),
                    pa.array(np.concatenate([np.empty(0, np.int64), *owner, np.array(nodes, np.int64)])),
                    pa.chunked_array([pa.nulls(len(tok), pa.int32()), pa.array(sizes, pa.int32())]).combine_chunks(),
                    pa.chunked_array([pa.nulls(len(tok), pa.binary()), pa.array(bits, pa.binary())]).combine_chunks(),
                ],
                ["kind", "x", "node", "n", "bits"],
            )

    return emit



def _sets(n: int, order, wanted):
    """Node and ordered set of the documents that the filter lets through."""

    def emit(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (fps, counts), (slots, masks), seen = _WordHash(), order.value, wanted.value, set()
        for b in parts:
            ids = b.column(0)
            bit = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), FILTER_BITS)
            if len(slots):
                at = np.minimum(np.searchsorted(slots, bit >> 6), len(slots) - 1)
                held = (slots[at] == bit >> 6) & ((masks[at] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            else:
                held = np.zeros(len(bit), bool)
            # A row without an id can not be told: its set is made.
            held |= ids.is_null().to_numpy(zero_copy_only=False)
            nodes, blobs = [], []
            for t in b.column(1).filter(pa.array(held)).to_pylist():
                s = grams(t, n, cache)
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    blobs.append(ordered(s, fps, counts).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "grams"])

    return emit


class PrefixTree:
    """Path-compressed prefix tree over sequences of local n-gram numbers."""

    def __init__(self, seqs: list[np.ndarray]):
        order = sorted(range(len(seqs)), key=lambda k: seqs[k].tobytes())
        # Big-endian numbers sort by bytes as by value.
        self.leaf_of: list[int] = []
        lo, hi, parent, depth, least, most, level = [], [], [], [], [], [], []
        flat, size = [], 0
        stack: list[int] = []

        def add(seq_lo: int, seq_hi: int, up: int) -> int:
            lo.append(seq_lo)
            hi.append(seq_hi)
            parent.append(up)
            return len(lo) - 1

        starts = []
        before = None
        for k in order:
            s = seqs[k]
            at, size = size, size + len(s)
            flat.append(s)
            starts.append(at)
            shared = 0
            if before is not None:
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                shared = int(differ[0]) if len(differ) else m
            # stack: nodes on the path, each as (node, depth at its end)
            while stack and stack[-1][1] > shared:
                node, end = stack.pop()
                begin = stack[-1][1] if stack else 0
                if begin < shared:
                    # Split the edge: its upper part becomes a node of its own.
                    upper = add(lo[node], lo[node] + shared - begin, parent[node])
                    lo[node] += shared - begin
                    parent[node] = upper
                    stack.append((upper, shared))
                    break
            up = stack[-1][0] if stack else -1
            leaf = add(at + shared, at + len(s), up)
            stack.append((leaf, len(s)))
            self.leaf_of.append(leaf)
            before = s
        self.flat = np.concatenate(flat)
        self.lo, self.hi, self.parent = np.array(lo), np.array(hi), np.array(parent)
        self.order = order
        count = len(lo)
        self.depth = np.zeros(count, np.int64)
        self.level = np.zeros(count, np.int64)
        done = np.zeros(count, bool)
        rest = np.arange(count)
        while len(rest):
            ready = rest[(self.parent[rest] < 0) | done[self.parent[rest]]]
            p = self.parent[ready]
            self.depth[ready] = self.hi[ready] - self.lo[ready] + np.where(p >= 0, self.depth[p], 0)
            self.level[ready] = np.where(p >= 0, self.level[p] + 1, 0)
            done[ready] = True
            rest = rest[~done[rest]]
        # Least and most full lengths below each node.
        self.least, self.most = np.full(count, 1 << 60), np.zeros(count, np.int64)
        self.leaf_seq = np.full(count, -1)
        for leaf, k in zip(self.leaf_of, order, strict=True):
            self.least[leaf] = self.most[leaf] = len(seqs[k])
            self.leaf_seq[leaf] = k
        for lv in range(int(self.level.max()), 0, -1):
            at = np.flatnonzero(self.level == lv)
            np.minimum.at(self.least, self.parent[at], self.least[at])
            np.maximum.at(self.most, self.parent[at], self.most[at])
        self.by_level = [np.flatnonzero(self.level == lv) for lv in range(int(self.level.max()) + 1)]

    def search(self, mine: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequences that may reach the threshold, and their exact overlap with ``mine`` (a mask of numbers)."""
        alive = np.zeros(len(self.lo), bool)
        overlap = np.zeros(len(self.lo), np.int64)
        out_seq, out_overlap = [], []
        for at in self.by_level:
            p = self.parent[at]
            at = at[(p < 0) | alive[p]]
            # 100 * |a| >= percent * |b| both ways, for some length below.
            at = at[(100 * self.most[at] >= percent * size) & (percent * self.least[at] <= 100 * size)]
            if not len(at):
                break
            p = self.parent[at]
            n = self.hi[at] - self.lo[at]
            ends = np.cumsum(n)
            index = np.repeat(self.lo[at] - (ends - n), n) + np.arange(int(ends[-1]))
            hits = np.concatenate([[0], np.cumsum(mine[self.flat[index]])])
            got = hits[ends] - hits[ends - n] + np.where(p >= 0, overlap[p], 0)
            overlap[at] = got
            # Even if all that remains agreed: overlap >= percent / (100 + percent) * (|a| + |b|).
            top = np.minimum(got + np.minimum(self.most[at] - self.depth[at], size - got), size)
            fits = top * (100 + percent) >= percent * (size + self.least[at])
            alive[at] = fits
            leaf = at[fits & (self.leaf_seq[at] >= 0)]
            out_seq.append(self.leaf_seq[leaf])
            out_overlap.append(overlap[leaf])
        if not out_seq:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_seq), np.concatenate(out_overlap)


def links(sets: list[np.ndarray], percent: int, cross: int | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets whose similarity reaches ``percent``; a forest.

    With ``cross``, only sets before that position meet sets from it on.
    """
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    seqs, at = [], 0
    for s in sets:
        seqs.append(inverse[at : at + len(s)].astype(">i4"))
        at += len(s)
    below = list(range(len(sets)))

    def root(x: int) -> int:
        while below[x] != x:
            below[x] = below[below[x]]
            x = below[x]
        return x

    inside = range(len(sets)) if cross is None else range(cross, len(sets))
    tree = PrefixTree([seqs[k] for k in inside])
    tree.flat = tree.flat.astype(np.int64)
    offset, mask, out = inside.start, np.zeros(int(inverse.max()) + 1, bool), []
    lengths = np.array([len(s) for s in sets])
    for k in range(len(sets)) if cross is None else range(cross):
        x = seqs[k].astype(np.int64)
        mask[x] = True
        found, overlap = tree.search(mask, len(x), percent)
        mask[x] = False
        found = found + offset
        ok = found[100 * overlap >= percent * (len(x) + lengths[found] - overlap)]
        for j in ok.tolist():
            a, b = root(k), root(j)
            if a != b:
                below[max(a, b)] = min(a, b)
                out.append((k, j))
    return out


def _tasks(parts: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (lead, i, j, own, node, ...) sorted by lead, i, j: the rows of one group, or of one pair of its blocks, first block first."""
    now, rows = None, []
    for b in parts:
        for r in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)], strict=True):
            if r[:3] != now and rows:
                yield sorted(rows, key=lambda x: x[3] != x[1])
                rows = []
            now = r[:3]
            rows.append(r)
    if rows:
        yield sorted(rows, key=lambda x: x[3] != x[1])


def _cross(rows: list[tuple]) -> int | None:
    """Where the second block begins, if the task is a pair of blocks."""
    return None if rows[0][1] == rows[0][2] else sum(r[3] == r[1] for r in rows)


def _pruning(percent: int):
    def prune(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tasks(parts):
            keep = [r[:5] for r, ok in zip(rows, may_link([r[6] for r in rows], np.array([r[5] for r in rows]), percent, _cross(rows)), strict=True) if ok]
            if keep:
                lead, i, j, own, node = zip(*keep, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own, pa.int32()), pa.array(node, pa.int64())], ["lead", "i", "j", "own", "node"])

    return prune


def _joining(percent: int):
    def join(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tasks(parts):
            cross = _cross(rows)
            if len(rows) < 2 or cross in (0, len(rows)):
                continue
            found = links([np.frombuffer(r[5], np.uint64) for r in rows], percent, cross)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[a][4] for a, _ in found], pa.int64()), pa.array([rows[b][4] for _, b in found], pa.int64())], ["a", "b"])

    return join


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id_col, n_shingles (long), component_id (long; the smallest id reachable).

    Sets of word ``n``-grams link when 100 * |A and B| >= percent * |A or B|.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    parts = max(1, int(conf))

    counted = src.mapInArrow(_counting(n), "r int, fp binary").repartition(parts, "r").sortWithinPartitions("r")
    ranked = counted.mapInArrow(_ranking, "fp long, n long").toArrow()
    fps, counts = ranked.column("fp").to_numpy().astype(np.uint32), ranked.column("n").to_numpy()
    by = np.argsort(fps)
    order = spark.sparkContext.broadcast((fps[by], np.minimum(counts[by], 2**31 - 1).astype(np.int32)))

    posted = materialize(src.mapInArrow(_postings(n, percent, order), "kind byte, x long, node long, n int, bits binary"), "postings")
    docs = posted.where("kind = 1").select(F.col("x").alias("id"), "node", "n")
    # Nodes with an n-gram in common, by size: a group ends where the next size is out of reach for all before.
    # Each group is named after its first node, in one pass over rows dealt by n-gram; groups are not gathered.
    held = posted.where("kind = 0").select("x", "node").repartition(parts, F.expr(f"shiftright(x, {SIZE_BITS})"))
    held = held.select(F.expr(f"shiftright(x, {SIZE_BITS})").alias("tok"), F.expr(f"x & {TOP_SIZE}").alias("n"), "node")
    w = Window.partitionBy("tok").orderBy("n", "node")
    apart = (100 * F.col("n") < percent * F.lead("n").over(w)) & (F.lead("n").over(w) < TOP_SIZE)
    held = held.withColumn("ends", F.coalesce(apart, F.lit(False)))
    opens = F.coalesce(F.lag("ends").over(w), F.lit(True))
    pairs = held.withColumn("lead", F.last(F.when(opens, F.col("node")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = pairs.where("node <> lead").select("node", "lead").distinct()
    pairs = materialize(pairs.select("lead", "node"), "pairs")
    met = pairs.unionAll(pairs.select("lead", F.col("lead").alias("node")).distinct())

    sizes = met.groupBy("lead").agg(F.count("*").alias("members"))
    # A row for each group that is larger than a block.
    big = materialize(sizes.where(F.col("members") > BLOCK).select("lead", "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "big")
    placed = met.join(big, "lead", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    bits = posted.where("kind = 1 and bits is not null").dropDuplicates(["node"]).select("node", "n", "bits")

    def linked(tasks: DataFrame, name: str) -> DataFrame:
        """Links (a, b) within tasks (lead, i, j, own, node)."""
        drawn = tasks.join(bits, "node").select("lead", "i", "j", "own", "node", "n", "bits")
        drawn = drawn.repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j")
        left = materialize(drawn.mapInArrow(_pruning(percent), "lead long, i int, j int, own int, node long"), "left")
        # One document for each node that is left: at most FILTER_BITS / 64 slots of a bit filter.
        wanted = docs.join(left.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id")).where("id is not null")
        slot = F.floor(F.pmod("id", F.lit(FILTER_BITS)) / 64).cast("int")
        filled = wanted.groupBy(slot.alias("s")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(id, {FILTER_BITS}) % 64 as int)))").alias("m")).orderBy("s").toArrow()
        sent = spark.sparkContext.broadcast((filled.column("s").to_numpy(), filled.column("m").to_numpy().astype(np.int64).view(np.uint64)))
        sets = src.mapInArrow(_sets(n, order, sent), "node long, grams binary").dropDuplicates(["node"])
        full = left.join(sets, "node").select("lead", "i", "j", "own", "node", "grams")
        full = full.repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j")
        found = materialize(full.mapInArrow(_joining(percent), "a long, b long"), name)
        discard(left)
        return found

    edges = None
    if big.take(1):
        # Large groups first meet a few of their own members, block by block: near copies then hang together,
        # and a group of one component needs no pairs of blocks.  Others go on as if nothing had been found.
        some = placed.where("blocks > 1")
        pivots = some.where(F.pmod(F.xxhash64(F.lit(17), "node"), F.col("members")) < PIVOTS).select("lead", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "node")
        stars = some.select("lead", "own", F.col("own").alias("i"), "node").unionByName(pivots).distinct()
        edges = linked(stars.select("lead", "i", F.col("i").alias("j"), F.col("i").alias("own"), "node"), "stars")
        roots = components(edges)
        met_roots = some.select("lead", "node").join(roots, "node", "left").select("lead", F.coalesce("root", "node").alias("root"))
        whole = met_roots.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low = high").select("lead")
        placed = placed.join(materialize(whole, "whole"), "lead", "left_anti")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    rest = linked(placed.select("lead", "own", "node", F.explode(meets).alias("t")).select("lead", "t.i", "t.j", "own", "node"), "links")
    edges = rest if edges is None else edges.unionAll(rest)

    roots = components(edges)
    smallest = docs.where("n > 0").groupBy("node").agg(F.min("id").alias("low"))
    named = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = materialize(named.join(of_root, "root").select("node", "component_id"), "nodes")
    out = docs.join(of_node, "node", "left")
    discard(pairs, big)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

"""SimHash near-duplicates through vantage-point trees (operator 10).

1. Fingerprints: 64-bit majority of the XXH64 hashes (seed 42) of 3-word shingles, one pass
   over the texts in Python (xxhash and numpy), bounded blocks of shingles at a time.
2. Equal fingerprints collapse to one (map-side combine), so copies cost nothing further.
3. A vantage-point tree over a bounded sample of fingerprints cuts Hamming space into
   shards: at each node distance to the vantage <= radius goes inside, else outside. Shards are
   large, so that few levels of the tree replicate queries through the shuffle; every
   fingerprint has one home shard and is also sent, as a query, to the shards that the
   triangle bound (distance to the boundary <= 2) cannot rule out. The sample only shapes
   the shards; links are exact for any sample.
4. In each shard a vantage-point tree over the home fingerprints answers all queries of the
   shard with the same bound, and the links found there shrink to a spanning forest. Where no
   vantage splits a dense leaf (the variants of one large template), points meet in the values one
   flipped bit away: two are within two bits if and only if they share one. Same links, but
   n log n work and bounded memory.
5. Components: rounds of contraction to the neighbour of least hashed order, each round's
   tables written to the shared folder.

Defined results: null, empty and wordless texts have fingerprint zero and link like any
other; repeated rows are all returned; a null doc_id counts for no component_id (null if
there is no other); an empty input gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, map_texts, partitions_of, text_or_empty, without_listed, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: The tree's sample: so many fingerprints at least, one in 64 beyond that, so many at most (8 MB).
SAMPLE = 1 << 15
MOST_SAMPLE = 1 << 20
#: Most distinct fingerprints a shard should hold (2 MB of them). Below that there are as many shards
#: as the session has shuffle partitions, if that leaves each LEAST_SHARD fingerprints.
SHARD = 1 << 18
LEAST_SHARD = 4096
LEAF = 48
#: A leaf of more points is matched by shared values one bit away; so many values are held at a time.
DENSE = 2048
VALUES = 1 << 22
#: Points of a leaf, and queries, that are compared at once.
BLOCK = (1024, 4096)
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first: byte lanes of 64-bit sums of up to 255 rows."""
    rows = -(-len(hashes) // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[: len(hashes)] = hashes
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _LANES).reshape(rows, 255).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.view(np.uint8).reshape(rows, 8).sum(axis=0)
    return counts.reshape(64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED, block: int = 65536) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)]
        counts += _bit_counts(np.array(part, np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a long) of each row."""

    def make():
        def apply(texts: list, columns: dict) -> dict:
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            return {"id": columns["id"], "fp": fps}

        return apply

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return map_texts(rows, make, "id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(points: np.ndarray, size: int, reach: int = MAX_BITS, tries: int = 6, seed: int = 1) -> tuple:
    """A vantage-point tree as nested tuples: (vantage, radius, inside, outside) or (points,).

    Of a few vantages and radii the one with the least work on both sides is taken; a set
    that no vantage splits (few distinct points) stays one leaf.
    """
    if len(points) <= size:
        return (points,)
    rng, best = np.random.default_rng(seed), None
    for v in points[rng.choice(len(points), min(tries, len(points)), replace=False)]:
        below = np.cumsum(np.bincount(_distance(points, v), minlength=65))
        for q in (0.35, 0.5, 0.65):
            r = min(int(np.searchsorted(below, q * len(points))), 64)
            inside, outside = int(below[r]), len(points) - int(below[r])
            if not inside or not outside:
                continue
            work = int(below[min(64, r + reach)]) * inside + (len(points) - (int(below[r - reach]) if r >= reach else 0)) * outside
            if best is None or work < best[0]:
                best = work, v, r
    if best is None or best[0] >= 0.98 * len(points) ** 2:
        return (points,)
    _, v, r = best
    near = _distance(points, v) <= r
    return np.uint64(v), r, grow(points[near], size, reach, tries, seed * 2), grow(points[~near], size, reach, tries, seed * 2 + 1)


def visit(tree: tuple, points: np.ndarray, reach: int, at: np.ndarray | None = None, path: int = 1) -> Iterator[tuple[int, tuple, np.ndarray]]:
    """(leaf number, leaf, indices of the points that may have a neighbour there)."""
    at = np.arange(len(points)) if at is None else at
    if not len(at):
        return
    if len(tree) == 1:
        yield path, tree, at
        return
    v, r, inside, outside = tree
    d = _distance(points[at], v).astype(np.int64)
    yield from visit(inside, points, reach, at[d <= r + reach], 2 * path)
    yield from visit(outside, points, reach, at[d > r - reach], 2 * path + 1)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each node's component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        old = label.copy()
        for side in (a, b):
            np.minimum.at(label, side, low)
            np.minimum.at(label, old[side], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(old, label):
            return label


def meetings(points: np.ndarray, at: np.ndarray, leaf: np.ndarray, reach: int = MAX_BITS, most: int = VALUES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) that connect the points `leaf` and the points `at` (both indices of `points`) as
    all their pairs within `reach` (1 or 2) bits would.

    Points of the leaf stand at themselves and at all values one bit away; those of `at` too if reach
    is 2, else only at themselves. All that stand at one value are linked to one of the other side
    there. Values are taken in passes by their hash, about `most` at a time.
    """
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    sides = [(leaf, flips), (at, flips if reach == 2 else flips[:1])]
    passes = max(1, -(-sum(len(p) * len(f) for p, f in sides) // most))
    step = max(1, most // 65)
    for turn in range(passes):
        values, owners, of_leaf = [], [], []
        for side, (members, bits) in enumerate(sides):
            for k in range(0, len(members), step):
                some = members[k : k + step]
                near = (points[some][:, None] ^ bits[None, :]).ravel()
                mine = (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == turn
                values.append(near[mine])
                owners.append(np.repeat(some, len(bits))[mine])
                of_leaf.append(np.full(len(values[-1]), side == 0))
        value, owner, is_leaf = np.concatenate(values), np.concatenate(owners), np.concatenate(of_leaf)
        del values, owners, of_leaf
        order = np.argsort(value, kind="stable")  # leaf points first at every value
        value, owner, is_leaf = value[order], owner[order], is_leaf[order]
        first = np.concatenate(([True], value[1:] != value[:-1]))
        group = np.cumsum(first) - 1
        start = np.nonzero(first)[0]
        end = np.append(start[1:], len(value)) - 1
        both = is_leaf[start] & ~is_leaf[end]
        linked = both[group]
        other = np.where(is_leaf, owner[end][group], owner[start][group])[linked]
        yield owner[linked], other


def shard_links(points: np.ndarray, home: np.ndarray, reach: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a shard's home points and all its points."""
    points, where = np.unique(points, return_inverse=True)
    is_home = np.zeros(len(points), bool)
    is_home[where[home]] = True
    here = points[is_home]
    tree = grow(here, LEAF, reach)
    label = np.arange(len(points))
    found_a, found_b, held = [], [], 0

    def settle() -> None:
        nonlocal label, found_a, found_b, held
        if found_a:
            label = forest(len(points), np.concatenate([np.arange(len(points)), *found_a]), np.concatenate([label, *found_b]))
        found_a, found_b, held = [], [], 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        apart = label[i] != label[j]  # not linked yet
        found_a.append(i[apart])
        found_b.append(j[apart])
        held += int(apart.sum())
        if held > 2_000_000:
            settle()

    for _, (leaf,), at in visit(tree, points, reach):
        if len(leaf) > DENSE and reach in (1, 2):
            for i, j in meetings(points, at, np.searchsorted(points, leaf), reach):
                add(i, j)
            continue
        for h in range(0, len(leaf), BLOCK[0]):
            some = leaf[h : h + BLOCK[0]]
            for k in range(0, len(at), BLOCK[1]):
                part = at[k : k + BLOCK[1]]
                i, j = np.nonzero(_distance(some[:, None], points[part][None, :]) <= reach)
                add(np.searchsorted(points, some[i]), part[j])
    settle()
    moved = np.nonzero(label != np.arange(len(points)))[0]
    return points[moved], points[label[moved]]


def links(distinct: DataFrame, reach: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD, least: int = LEAST_SHARD) -> DataFrame:
    """Links (a, b) that connect all fingerprints of `distinct` within `reach` bits, without most of the redundant ones."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = min(max(sample, n // 64), MOST_SAMPLE)
    # By hash, not by a sorted limit, of which every task would send its own to the driver.
    chosen = distinct if n <= sample else distinct.where(F.xxhash64("fp") < -(2**63) + 2**64 * sample // n)
    points = np.sort(chosen.select("fp").toArrow().column("fp").to_numpy()).view(np.uint64)
    leaves = min(max(-(-n // shard), min(partitions_of(spark), -(-n // least)), 1), max(1, len(points) // 4))
    tree = grow(points, max(1, -(-len(points) // leaves)), reach)
    tree = _hollow(tree)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            home = np.empty(len(fps), np.int64)
            for leaf, _, at in visit(tree, fps, 0):  # without reach the two sides of a node are disjoint
                home[at] = leaf
            reached = [(leaf, at) for leaf, _, at in visit(tree, fps, reach)]
            if reached:
                shards, at = np.repeat([x for x, _ in reached], [len(a) for _, a in reached]), np.concatenate([a for _, a in reached])
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(fps[at].view(np.int64)), pa.array(home[at] == shards)], names=["shard", "fp", "home"])

    def match(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = shard_links(fps, table.column("home").to_numpy(), reach)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = map_arrow(distinct.select("fp"), route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(match, "a long, b long")


def _hollow(tree: tuple) -> tuple:
    """The tree without its leaves' points: what a task needs to route."""
    return (None,) if len(tree) == 1 else (tree[0], tree[1], _hollow(tree[2]), _hollow(tree[3]))


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of `edges` (a, b); equal labels are exactly connected.

    Each round maps a node to the member of its closed neighbourhood that comes first in a
    hashed order and contracts the edges; the hashed order makes long chains shrink by a
    constant factor a round. Only adjacent rows meet, and the minimum combines on the map side.
    """
    edges = written(edges.where("a != b"), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
        least = both.groupBy("node").agg(F.min(rank("other")).alias("least"))
        up = written(least.select("node", F.least(F.col("least"), rank("node"))["node"].alias("up")), "parents")
        step = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = written(step.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = written(labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD, least: int = LEAST_SHARD) -> DataFrame:
    """One row per input row: id, fp (long), component_id."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = components(links(distinct, reach, sample, shard, least))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = named.select("fp", "label").join(firsts, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op10_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that stay: of each component that with the smallest doc_id.

    Rows without doc_id stay, and so do rows that share the smallest doc_id; null, empty and wordless
    texts have fingerprint zero and are one component. Only rows that may go are shuffled. The stage follows op10's contract, 3-word shingles and links within 2 of 64 bits, which is far
    closer than a similarity of 0.8: most copies with a word edited stay (figures in the README).
    """
    drop = near_groups(docs).where("component_id != doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return without_listed(docs, "doc_id", written(drop, "near-dropped"))

"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has a bit set where over half of the XXH64 hashes of its
word shingles have it.  Documents of one fingerprint form a class; classes are
compared by their fingerprints alone.

Two fingerprints at a Hamming distance of at most ``DISTANCE`` differ by at
most ``DISTANCE // 2`` in one of their two 32-bit halves, and the distance of
halves is a metric of its own with a far smaller radius to search.  For each
half a vantage-point tree, built on a bounded sample of fingerprints, cuts all
of them into shards: at a node with vantage v and radius m a fingerprint goes
inside if its distance to v is at most m, else outside.  By the triangle
inequality whatever lies within r of it is inside only if its distance is at
most m + r and outside only if it is over m - r; it visits no other branch.
So every fingerprint has one home shard and visits the few later ones whose
region reaches within r of it.  A shard's homes and visitors meet in one task,
in a tree of its own, and are compared on all 64 bits.  Shards with many homes
or visitors are dealt over a grid of tasks in which each pair meets once.  A
task turns the pairs it finds into stars, at most one link a fingerprint.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import prepare, staged
from ratestat.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
SAMPLE = 1 << 16        # fingerprints that a tree is built on
SHARD = 1 << 13         # fingerprints of a shard that the tree aims at
LEAST_SAMPLE = 8        # sampled fingerprints below which a shard isn't cut
LEAF = 256              # fingerprints of a leaf of a task's own tree
HOMES, VISITORS = 1 << 18, 1 << 20  # most homes and visitors of one task
CELLS = 1 << 22         # comparisons made at once
PENDING = 1 << 20
CANDIDATES = 8          # vantage points tried a node
PIECE = 1 << 16
_U = np.uint64
HALVES = (_U(0xFFFFFFFF), _U(0xFFFFFFFF00000000))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text; 0 for one without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII spaces part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), PIECE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a:a + PIECE], ends[a:a + PIECE])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(shingle):
    def emit(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=_U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
    return emit


def _cut(points: np.ndarray, radius: int):
    """(vantage, m) of the cheapest cut of ``points``; None if none pays."""
    n, best = len(points), None
    for at in np.linspace(0, n - 1, min(CANDIDATES, n)).astype(int):
        below = np.cumsum(np.bincount(np.bitwise_count(points ^ points[at]), minlength=65 + radius))
        m = np.arange(65 - radius)
        inside, outside = below[m], n - below[m]
        visits_in, visits_out = below[m + radius], n - np.where(m >= radius, below[m - radius], 0)
        cost = np.where((inside > 0) & (outside > 0), inside * visits_in + outside * visits_out, n * n)
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (cost[k], points[at], k)
    return best[1:] if best[0] < 0.9 * n * n else None


def build_tree(points: np.ndarray, radius: int, size: int):
    """(tree, leaves): nodes (vantage, m, inside, outside), leaves by number."""
    numbers = itertools.count()

    def grow(mine):
        found = _cut(mine, radius) if len(mine) > size else None
        if found is None:
            return next(numbers)
        inside = np.bitwise_count(mine ^ found[0]) <= found[1]
        return (found[0], found[1], grow(mine[inside]), grow(mine[~inside]))
    tree = grow(points)
    return tree, next(numbers)


def visit(tree, points: np.ndarray, radius: int):
    """(leaf, positions of the points that visit it), pruned by the triangle
    bounds; with radius 0 each point visits its home alone."""
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            yield node, at
            continue
        distance = np.bitwise_count(points[at] ^ node[0]).astype(np.int64)
        stack.append((node[2], at[distance <= node[1] + radius]))
        stack.append((node[3], at[distance > node[1] - radius]))


def home_leaf(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    for leaf, at in visit(tree, points, 0):
        out[at] = leaf
    return out


def _routed(trees, radius):
    def emit(batches):
        for batch in batches:
            prints, reps = batch.column("print").to_numpy().view(_U), batch.column("rep").to_numpy()
            for half, tree in enumerate(trees):
                points = prints & HALVES[half]
                home = home_leaf(tree, points)
                parts = [(home, np.arange(len(points)), True)]
                for leaf, at in visit(tree, points, radius):
                    at = at[home[at] < leaf]  # the other of a pair of shards need not be visited
                    parts.append((np.full(len(at), leaf), at, False))
                for leaf, at, is_home in parts:
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(leaf * 2 + half), pa.array(prints[at].view(np.int64)), pa.array(reps[at]),
                             pa.array(np.full(len(at), is_home))], names=["shard", "print", "rep", "home"])
    return emit


class Classes:
    """Connected classes of numbered nodes, fed with pairs."""

    def __init__(self, n: int):
        self.root, self.pending, self.waiting = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        apart = self.root[a] != self.root[b]
        if apart.any():
            self.pending.append((a[apart], b[apart]))
            self.waiting += int(apart.sum())
            if self.waiting > PENDING:
                self.settle()

    def settle(self) -> np.ndarray:
        """The least node of each node's class."""
        if self.pending:
            a, b = (np.concatenate(c) for c in zip(*self.pending))
            while True:
                ra, rb = self.root[a], self.root[b]
                apart = ra != rb
                if not apart.any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
                while not np.array_equal(up := self.root[self.root], self.root):
                    self.root = up
        self.pending, self.waiting = [], 0
        return self.root


def link_classes(prints: np.ndarray, homes: np.ndarray, queries: np.ndarray, half: int, distance: int) -> np.ndarray:
    """The least position linked with each position of ``prints``, by all
    pairs of ``queries`` and ``homes`` (positions) within ``distance`` whose
    halves lie within the radius."""
    found, radius = Classes(len(prints)), distance // 2
    points = prints & HALVES[half]
    tree, leaves = build_tree(points[homes], radius, LEAF)
    own = home_leaf(tree, points[homes])
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(leaves + 1))
    for leaf, at in visit(tree, points[queries], radius):
        mine = homes[order[edges[leaf]:edges[leaf + 1]]]
        step = max(1, CELLS // max(len(mine), 1))
        for k in range(0, len(at), step):
            asked = queries[at[k:k + step]]
            i, j = np.nonzero(np.bitwise_count(prints[asked][:, None] ^ prints[mine][None, :]) <= distance)
            found.add(asked[i], mine[j])
    return found.settle()


def _linked(distance):
    def run(table: pa.Table) -> pa.Table:
        prints, reps = table.column("print").to_numpy().view(_U), table.column("rep").to_numpy()
        homes = np.flatnonzero(table.column("is_home").to_numpy())
        queries = np.flatnonzero(table.column("is_query").to_numpy())
        half = int(table.column("shard")[0].as_py()) % 2
        root = link_classes(prints, homes, queries, half, distance)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(reps[at], pa.int64()), "b": pa.array(reps[root[at]], pa.int64())})
    return run


def near_links(classes: DataFrame, distance: int = DISTANCE, shard: int = SHARD, sample: int = SAMPLE,
               homes: int = HOMES, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) of representatives whose connected components are those
    of all pairs of ``classes`` (rep, print) within ``distance``."""
    radius, n = distance // 2, classes.count()
    span = 1 << 30
    chosen = classes.where(F.pmod(F.xxhash64("print"), F.lit(span)) < int(min(1.0, sample / max(n, 1)) * span) + 1)
    points = np.sort(chosen.select("print").toArrow().column("print").to_numpy().view(_U))
    size = max(LEAST_SAMPLE if len(points) < n else 1, -(-shard * len(points) // max(n, 1)))
    trees = [build_tree(points & half, radius, size)[0] for half in HALVES]
    routed = staged(classes.mapInArrow(_routed(trees, radius), "shard long, print long, rep long, home boolean"), "routed")
    grid = routed.groupBy("shard").agg(
        F.ceil(F.count_if("home") / homes).alias("n_rows"), F.ceil(F.count(F.lit(1)) / visitors).alias("n_columns"))
    dealt = routed.join(staged(grid, "grid"), "shard")
    row, column = F.pmod(F.xxhash64("print", F.lit(1)), F.col("n_rows")), F.pmod(
        F.xxhash64("print", F.lit(2)), F.col("n_columns"))
    dealt = dealt.withColumn("row", row).withColumn("column", column)
    down = F.expr("transform(sequence(0L, n_rows - 1), i -> i * n_columns + column)")
    across = F.expr("transform(sequence(0L, n_columns - 1), j -> row * n_columns + j)")
    cells = F.when(F.col("home"), F.array_union(down, across)).otherwise(down)
    met = dealt.withColumn("cell", F.explode(cells)).select(
        "shard", "cell", "print", "rep",
        (F.col("home") & (F.floor(F.col("cell") / F.col("n_columns")) == F.col("row"))).alias("is_home"),
        (F.col("cell") % F.col("n_columns") == F.col("column")).alias("is_query"))
    return met.groupBy("shard", "cell").applyInArrow(_linked(distance), "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id",
                  text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Two documents are linked if their fingerprints differ in at most
    ``distance`` bits (at most 5, so that a half's radius is at most 2);
    ``component_id`` is the least id reachable, the row's own included.  Null,
    empty and wordless texts have the fingerprint zero and are linked like any
    other.  A row with a null id has its fingerprint and a null component, and
    links nothing; rows that repeat an id count with each of their texts.
    Other columns are not read.  An empty table gives no row.
    """
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = staged(base.mapInArrow(_fingerprints(shingle), "doc_id long, print long"), "fingerprints")
    classes = staged(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    links = near_links(classes.select("rep", "print"), distance, **limits)
    # rows that repeat an id tie the classes of its texts together
    tied = (prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi"))
            .where("lo < hi").select("doc_id").join(prints, "doc_id").select("doc_id", "print").distinct()
            .join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    joined = components(links.unionByName(tied))
    named = staged(classes.join(joined, F.col("rep") == F.col("node"), "left")
                   .select("print", F.coalesce("component", "rep").alias("component_id")), "named")
    out = prints.join(named, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op11_simhash_dedup(spark, sf_dir):
    """Per document: its fingerprint and component."""
    from ratestat.llm.common import documents
    return simhash_dedup(documents(spark, sf_dir, "doc_id", "text"))

"""MinHash near-duplicates with an LSH forest.

1. A document's set: its distinct five-word shingles (fewer words: the whole sequence as one). Sets get a 128-bit
   fingerprint; documents with equal sets are one node, so a group of exact copies costs one row from here on.
2. Forest: every node has a signature of HASHES minima. Tree t orders all nodes by the signature rotated to begin at
   hash DEPTH_MIN * t. The orders are range-partitioned sorts of one table, so no region of equal prefixes is a task
   of its own; runs go on across partitions by a join of their ends.
3. Candidates: in each order a node's next NEIGHBOURS nodes with a common prefix of at least DEPTH_MIN. In sparse
   regions that is everything with the shortest allowed prefix; where thousands share it, the sort puts those with
   the longest common prefix next to each other, so the depth follows the region.
4. Exact check on full sets, in two steps. The direct neighbours in FIRST_TREES orders are checked and joined to
   components; of all other candidates only those between different components are left to check. So a group of n
   near copies costs O(n) checks, and no candidate between different components goes unchecked.
5. What neighbours may miss: links between components that share a region of more than NEIGHBOURS + 1 nodes. There
   the nodes that can be similar to one of another component are found by the rare shingles of their sets, and those
   outside the largest component are compared with all of them, in blocks, in the candidates' place (see
   family_links()). That is quadratic in the nodes that can have such a link, not in the family.

A pair of similarity 0.75 shares DEPTH_MIN minima in a tree with probability 0.42, so TREES trees miss it with 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendlake.llm.components import components
from mendlake.llm.store import drop_table, materialise, small
from mendlake.llm.words import SPACED, U, mix, words

SHINGLE = 5
DEPTH_MIN = 3
TREES = 20
HASHES = DEPTH_MIN * TREES
#: Minima of a tree's key: the deepest prefix that is told apart.
DEPTH_MAX = 8
NEIGHBOURS = 3
FIRST_TREES = 4
#: Nodes of a block of family_links(), shingles of its sets (and one set more), and shingles that may be broadcast there.
CHUNK, CHUNK_SHINGLES, SHINGLES = 512, 1_000_000, 100_000
#: Linked if PERCENT[0] * intersection >= PERCENT[1] * union.
PERCENT = (100, 75)
_rng = np.random.Generator(np.random.PCG64(20240601))
MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
ADD = _rng.integers(0, 2**64 - 1, HASHES, dtype=np.uint64)
ROWS = 2048  # shingles hashed at once


def signature(h: np.ndarray) -> np.ndarray:
    """Big-endian 32-bit minima of the HASHES functions."""
    low = np.full(HASHES, 2**64 - 1, dtype=U)
    for i in range(0, len(h), ROWS):
        np.minimum(low, (h[i : i + ROWS, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return (low >> U(32)).astype(">u4")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in words(batch.column(1), SPACED):
            n, one, two, sig = [], [], [], []
            for h in w.sets(SHINGLE):
                n.append(len(h))
                one.append(int(mix(h, 11).sum(dtype=U)))
                two.append(int(mix(h, 12).sum(dtype=U)))
                sig.append(signature(h).tobytes() if len(h) else None)
            cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(np.array(one, U).view(np.int64)), pa.array(np.array(two, U).view(np.int64)), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "fp1", "fp2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in words(batch.column(1), SPACED):
            sets = [h.tobytes() for h in w.sets(SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["node", "hashes"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as arrays; print tells sets of one node apart."""
    for batch in batches:
        for a, b, w in words(batch.column(1), SPACED):
            sets = list(w.sets(SHINGLE))
            print_ = np.array([mix(h, 11).sum(dtype=U) for h in sets], U).view(np.int64)
            cut = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
            grams = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(print_), pa.ListArray.from_arrays(pa.array(cut), pa.array(grams))], ["node", "print", "grams"])


NEAR = "a long, b long, first int, pid int, pos int, tree int, key binary, node long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (tree, key, node) to candidate pairs, and the first and last rows of the partition (pid set)."""
    pid, seen = TaskContext.get().partitionId(), 0
    tree, key, node = np.zeros(0, np.int32), np.zeros((0, DEPTH_MAX), ">u4"), np.zeros(0, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw = b"".join(batch.column(1).to_pylist())
        t, k, v = batch.column(0).to_numpy(), np.frombuffer(raw, ">u4").reshape(n, DEPTH_MAX), batch.column(2).to_numpy()
        if seen < NEIGHBOURS:
            m = min(n, NEIGHBOURS - seen)
            yield _edge_rows(pid, np.arange(seen, seen + m), t[:m], k[:m], v[:m])
        old = len(node)
        tree, key, node = np.concatenate([tree, t]), np.concatenate([key, k]), np.concatenate([node, v])
        for j in range(1, NEIGHBOURS + 1):
            lo = max(0, old - j)
            x, y = np.arange(lo, len(node) - j), np.arange(lo + j, len(node))
            near = (tree[x] == tree[y]) & (node[x] != node[y]) & (key[x, :DEPTH_MIN] == key[y, :DEPTH_MIN]).all(axis=1)
            x, y = x[near], y[near]
            if len(x):
                yield _pair_rows(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), ((tree[x] < FIRST_TREES) & (j == 1)).astype(np.int32))
        seen += n
        tree, key, node = tree[-NEIGHBOURS:], key[-NEIGHBOURS:], node[-NEIGHBOURS:]
    if len(node):
        yield _edge_rows(pid, np.arange(-len(node), 0), tree, key, node)


def _pair_rows(a, b, first) -> pa.RecordBatch:
    n = len(a)
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(first), *none], ["a", "b", "first", "pid", "pos", "tree", "key", "node"])


def _edge_rows(pid, pos, tree, key, node) -> pa.RecordBatch:
    n = len(node)
    keys = pa.array([key[i, :DEPTH_MIN].tobytes() for i in range(n)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.array(pos.astype(np.int32)), pa.array(tree.astype(np.int32)), keys, pa.array(node)], ["a", "b", "first", "pid", "pos", "tree", "key", "node"])


def orders(nodes: DataFrame) -> DataFrame:
    """(tree, key, node): a row for each tree with the node's key in its order."""
    turned = F.concat("sig", F.substring("sig", 1, 4 * DEPTH_MAX))
    trees = nodes.select("node", turned.alias("turned"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return trees.select("tree", trees.turned.substr(F.col("tree") * (4 * DEPTH_MIN) + 1, F.lit(4 * DEPTH_MAX)).alias("key"), "node")


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, first) of neighbours in the forest of nodes (node, sig)."""
    ordered = orders(nodes).repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = materialise(ordered.mapInArrow(_neighbours, NEAR), "forest")
    pairs = found.filter("pid is null").select("a", "b", "first")
    # Where a partition ends, the order goes on in the next one.
    tail = found.filter("pos < 0").select(F.col("pid").alias("p"), F.col("pos").alias("i"), F.col("tree").alias("t"), F.col("key").alias("k"), F.col("node").alias("x"))
    head = found.filter("pos >= 0").select((F.col("pid") - 1).alias("p"), F.col("pos").alias("j"), F.col("tree").alias("t"), F.col("key").alias("k"), F.col("node").alias("y"))
    gap = F.col("j") - F.col("i")
    across = tail.join(head, ["p", "t", "k"]).filter((gap <= NEIGHBOURS) & (F.col("x") != F.col("y")))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), ((F.col("t") < FIRST_TREES) & (gap == 1)).cast("int").alias("first"))
    return pairs.unionByName(across).groupBy("a", "b").agg(F.max("first").alias("first"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, y = PERCENT
    for batch in batches:
        keep = []
        for p, q in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(p.as_py(), U), np.frombuffer(q.as_py(), U)
            if len(s) > len(t):
                s, t = t, s
            both = 0
            if len(s) and x * len(s) >= y * len(t):
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
            keep.append(len(s) > 0 and x * both >= y * (len(s) + len(t) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. docs: doc_id, text. Sets are made again from the texts of the
    documents that occur in pairs; the table of sets is the only large thing that is shuffled."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "verify-ids")
    sets = docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "node long, hashes binary")
    sets = materialise(sets, "verify-sets")
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b").select("a", "b", "left", "right")
    out = materialise(both.mapInArrow(_similar, "a long, b long"), "verified")
    drop_table(sets)
    drop_table(ids)
    return out


def _joined(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the components ca and cb of their ends."""
    one = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))


def _chain(one: DataFrame, two: DataFrame) -> DataFrame:
    """Components of components: node -> component of one, then of two."""
    then = two.select(F.col("node").alias("component"), F.col("component").alias("last"))
    kept = one.join(then, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    return kept.unionByName(two.join(one, "node", "left_anti"))


def families(nodes: DataFrame, cross: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, component, family, few) of the nodes of regions that neighbours don't cover.

    A region of more than NEIGHBOURS + 1 nodes has pairs that are no neighbours. Regions lie within families: components
    that candidate pairs (cross: a, b, ca, cb) connect, similar or not. few: outside the family's largest component; a
    pair of two components has such a node.
    """
    edges = materialise(cross.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "family-edges")
    parts = edges.select(F.col("a").alias("component")).union(edges.select("b")).distinct()
    joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("family"))
    family = materialise(parts.join(joined, "component", "left").select("component", F.coalesce("family", "component").alias("family")), "families")
    placed = nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    inside = materialise(placed.join(family, "component"), "family-nodes")
    sizes = inside.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n_all"))
    sizes = sizes.filter(F.col("n_all") > NEIGHBOURS + 1).select("family", F.col("top.component").alias("largest"))
    return materialise(inside.join(sizes, "family").select("node", "component", "family", (F.col("component") != F.col("largest")).alias("few")), "dense")


def _cross(left: pa.Table, right: pa.Table) -> pa.Table:
    """One link (a, b) of each node of left to each other component of right with a similar node."""
    x, y = PERCENT
    comp, node, size = (right.column(c).to_numpy() for c in ("component", "node", "size"))
    grams = right.column("grams").combine_chunks()
    owner, grams = np.repeat(np.arange(len(grams)), np.diff(grams.offsets.to_numpy())), grams.flatten().to_numpy()
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    out: list[tuple[int, int]] = []
    for me, mine, h in zip(left.column("node").to_pylist(), left.column("component").to_pylist(), left.column("grams"), strict=True):
        s = h.values.to_numpy()
        lo, hi = np.searchsorted(grams, s), np.searchsorted(grams, s, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(node))
        near = np.flatnonzero((x * both >= y * (len(s) + size - both)) & (comp != mine))
        out += [(min(me, int(v)), max(me, int(v))) for v in node[near[np.unique(comp[near], return_index=True)[1]]]]
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def promising(full: DataFrame) -> DataFrame:
    """(family, node) of the nodes that can be similar to a node of another component of their family.

    A shingle counts only if nodes of two components of the family have it, as no other is shared across components.
    Each set is ordered by how many nodes of the family have a shingle, the rarest first. Sets of n and m shingles that
    are similar share at least 3 (n + m) / 7, and at least so many of them stand at or after the first that they share:
    it is among the first seventh of the smaller set and the first quarter of the larger one. So a node stays if a
    shingle of its first quarter is in the first seventh of a node of another component, or the other way round. In a
    family of near misses rare shingles fill these beginnings, and no node stays.
    """
    x, y = PERCENT
    spread = lambda df: df.select("family", "node", "print", "component", "size", F.explode("grams").alias("gram"))
    key = ["family", "gram"]
    among_few = spread(full.filter("few")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    among_few = materialise(among_few, "few-shingles")
    others = spread(full.filter("not few")).join(small(among_few.select(*key), SHINGLES), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    shared = among_few.join(others, key, "left").filter("m is not null or lo <> hi")
    shared = materialise(shared.select(*key, (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "shared-shingles")
    own = spread(full).join(small(shared, SHINGLES), key).groupBy("family", "node", "print", "component", "size")
    own = own.agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("own")).filter(x * F.size("own") >= y * F.col("size"))
    places = own.select("family", "node", "component", "size", F.size("own").alias("n_own"), F.posexplode("own").alias("at", "one"))
    rest = F.col("n_own") - F.col("at")
    places = places.select("family", "node", "component", F.col("one.gram").alias("gram"), (x * rest >= y * F.col("size")).alias("quarter"), ((x + y) * rest >= 2 * y * F.col("size")).alias("seventh"))
    places = materialise(places.filter("quarter"), "prefixes")
    in_seventh = F.when(F.col("seventh"), F.col("component"))
    held = places.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(in_seventh).alias("lo7"), F.max(in_seventh).alias("hi7"))
    held = materialise(held.filter("lo <> hi and lo7 is not null"), "met-shingles")
    met = places.join(small(held, SHINGLES), key)
    other = lambda lo, hi: (F.col(lo) != F.col("component")) | (F.col(hi) != F.col("component"))
    return met.filter(other("lo7", "hi7") | (F.col("seventh") & other("lo", "hi"))).select("family", "node").distinct()


def family_links(inside: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different components of the families of inside, at least one of each two components that
    have one.

    Nodes that can't have any go first (see promising()). Of the others, every one outside the family's largest component
    is compared on full sets with all, in blocks, each a task's work; only links leave a block. A block's side is dealt
    by hash to about CHUNK nodes and cut where its sets have CHUNK_SHINGLES shingles, so it has one set more than that
    at most.
    """
    sets = docs.join(small(inside.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_arrays, "node long, print long, grams array<long>")
    full = materialise(sets.join(small(inside), "node").withColumn("size", F.size("grams")), "dense-sets")
    kept = materialise(promising(full), "promising")
    met = materialise(full.join(small(kept.select("node")), "node", "left_semi"), "met")
    x, y = _dealt(met.filter("few")), _dealt(met)
    rows = ["node", "component", "size", "grams"]
    left = met.filter("few").join(small(x.drop("family")), "node").withColumnRenamed("cell", "x")
    left = left.join(_cells(y, "y"), "family").select("x", "y", *[F.col(c).alias(c) for c in ("family", *rows)])  # names of its own: right reads the same table
    right = met.join(small(y.drop("family")), "node").withColumnRenamed("cell", "y")
    right = right.join(_cells(x, "x"), "family").select("family", "x", "y", *rows)
    keys = ["family", "x", "y"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cross, "a long, b long").distinct()


def _dealt(sets: DataFrame) -> DataFrame:
    """(family, node, cell): the side of a block to which each set (family, node, size) belongs."""
    n = sets.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n"))
    group = sets.select("family", "node", "size").join(n, "family").withColumn("group", F.pmod(F.xxhash64("node"), F.col("n")))
    before: Column = F.sum("size").over(Window.partitionBy("family", "group").orderBy("node")) - F.col("size")
    cell = F.struct("group", F.floor(before / CHUNK_SHINGLES).alias("piece"))
    return materialise(group.select("family", "node", cell.alias("cell")), "cells")


def _cells(dealt: DataFrame, name: str) -> DataFrame:
    return small(materialise(dealt.select("family", F.col("cell").alias(name)).distinct(), "cell-list"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Nulls: a null text is empty; empty texts have no shingles and are linked with nothing. A null id stands for
    nothing: such a row is in the component of its exact copies that have an id, else component_id is null and it is
    kept. Rows that repeat an id are one document, of all their
    texts if these differ. Extra columns of docs are not read. An empty table
    gives an empty one.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = materialise(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"), "signatures")
    print_ = ["n_shingles", "fp1", "fp2"]
    reps = materialise(table.filter("n_shingles > 0").groupBy(*print_).agg(F.min("doc_id").alias("rep")), "classes")
    nodes = table.filter("n_shingles > 0").join(small(reps.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    nodes = materialise(nodes.select(F.col("doc_id").alias("node"), "sig").distinct(), "nodes")
    pairs = materialise(candidates(nodes), "candidates")
    comp = materialise(components(verify(pairs.filter("first = 1"), docs)), "components")
    cross = materialise(_joined(pairs, comp).filter("ca <> cb"), "cross")
    dense = families(nodes, cross, comp)
    alone = cross.filter("first = 0").join(small(dense.select(F.col("node").alias("a"))), "a", "left_anti").select("a", "b")
    found = verify(materialise(alone, "todo"), docs).unionByName(family_links(dense, docs))
    links = materialise(_joined(found, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
    comp = materialise(_chain(comp, components(links)), "components")
    found = table.select("doc_id", *print_).join(reps, print_, "left")
    found = found.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

"""Conversation prefix tries as double arrays.

A conversation is its path: KEY bytes a turn, of a digest of role and text and the text's length. Equal paths are one
sequence with a count. The sequences, sorted by path, are cut into shards of contiguous prefixes (SHARD_TURNS turns or
one sequence). A shard's turns get dense ids, its trie is packed into BASE and CHECK arrays over them (the child of
state s by turn t is BASE[s] + t if CHECK there is s), and a walk of all sequences through the arrays sums up every
node. A prefix with a third of all conversations is thus cut over many shards, as any other.

A shard's figures of a node are whole unless another shard has the node, too. Only nodes on a shard's first or last
path can be shared, so these upper nodes are merged by their ids; what shards counted twice is taken off along the
paths, linear in their lengths. Memory is bounded by a shard, or by the KEY bytes a turn of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.llm.store import materialise, small

DIGEST, KEY, ID = 16, 20, 16  # bytes of a turn's digest, of a turn in a path, of a node's id
SHARD_TURNS = 1 << 17
TRIES = 256


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) for every conv_id of turns (conv_id, turn, role, text), by turn.

    A null turn comes first; turns with one number follow their digests. Null role and text are empty; rows without
    conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    key = F.concat(digest, F.lpad(F.hex(F.length(text)), 2 * (KEY - DIGEST), "0"))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", key.alias("key"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key"))).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join(F.col("t.key"), "")).alias("path"))


def id_of(path) -> F.Column:
    """The id of the node that a path ends in."""
    return F.unhex(F.substring(F.sha2(path, 256), 1, 2 * ID))


class DoubleArray:
    """A trie's BASE and CHECK; state 0 is the root. BASE may be negative; CHECK is -1 where there is no state."""

    def __init__(self, parent: np.ndarray, turn: np.ndarray, n_nodes: int):
        """parent and turn of the nodes 1, 2, ..., sorted by both; node 0 is the root."""
        first = np.searchsorted(parent, np.arange(n_nodes + 1))
        fan, base = np.diff(first), np.zeros(n_nodes, np.int64)
        self._used = np.zeros(n_nodes + int(turn.max(initial=0)) + 2, bool)
        self._used[0], self._low = True, 1
        for node in sorted(np.flatnonzero(fan > 1).tolist(), key=lambda x: -fan[x]):
            base[node] = self._fit(turn[first[node] : first[node + 1]])
        alone = np.flatnonzero(fan == 1)
        self._room(len(self._used) + len(alone))
        slots = np.flatnonzero(~self._used)[: len(alone)]
        self._used[slots] = True
        base[alone] = slots - turn[first[alone]]
        state = np.concatenate([[0], base[parent] + turn])
        self.base, self.check = np.zeros(len(self._used), np.int64), np.full(len(self._used), -1, np.int64)
        self.base[state], self.check[state[1:]] = base, state[parent]
        self.state = state  # of each node

    def _room(self, n: int) -> None:
        if n > len(self._used):
            self._used = np.concatenate([self._used, np.zeros(max(n, 2 * len(self._used)) - len(self._used), bool)])

    def _fit(self, turns: np.ndarray) -> int:
        """The first base found at which all the turns' places are free."""
        at, span = self._low, int(turns[-1] - turns[0])
        while True:
            self._room(at + TRIES + span + 1)
            free = np.flatnonzero(~self._used[at : at + TRIES]) + at
            if at == self._low and not len(free):
                self._low = at + TRIES
            fits = free
            for t in turns[1:]:
                if not len(fits):
                    break
                fits = fits[~self._used[fits + (t - turns[0])]]
            if len(fits):
                base = int(fits[0] - turns[0])
                self._used[base + turns] = True
                return base
            at += TRIES

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of states by turns; -1 where there is none."""
        to = self.base[states] + turns
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def _levels(turns: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, turn) of every node below the root, sorted by both: distinct beginnings, level by level."""
    sizes = np.diff(first)
    node, parents, codes, n, width = np.zeros(len(sizes), np.int64), [], [], 1, int(turns.max(initial=0)) + 1
    rows = np.flatnonzero(sizes)
    d = 0
    while len(rows):
        both, which = np.unique(node[rows] * width + turns[first[rows] + d], return_inverse=True)
        parents.append(both // width)
        codes.append(both % width)
        node[rows] = n + which
        n, d = n + len(both), d + 1
        rows = rows[sizes[rows] > d]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *codes])


NODE = "id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, sides int, shard long"


def shard_nodes(shard: int, paths: list[bytes], counts: list[int], lows: list[int]) -> pa.Table:
    """The nodes of a shard's sorted distinct paths, as if there were no other shard.

    sides: 1 if on the first path, 2 if on the last one, 3 if on both, else 0.
    """
    sizes = np.array([len(p) // KEY for p in paths])
    first = np.concatenate([[0], np.cumsum(sizes)])
    keys = pa.Array.from_buffers(pa.binary(KEY), int(first[-1]), [None, pa.py_buffer(b"".join(paths))])
    turns = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)  # dense ids
    parent, turn = _levels(turns, first)
    trie = DoubleArray(parent, turn, len(parent) + 1)
    n = len(trie.check)
    weight, low = np.array(counts), np.array(lows)
    n_convs, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    n_children, n_leaves, saved, size, sides = (np.zeros(n, np.int64) for _ in range(5))
    ids = {0: hashlib.sha256().digest()[:ID]}
    state, rows, levels, d = np.zeros(len(paths), np.int64), np.arange(len(paths)), [], 0
    while True:  # level by level, all sequences at once
        here = state[rows]
        np.add.at(n_convs, here, weight[rows])
        np.minimum.at(least, here, low[rows])
        levels.append(np.unique(here, return_index=True))
        levels[-1] = (levels[-1][0], rows[levels[-1][1]])
        for side, end in ((1, 0), (2, len(paths) - 1)):
            sides[here[rows == end]] |= side
        rows = rows[sizes[rows] > d]
        if not len(rows):
            break
        state[rows] = trie.step(state[rows], turns[first[rows] + d])
        d += 1
    if (state < 0).any():
        raise AssertionError("a sequence is not in its trie")
    owners: dict[int, list[tuple[int, int]]] = {}
    for depth, (states, of) in enumerate(levels):
        for s, r in zip(states.tolist(), of.tolist(), strict=True):
            owners.setdefault(r, []).append((depth, s))
    for r, own in owners.items():  # ids of the nodes that a sequence shows first, by one running digest
        digest, at = hashlib.sha256(), 0
        for depth, s in own:
            digest.update(paths[r][at * KEY : depth * KEY])
            at = depth
            ids[s] = digest.copy().digest()[:ID]
            size[s] = int.from_bytes(paths[r][depth * KEY - KEY + DIGEST : depth * KEY]) if depth else 0
    for depth in range(len(levels) - 1, -1, -1):
        states = levels[depth][0]
        n_leaves[states] += n_children[states] == 0
        saved[states] += (n_convs[states] - 1) * size[states]
        if depth:
            up = trie.check[states]
            np.add.at(n_children, up, 1)
            np.add.at(n_leaves, up, n_leaves[states])
            np.add.at(saved, up, saved[states])
    states = np.concatenate([s for s, _ in levels])
    depths = np.repeat(np.arange(len(levels)), [len(s) for s, _ in levels])
    up = np.where(depths > 0, trie.check[states], 0)
    top = pa.array(depths == 0)
    columns = {
        "id": pa.array([ids[s] for s in states.tolist()], pa.binary()), "parent": pa.array([ids[s] if d else None for s, d in zip(up.tolist(), depths.tolist(), strict=True)], pa.binary()),
        "depth": pa.array(depths), "conv_id": pa.array(least[states]), "parent_conv_id": pa.array(least[up], mask=top.to_numpy(zero_copy_only=False)),
    }
    columns |= {k: pa.array(v[states]) for k, v in {"n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "saved": saved, "size": size}.items()}
    return pa.table(columns | {"sides": pa.array(sides[states].astype(np.int32)), "shard": pa.array(np.full(len(states), shard))})


def _sharder(most: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(row[0]) // KEY
                if held[0] and n + size > most:
                    yield from shard_nodes(number, *held).to_batches()
                    number, held, n = number + 1, ([], [], []), 0
                for x, to in zip(row, held, strict=True):
                    to.append(x)
                n += size
        if held[0]:
            yield from shard_nodes(number, *held).to_batches()

    return shards


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end, low, ids): the ids of each end's run of a batch, comma-joined."""
    for batch in batches:
        ends, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cut = [0, *(i for i in range(1, len(ends)) if ends[i] != ends[i - 1]), len(ends)]
        runs = [(ends[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cut, cut[1:], strict=False) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.binary()), pa.array([r[1] for r in runs], pa.int64()), pa.array([r[2] for r in runs], pa.string())], ["end", "low", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each end's ids; its runs stand together, by low. One digest is open at a time."""
    of = lambda done: pa.RecordBatch.from_arrays([pa.array([e for e, _ in done], pa.binary()), pa.array([h.hexdigest() for _, h in done], pa.string())], ["end", "ends_sha256"])
    end = digest = None
    for batch in batches:
        done = []
        for e, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest is not None and e == end:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((end, digest))
                end, digest = e, hashlib.sha256()
            digest.update(ids.encode())
        yield of(done)
    if digest is not None:
        yield of([(end, digest)])


def end_digests(paths: DataFrame) -> DataFrame:
    """(end, ends_sha256) for every node that a conversation ends in.

    Ids are sorted over ranges, so that one end's may lie in many tasks; the digest itself reads their joined runs one
    after the other, in constant memory.
    """
    ids = paths.select(id_of(F.col("path")).alias("end"), "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    runs = ids.mapInArrow(_joined, "end binary, low long, ids string")
    return runs.repartition("end").sortWithinPartitions("end", "low").mapInArrow(_hashed, "end binary, ends_sha256 string")


def nodes(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (conv_id long, path binary; one row a conversation).

    conv_id: the smallest member; depth; parent_conv_id (root: null); n_convs; n_children; n_leaves of the subtree;
    saved_tokens: over the subtree, (n_convs - 1) times the code points of a node's last text; ends_sha256 of the ids of
    the conversations that end there, ascending and comma-joined; node, the id of the path. A conversation without turns
    is a member of the root. No conversations: no nodes.
    """
    paths = materialise(paths.select("conv_id", "path"), "paths")
    sequences = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    ranged = sequences.select("path", "n", "low").repartitionByRange("path").sortWithinPartitions("path")
    parts = materialise(ranged.mapInArrow(_sharder(SHARD_TURNS), NODE), "nodes")
    place = F.col("shard") * 2 + F.when(F.col("sides") == 2, 1).otherwise(0)
    edge = parts.filter("sides > 0")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = edge.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), *sums, F.first("size").alias("size"),
        F.count(F.lit(1)).alias("k"), F.sum((F.col("n_children") == 0).cast("long")).alias("m"), F.min(place).alias("at"),
    )
    merged = materialise(merged, "merged")
    shared = merged.filter("k > 1")
    # Over a node's subtree: each shared node counted its text k times less one too little, and m leaves too many.
    along = edge.withColumn("at_own", F.explode(F.expr("filter(array(if(sides & 1 > 0, shard * 2, null), if(sides & 2 > 0, shard * 2 + 1, null)), x -> x is not null)")))
    along = along.select("id", "at_own").join(shared.select("id", "depth", "size", "k", "m", "at"), "id")
    below = W.partitionBy("at_own").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    first = F.col("at") == F.col("at_own")  # a shared node counts on one path only
    along = along.withColumn("text", F.sum(F.when(first, (F.col("k") - 1) * F.col("size")).otherwise(0)).over(below)).withColumn("leaf", F.sum(F.when(first, F.col("m")).otherwise(0)).over(below))
    fix = along.groupBy("id").agg(F.sum("text").alias("text"), F.sum("leaf").alias("leaf"))
    twice = shared.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("k") - 1).alias("twice"))
    right = merged.join(fix, "id", "left").join(twice, "id", "left").select(
        "id", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", (F.col("n_children") - F.coalesce("twice", F.lit(0))).alias("n_children"),
        (F.col("n_leaves") - F.coalesce("leaf", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("text", F.lit(0))).alias("saved"),
    )
    every = parts.filter("sides = 0").select(right.columns).unionByName(right)
    known = small(shared.select(F.col("id").alias("parent"), F.col("conv_id").alias("known")))
    every = every.join(known, "parent", "left").join(end_digests(paths), F.col("id") == F.col("end"), "left")
    return every.select(
        F.col("id").alias("node"), "conv_id", "depth", F.coalesce("known", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )

"""Prefix tries against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from mendlake.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows: (conv_id, turn, role, text); the nodes of the rebuilt conversations, by definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % queries.OPENINGS
        family = c - (abs(c) % queries.FAMILY) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(family, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(made.items()):
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        parents = {q[:-1] for q in members if q}
        children = sum(q[:-1] == p for q in members if q)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children, sum(q not in parents for q in under), saved, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, path string")
    got = trie.nodes(queries.rebuilt(trie.turn_paths(df)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)


def made(seed, n):
    rng, rows = random.Random(seed), []
    for c in [*range(n), *rng.sample(range(200, 900), 25), -5, -100, -107, 10**12 + 3]:
        kind = rng.random()
        for turn in range(1 if kind < 0.2 else rng.randrange(1, 9)):
            said = "same" if kind < 0.5 else rng.choice(["a", "b", "é" * 7, None, ""])
            rows.append((c, turn, rng.choice(["user", None]) if kind > 0.9 else "user", said))
    rows += [(None, 1, "user", "nobody's"), (7, None, "system", "comes first"), (1300, 0, None, None), (1300, 1, "assistant", "")]
    rows += [(1400, t, "user", f"turn {t}") for t in range(300)] + [(1401, t, "user", f"turn {t}") for t in range(299)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1 << 17, 40, 3])
def test_against_brute_force(spark, monkeypatch, most):
    """The same nodes from one shard and from shards of a few turns, whose upper nodes are merged."""
    monkeypatch.setattr(trie, "SHARD_TURNS", most)
    rows = made(3, 130)
    assert found(spark, rows) == brute(rows)


def test_hot_group_and_repeats(spark, monkeypatch):
    """Thousands of copies, and conversations whose turns repeat."""
    monkeypatch.setattr(trie, "SHARD_TURNS", 50)
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 4000) for t in range(2)] + [(c, 0, "user", f"alone {c % 7}") for c in range(5000, 5060)]
    rows += [(5000, 0, "user", "alone 2"), (5000, 0, "user", "alone 2")]
    assert found(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    gone = [c for c in range(101, 199) if zlib.crc32(str(c).encode()) % queries.OPENINGS][:3]
    rows = [(c, 0, "user", "taken away") for c in gone]
    got = found(spark, rows)
    assert got == brute(rows) and [x[:6] for x in got] == [(gone[0], 0, None, 3, 0, 1)]


def test_ties_by_digest(spark):
    """Turns with one number stand in one order, whatever order they come in."""
    rows = [(600, 1, "user", x) for x in "abcdef"]
    paths = {bytes(trie.turn_paths(spark.createDataFrame(r, "conv_id long, turn long, role string, text string")).first()["path"]) for r in (rows, rows[::-1])}
    assert len(paths) == 1


def test_double_array():
    rng = np.random.default_rng(5)
    for n, turns in ((1, 1), (40, 3), (3000, 900), (5000, 5000)):
        up = np.array([rng.integers(0, max(1, i // 3)) if rng.random() < 0.7 else i // 2 for i in range(n)])
        pairs = np.unique(np.stack([up, rng.integers(0, turns, n)], 1), axis=0)
        parent, turn = np.minimum(pairs[:, 0], np.arange(len(pairs))), pairs[:, 1]
        order = np.lexsort([turn, parent])
        parent, turn = parent[order], turn[order]
        keep = np.concatenate([[True], (np.diff(parent) != 0) | (np.diff(turn) != 0)])
        parent, turn = parent[keep], turn[keep]
        parent = np.minimum(parent, np.arange(len(parent)))
        t = trie.DoubleArray(parent, turn, len(parent) + 1)
        assert len(set(t.state.tolist())) == len(t.state)
        assert (t.step(t.state[parent], turn) == t.state[1:]).all()
        have = set(zip(t.state[parent].tolist(), turn.tolist(), strict=True))
        for s, x in zip(rng.choice(t.state, 500).tolist(), rng.integers(0, turns + 5, 500).tolist(), strict=True):
            assert (s, x) in have or t.step(np.array([s]), np.array([x]))[0] == -1

"""Near duplicates against brute force; hard cases."""

import random
import re
import time

import pytest
from mendlake.llm import components, forest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def run(spark, rows, schema="doc_id long, text string"):
    return [tuple(r) for r in forest.near_duplicates(spark.createDataFrame(rows, schema)).collect()]


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for family in range(12):  # families of copies with more and more edits, some beyond the threshold
        base = [rng.choice(vocabulary) for _ in range(60)]
        for k in range(10 if family else 60):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(words)))
    rng.shuffle(rows)
    assert sorted(run(spark, rows)) == brute(rows)


def test_real_rows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(run(spark, rows)) == brute(rows)


def test_hard_cases(spark):
    rows = [(5, "A b\tC"), (3, "a B c"), (4, "a b c d"), (7, None), (8, ""), (9, " \n"), (None, "a b c"), (None, "other words here"), (6, "x " * 50_000), (2, "x " * 9), (11, "x y z"), (11, "x y z")]
    got = {(r[0], r[1], r[2]): r[3] for r in run(spark, rows)}
    assert got[(3, 1, 3)] and not got[(5, 1, 3)] and got[(4, 1, 4)]
    assert got[(7, 0, 7)] and got[(8, 0, 8)] and got[(9, 0, 9)]
    assert not got[(None, 1, 3)] and got[(None, 1, None)]
    assert not got[(6, 1, 2)] and got[(2, 1, 2)] and got[(11, 1, 11)]
    assert len(run(spark, rows)) == len(rows)


def test_one_id_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = run(spark, [(11, one), (11, two), (12, one + " c"), (13, two + " c"), (14, "other words that stand here alone")])
    assert {r[0]: r[2] for r in got} == {11: 11, 12: 11, 13: 11, 14: 14}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b c", 9, "x"), (2, "a b c", 8, "y")], "doc_id long, text string, component_id int, rep string")
    assert sorted(map(tuple, forest.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_large_mixed_family(spark):
    """Hundreds that share half of their text and aren't similar, a cluster, and links that neighbours can miss."""
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(5, 40)))) for i in range(150)]
    assert sorted(run(spark, rows)) == brute(rows)


def test_family_of_near_misses(spark):
    """20,000 texts that share 26 of 31 shingles with each other (similarity 0.72), and near copies of some of them."""
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(5))) for i in range(20_000)]
    rows += [(100_000 + i, rows[i][1] + " more") for i in range(0, 20_000, 100)]
    began = time.perf_counter()
    got = run(spark, rows)
    assert time.perf_counter() - began < 240
    assert {r[0]: r[2] for r in got} == {i: i % 100_000 for i, _ in rows}


@pytest.mark.parametrize("chain", [1, 2, 50])
def test_components(spark, chain):
    edges = [(i, i + 1) for i in range(chain)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, chain + 1)} | {1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_partition_ends(spark):
    """Orders that are cut into many partitions give the same candidates."""
    rows = [(i, f"a{i // 3} b c d e f g h i j k{i // 3} l m n o p") for i in range(90)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(run(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("shingles_a_side", [1, 300])
def test_blocks_by_shingles(spark, monkeypatch, shingles_a_side):
    """One family of texts of very different length, whose blocks are cut after every set or every few."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = []
    for n in range(160):
        words = base[: rng.choice((60, 75, 90, 300, 400))]
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((n, " ".join(words)))
    monkeypatch.setattr(forest, "CHUNK_SHINGLES", shingles_a_side)
    monkeypatch.setattr(forest, "CHUNK", 20)
    assert sorted(run(spark, rows)) == brute(rows)

"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from mendlake.llm import lexical
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, best=lexical.BEST):
    """docs: (id, text) rows, items: id to terms; (item, rank, doc, score) rows."""
    held = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, asked in items.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            weigh = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weigh(t) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            scored += [(-score, i is None, i, score)] * (score > 0)
        out += [(item, k + 1, x[2], x[3]) for k, x in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:best])]
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Énorme", "élan", "naïve", "THE", "the", "x2"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, "the w1 w2 copied") for i in range(90)]  # ties over the limit
    docs += [(None, "the w3 of none"), (None, "w3"), (3, "w5 w5"), (3, "w5 w5"), (n + 100, None), (n + 101, ""), (n + 102, "!?"), (n + 103, "w7 " * 30_000)]
    rng.shuffle(docs)
    return docs


@pytest.fixture
def narrow(monkeypatch):
    """Small blocks, passes and owners, so that there are many of each."""
    monkeypatch.setattr(lexical, "ITEMS", 3)
    monkeypatch.setattr(lexical, "PAIRS", 4)
    monkeypatch.setattr(lexical, "OWNERS_A_SCAN", 2)


def asked():
    items = [(1, "The w1 W2 w3!"), (2, "élan Énorme énorme"), (3, None), (4, "nothing here"), (5, "w5 w5 w5"), (5, "w6"), (None, "copied THE"), (6, "w1"), (7, " ".join(f"w{i}" for i in range(40)))]
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    return items, merged


def compare(spark, parts):
    docs, (items, merged) = made(400, 5), asked()
    df = spark.createDataFrame([(i, t, 0, i) for i, t in docs], "doc_id long, text string, rank int, item_id long").repartition(parts)
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, merged)


def test_against_brute_force(spark):
    compare(spark, 5)


def test_many_passes_owners_and_scans(spark, narrow):
    compare(spark, 3)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_WORDS", 500)
    compare(spark, 2)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a"), ("r", None)], "item_id string, text string")
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [("q", 1, 1, r) for r in [brute([(1, "a b")], {"q": ["a"]})[0][3]]]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs.filter("text is null"), items).count() == 0
    none = lexical.search(docs, items.filter(F.col("text").isNull()))
    assert none.count() == 0 and dict(none.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}

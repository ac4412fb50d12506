import math
import random
import re
import time

import numpy as np
import pyarrow as pa
from mendlake.llm import decontaminate as D
from mendlake.llm.words import ALNUM, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    """Best window of every item in every text, with the operator's weights."""
    import math

    grams = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            k = min(5, len(w))
            grams[i] = len(w), k, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    count = {}
    for _, _, g in grams.values():
        for x in g:
            count[x] = count.get(x, 0) + 1
    weight = lambda x: math.floor(1000 * math.log(1 + len(grams) / count[x]) + 0.5)
    out = []
    for d, t in docs:
        w = words(t)
        for i, (n, k, g) in grams.items():
            size = min(n, len(w))
            if size < 0.75 * n:
                continue
            best = max(((sum(weight(x) for x in g & {tuple(w[j : j + k]) for j in range(s, s + size - k + 1)}) / sum(map(weight, g)), -s) for s in range(len(w) - size + 1)), default=(0, 0))
            if best[0] >= 0.75:
                out.append((d, i, -best[1], round(best[0], 9)))
    return sorted(out)


def run(spark, docs, items):
    df = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(said(rng.randrange(16, 60)))) for i in range(30)] + [(90, "only four words here"), (91, ""), (92, None), (None, "no id at all for this one")]
    docs = []
    for d in range(120):
        text = said(rng.randrange(0, 120))
        if d % 3 == 0:
            leak = items[rng.randrange(30)][1].split()
            for _ in range(d % 2):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() + "," for x in leak]
        docs.append((d, " ".join(text)))
    docs += [(500, "so Only four; words HERE yes"), (501, None), (502, ""), (None, items[3][1]), (503, items[3][1]), (503, items[3][1])]
    got = run(spark, [d for d in docs if d[0] is not None], items)
    want = brute([d for d in docs if d[0] is not None], items)
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert [x[3] for x in got] == [x[3] for x in want]
    assert sum(1 for d, *_ in got if d == 503) == 2


def test_real_rows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert run(spark, docs, items) == brute(docs, items)


def test_radius_is_whole(spark):
    """Every pair within the radius is found, and none beyond it."""
    rng = random.Random(5)
    base = [tuple(rng.getrandbits(D.PART) for _ in D.PRINT) for _ in range(20)]
    schema = ", ".join(f"{c} int" for c in D.PRINT)
    items = spark.createDataFrame([(i, 20, *f) for i, f in enumerate(base)], f"item_id long, size int, {schema}")
    far = lambda f, g: sum((x ^ y).bit_count() for x, y in zip(f, g, strict=True))
    probes, want = [], set()
    for f in base:
        for flips in (0, 1, 16, 33, D.RADIUS - 1, D.RADIUS, D.RADIUS + 1, 70):
            bits = rng.sample(range(D.BITS), flips)
            g = tuple(x ^ sum(1 << (p % D.PART) for p in bits if p // D.PART == i) for i, x in enumerate(f))
            probes.append((20, *g))
            want |= {(*g, j) for j, h in enumerate(base) if far(g, h) <= D.RADIUS}
    got = D.hamming_join(spark.createDataFrame(probes, f"size int, {schema}"), items)
    assert {(*(r[c] for c in D.PRINT), r["item_id"]) for r in got.collect()} == want


def test_index_is_selective(spark):
    """Of unrelated fingerprints, few meet in a part and none is within the radius."""
    rng = random.Random(9)
    schema = ", ".join(f"{c} int" for c in D.PRINT)
    some = lambda n: [tuple(rng.getrandbits(D.PART) for _ in D.PRINT) for _ in range(n)]
    windows = spark.createDataFrame([(20, *f) for f in some(500)], f"size int, {schema}")
    items = spark.createDataFrame([(i, 20, *f) for i, f in enumerate(some(200))], f"item_id long, size int, {schema}")
    assert D.hamming_join(windows, items).count() < 0.01 * 500 * 200
    assert D.PARTS * sum(math.comb(D.PART, f) for f in range(D.FLIPS + 1)) / 2**D.PART < 0.06


def test_recall_near_the_threshold():
    """Share of single windows within the radius, by the share of the item that they hold: as the module says."""
    rng = np.random.default_rng(2)
    for share, least in ((0.75, 0.97), (0.8, 0.99), (0.9, 1.0)):
        near = []
        for _ in range(300):
            grams = rng.integers(0, 2**63, 40, dtype=np.uint64)
            signs = D.signs(grams).astype(np.int64)
            item, window = D.pack(np.stack([signs.sum(axis=0), signs[: round(share * 40)].sum(axis=0)]))
            near.append(sum((int(x) ^ int(y)).bit_count() for x, y in zip(item, window, strict=True)) <= D.RADIUS)
        assert np.mean(near) >= least, share


def test_long_text_is_linear():
    """A text of many items: twice the words take about twice the time."""
    rng = random.Random(3)
    items = [(i, [f"w{i}x{j}" for j in range(40)]) for i in range(50)]
    table = pa.table({"item_id": [i for i, t in items for _ in range(36)], "size": [40] * (50 * 36), "gram": np.concatenate([word_grams(" ".join(t)) for _, t in items]).view(np.int64), "weight": [700] * (50 * 36)})
    block = D.Block(table)
    seconds = []
    for n in (500, 2000):
        text = word_grams(" ".join(" ".join(items[rng.randrange(50)][1]) for _ in range(n)))
        began = time.perf_counter()
        assert sum(len(f) for _, f in D._of_text(block, 5, text, block.find(5, text))) >= n
        for i in range(50):
            assert D.best_window(text, 40, 5, *block.items[i, 40])[0] == 1.0
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0]


def word_grams(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM).grams(5)


def test_clean_keeps_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 5), (None, "clean", 6), (2, None, 7)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "b c d e f g")], "item_id long, text string")
    got = D.clean(docs, items)
    assert got.columns == docs.columns and sorted(r["item_id"] for r in got.collect()) == [6, 7]
    assert D.clean(docs, items.limit(0)).count() == 3 and D.clean(docs.limit(0), items).count() == 0


def test_copies_of_items_with_runs(spark):
    """An item that repeats a shingle has the fingerprint of its exact copy."""
    rng = random.Random(6)
    items = []
    for i in range(40):
        text = [f"w{i}x{j}" for j in range(29)]
        items.append((i, " ".join(text + ["0"] * 16) if i % 2 else " ".join(text[:27] + ["a b c d e f g"] * 5)))
    docs = [(i, " ".join([f"d{rng.randrange(900)}" for _ in range(30)] + [t] + [f"e{rng.randrange(900)}" for _ in range(30)])) for i, t in items]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and {x[:2] for x in got} >= {(i, i) for i in range(40)}


def test_templated_benchmark(spark):
    """Items of 20 shingles that all share and 12 of their own, whose template the texts word anew: share 0.82."""
    rng = random.Random(7)
    template = [f"t{j}" for j in range(24)]
    items = [(i, " ".join(template + [f"w{i}x{j}" for j in range(12)])) for i in range(200)]
    docs = [(i, " ".join([f"r{i}x{rng.randrange(900)}" for _ in range(20)] + t.split()[20:] + ["and", "so", "on"])) for i, t in items]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and len(got) == 200


def test_long_items(spark, monkeypatch):
    """Items beyond a block's size, and blocks cut by running sums, find what one block finds."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(said(rng.randrange(3, 50)))) for i in range(20)] + [(70 + i, " ".join(said(rng.randrange(120, 400)))) for i in range(4)]
    items += [(75, " ".join(["again and again"] * 90 + said(110)))] + [(80, " ".join(said(30))) for _ in range(40)]  # repeats; an id with many texts
    docs = [(900, None), (901, ""), (902, "again and again " * 300)]
    for d in range(60):
        leak = items[d % 25][1].split()
        for _ in range(d % 3 * len(leak) // 60):
            leak[rng.randrange(len(leak))] = "changed"
        docs.append((d, " ".join(said(rng.randrange(200)) + leak + said(rng.randrange(60)))))
    docs += [docs[10], docs[10], (950, items[21][1]), (951, " ".join(items[21][1].split()[: len(items[21][1].split()) * 4 // 5]))]
    want = run(spark, docs, items)
    assert {i for _, i, *_ in want} >= {70, 71, 72, 73, 75}
    monkeypatch.setattr(D, "BLOCK_GRAMS", 100)
    assert run(spark, docs, items) == want

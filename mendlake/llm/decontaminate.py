"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For every length that items have, each text has a window of so many words from each word on (a shorter text with at
least three quarters of the words is one window). Windows that can't reach the threshold by running sums over the
shingles of all items go, and so does a window next to one that holds all of its known shingles: it can't hold more of
any item. A window's fingerprint is the 252-bit SimHash of its weighted distinct five-word shingles, of which only those
that some item of that length has count. Fingerprints are kept as 14 parts of 18 bits: two that differ in at most RADIUS
bits differ in at most FLIPS of some part's bits, so probing each part with up to FLIPS bits flipped finds every pair
within the radius. A text that met an item so is verified exactly: over all windows of the item's length, the largest
share of the item's weighted shingles, and the first window that has it; leaked if the share is at least THRESHOLD.

In a fingerprint a shingle counts with the root of its weight: a window that holds a share s of an item's weight, and
no shingle of other items, is then at a cosine of root s, and its bits differ with a chance of acos(root s) / pi. At
RADIUS = 55 of 252 a single window is met with a chance of 0.99 at s = 0.75 and above 0.999 from 0.8 on (normal
approximation); the README has the recall that was measured. Two unrelated fingerprints meet in some part with a chance
of 14 * 988 / 2^18, or 5 %, and are within the radius with next to none.

Weights: log(1 + items / items with the shingle), in thousandths, from the whole benchmark. The benchmark is taken in
blocks of at most twice BLOCK_GRAMS shingles, which are broadcast; a larger benchmark means more passes over the texts.
An item of more than BLOCK_GRAMS shingles is never gathered: see long_leaks().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendlake.llm.store import materialise, small, unused
from mendlake.llm.words import ALNUM, U, mix, words

SHINGLE = 5
THRESHOLD = 0.75
PARTS, PART, FLIPS = 14, 18, 3
BITS = PARTS * PART
RADIUS = PARTS * (FLIPS + 1) - 1
PRINT = [f"part{i}" for i in range(PARTS)]
BLOCK_GRAMS = 500_000
SPAN = 4_096  # places of a text that are fingerprinted at once


def gram_size(n_words: int) -> int:
    return min(SHINGLE, n_words)


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in words(batch.column(1), ALNUM):
            ids, sizes, grams = [], [], []
            for i, item in zip(range(b - a), batch.column(0).slice(a, b - a).to_pylist(), strict=True):
                n = int(w.first[i + 1] - w.first[i])
                if n and item is not None:
                    k = gram_size(n)
                    g = np.unique(w.grams(k)[w.first[i] : w.first[i + 1] - k + 1])
                    ids += [item] * len(g)
                    sizes += [n] * len(g)
                    grams.append(g)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(grams).view(np.int64))], ["item_id", "size", "gram"])


class Block:
    """The items of a block, as arrays: shingles with weights, and the least weight that a window needs by length."""

    def __init__(self, rows: pa.Table):
        item, size, gram, weight = (rows.column(c).to_numpy() for c in ("item_id", "size", "gram", "weight"))
        order = np.lexsort((gram.view(U), size, item))
        item, size, gram, weight = item[order], size[order], gram[order].view(U), weight[order]
        kind = np.minimum(size, SHINGLE)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by shingle size: shingles and weights
        for k in np.unique(kind).tolist():
            known, first = np.unique(gram[kind == k], return_index=True)
            self.grams[k] = known, weight[kind == k][first]
        self.items: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # by item and length
        self.need: dict[int, int] = {}
        mine: dict[int, list[np.ndarray]] = {}
        cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (size[1:] != size[:-1])])) if len(item) else np.zeros(0, int)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(item)], strict=True):
            n = int(size[a])
            self.items[int(item[a]), n] = gram[a:b], weight[a:b]
            low = int(np.ceil(THRESHOLD * weight[a:b].sum()))
            self.need[n] = min(low, self.need.get(n, low))
            mine.setdefault(n, []).append(np.searchsorted(self.grams[gram_size(n)][0], gram[a:b]))
        #: Which shingles the items of a length have, as sorted places in grams.
        self.of_size = {n: np.unique(np.concatenate(v)) for n, v in mine.items()}

    def find(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Place of each gram; -1 where no item has it."""
        return place_in(self.grams[k][0], grams)


def place_in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each member of x in known (sorted, not empty); -1 for those that aren't there."""
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def signs(grams: np.ndarray) -> np.ndarray:
    """BITS signs of every gram."""
    raw = np.stack([mix(grams, 21 + i) for i in range(-(-BITS // 64))], axis=1)
    return np.unpackbits(raw.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=BITS).astype(np.int32) * 2 - 1


def root(weight: np.ndarray) -> np.ndarray:
    """What a shingle counts in a fingerprint; whole, so that sums are exact."""
    return np.rint(1000 * np.sqrt(weight)).astype(np.int64)


def pack(sums: np.ndarray) -> np.ndarray:
    """SimHashes, a number for each part, of rows of weighted sums of signs."""
    return ((sums > 0).reshape(-1, PARTS, PART) << np.arange(PART)).sum(axis=2).astype(np.int32)


def previous(grams: np.ndarray) -> np.ndarray:
    """Place of the same gram's last occurrence before each place; -1 without one."""
    order = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -1)
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _prints(grams: np.ndarray, weight: np.ndarray, before: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """SimHashes of the distinct grams among the m from each start on; before: their previous() places.

    A place counts in the windows that begin behind the gram's previous place, so that a repeated gram counts once, as
    in an item. Only grams inside a window are looked at.
    """
    mark = np.zeros(len(grams) + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + m, -1)
    at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (weight > 0))
    enter = np.maximum(before[at] + 1, at - m + 1)
    order = np.argsort(enter, kind="stable")
    signed = signs(grams[at]) * weight[at, None]
    left, entered = np.zeros((2, len(at) + 1, BITS), np.int64)
    np.cumsum(signed, axis=0, out=left[1:])
    np.cumsum(signed[order], axis=0, out=entered[1:])
    return pack(entered[np.searchsorted(enter[order], start, side="right")] - left[np.searchsorted(at, start)])


def _windows(shared) -> Callable:
    names = ["tkey", "size", *PRINT]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            for a, b, w in words(batch.column(1), ALNUM):
                keys = batch.column(0).slice(a, b - a)
                owners, sizes, prints = [], [], []
                for k in block.grams:
                    grams = w.grams(k)
                    if not len(grams):
                        continue
                    number = block.find(k, grams)
                    owner = np.searchsorted(w.first, np.flatnonzero(number >= 0), side="right") - 1
                    for i in np.unique(owner).tolist():
                        lo, hi = int(w.first[i]), int(w.first[i + 1]) - k + 1
                        if hi > lo:
                            for size, found in _of_text(block, k, grams[lo:hi], number[lo:hi]):
                                owners.append(np.full(len(found), i))
                                sizes.append(np.full(len(found), size, np.int32))
                                prints.append(found)
                if owners:
                    bits = np.concatenate(prints)
                    cols = [keys.take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(sizes)), *[pa.array(np.ascontiguousarray(c)) for c in bits.T]]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return find


def _of_text(block: Block, k: int, grams: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, fingerprints) of a text's windows that may hold an item of a length."""
    n = len(grams)
    at = np.flatnonzero(number >= 0)
    number, before = number[at], np.full(n, -1)
    before[at] = np.concatenate([at, [-1]])[previous(grams[at])]
    weight = block.grams[k][1][number]
    total = weight.sum()
    for size, need in block.need.items():
        if gram_size(size) != k or total < need:
            continue
        m = size - k + 1
        if n < m:  # the text is shorter than the item
            if n + k - 1 < THRESHOLD * size:
                continue
            m = n
        mine = place_in(block.of_size[size], number) >= 0
        hit = np.zeros(n + 1, np.int64)
        hit[at[mine]] = weight[mine]
        start = np.flatnonzero(_sums(hit[:n], m) >= need)
        # The window before holds all that this one does, or the next one does and more.
        held = ((start > 0) & (hit[start + m - 1] == 0)) | ((hit[start] == 0) & (hit[start + m] > 0))
        start = start[~held]
        for i in range(0, len(start), SPAN):
            part = start[i : i + SPAN]
            first, last = int(part[0]), int(part[-1]) + m
            yield size, _prints(grams[first:last], root(hit[first:last]), before[first:last] - first, part - first, m)


def _sums(x: np.ndarray, m: int) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(x)])
    return run[m:] - run[:-m]


def hamming_join(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (size, fingerprint, item_id) of equal size within RADIUS bits. windows: size and PRINT; items: item_id too."""
    every = F.posexplode(F.array(*PRINT)).alias("part", "bits")
    whole = lambda name: F.array(*PRINT).alias(name)
    left = windows.select("size", *PRINT).distinct().select("size", whole("window"), every)
    masks = items.sparkSession.range(1 << PART).filter(F.bit_count("id") <= FLIPS).select(F.col("id").cast("int").alias("mask"))
    probes = items.select("item_id", "size", whole("item"), every).join(F.broadcast(masks))  # a fixed table of 988 rows
    probes = probes.select("item_id", "size", "item", "part", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits"))
    far = F.aggregate(F.zip_with("window", "item", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near = left.join(probes, ["size", "part", "bits"]).filter(far <= RADIUS)
    return near.select("size", *[F.col("window")[i].alias(c) for i, c in enumerate(PRINT)], "item_id").distinct()


def best_window(here: np.ndarray, size: int, k: int, grams: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """(share, start): the largest share of an item's shingles (grams, sorted, with weights) that a window of its length
    holds in a text of shingles `here`, and the first place with it. One pass over the places that hold a shingle."""
    place = place_in(grams, here)
    at = np.flatnonzero(place >= 0)
    return _best(at, place[at], weight[place[at]], min(len(here), size - k + 1), int(weight.sum()))


def _best(at: np.ndarray, gram: np.ndarray, weight: np.ndarray, m: int, total: int) -> tuple[float, int]:
    """best_window() of the places (ascending) that hold a shingle of the item, windows being of m places."""
    before = np.concatenate([at, [-1]])[previous(gram)]
    enter = np.maximum(before + 1, at - m + 1)  # the first window in which this is the first of its kind
    starts = np.unique(np.maximum(0, at - m + 1))
    order = np.argsort(enter, kind="stable")
    come, gone = (np.concatenate([[0], np.cumsum(w)]) for w in (weight[order], weight))
    held = come[np.searchsorted(enter[order], starts, side="right")] - gone[np.searchsorted(at, starts)]
    best = int(held.argmax()) if len(held) else 0
    return (float(held[best] / total), int(starts[best])) if len(held) else (0.0, 0)


def _verifier(shared) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            for a, b, w in words(batch.column(1), ALNUM):
                out: list[list] = [[], [], [], []]
                grams: dict[int, np.ndarray] = {}
                for i, found in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    best: dict[int, tuple[float, int]] = {}
                    for x in found:
                        k = gram_size(x["size"])
                        if k not in grams:
                            grams[k] = w.grams(k)
                        share, start = best_window(grams[k][lo : hi - k + 1], x["size"], k, *block.items[x["item_id"], x["size"]])
                        if share >= THRESHOLD and (share, -start) > (lambda s, p: (s, -p))(*best.get(x["item_id"], (0.0, 0))):
                            best[x["item_id"]] = share, start
                    for item, (share, start) in sorted(best.items()):
                        for c, v in zip(out, (a + i, item, start, share), strict=True):
                            c.append(v)
                cols = [batch.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.int32(), pa.float64()), strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start", "similarity"])

    return verify


def _text_grams(kinds: list[int]) -> Callable:
    """(tkey, n_words, kind, gram, places): the distinct shingles of texts, for shingles of so many words each."""
    names = ["tkey", "n_words", "kind", "gram", "places"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words(batch.column(1), ALNUM):
                keys = batch.column(0).slice(a, b - a)
                for k in kinds:
                    every = w.grams(k)
                    for i in range(b - a):
                        lo, hi = int(w.first[i]), int(w.first[i + 1])
                        own = every[lo : hi - k + 1] if hi - lo >= k else every[:0]
                        order = np.argsort(own, kind="stable")
                        cut = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else np.zeros(0, int)
                        if len(cut):
                            places = pa.ListArray.from_arrays(pa.array([*cut.tolist(), len(own)], pa.int32()), pa.array(order.astype(np.int32)))
                            fixed = [keys.take(pa.array(np.full(len(cut), i))), *[pa.array(np.full(len(cut), x, np.int32)) for x in (hi - lo, k)]]
                            yield pa.RecordBatch.from_arrays([*fixed, pa.array(own[order][cut].view(np.int64)), places], names)

    return grams


def _best_of_hits(key: tuple, hits: pa.Table) -> pa.Table:
    """The best window of one text for one item of one length; no row below the threshold."""
    tkey, item, size = (x.as_py() for x in key)
    places = hits.column("places").combine_chunks()
    n = np.diff(places.offsets.to_numpy())
    at = places.flatten().to_numpy()
    gram, weight = (np.repeat(hits.column(c).to_numpy(), n) for c in ("gram", "weight"))
    order = np.argsort(at)
    k = gram_size(size)
    m = min(hits.column("n_words")[0].as_py() - k + 1, size - k + 1)
    share, start = _best(at[order].astype(np.int64), gram[order], weight[order], m, hits.column("total")[0].as_py())
    rows = [(tkey, item, start, share)] if share >= THRESHOLD else []
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["tkey", "item_id", "start", "similarity"])


def long_leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(tkey, item_id, start, similarity) of items that are too long for a block, without gathering one.

    texts: tkey and text; items: item_id, size, gram, weight. Shingles of texts that are long enough meet those of the
    items in a join by shingle. Texts that hold THRESHOLD of an item's weight anywhere are verified as all others are:
    over the places of one text that hold a shingle of the item. A length of an item at which no window can hold so
    much (an id with many short texts) goes first.
    """
    unit = ["item_id", "size"]
    kind = F.least("size", F.lit(SHINGLE))
    units = items.groupBy(*unit).agg(F.sum("weight").alias("total"), F.max("weight").alias("most"))
    units = materialise(units.filter((F.col("size") - kind + 1) * F.col("most") >= THRESHOLD * F.col("total")).drop("most"), "long-items")
    kinds = [r[0] for r in units.select(kind).distinct().collect()]  # at most SHINGLE numbers
    if not kinds:
        return texts.sparkSession.createDataFrame([], "tkey long, item_id long, start int, similarity double")
    least = units.agg(F.min("size")).first()[0] * THRESHOLD  # words; each but the last has a character behind it
    long = texts.filter(F.length("text") >= 2 * least - 1).dropDuplicates(["tkey"])
    own = long.mapInArrow(_text_grams(sorted(kinds)), "tkey long, n_words int, kind int, gram long, places array<int>")
    known = items.join(small(units), unit).withColumn("kind", kind)
    hits = materialise(own.join(known, ["kind", "gram"]).filter(F.col("n_words") >= THRESHOLD * F.col("size")), "long-hits")
    enough = hits.groupBy("tkey", *unit).agg(F.sum("weight").alias("held"), F.first("total").alias("all")).filter(F.col("held") >= THRESHOLD * F.col("all"))
    enough = materialise(enough.select("tkey", *unit), "long-near")
    hits = hits.join(small(enough), ["tkey", *unit], "left_semi").select("tkey", *unit, "n_words", "total", "gram", "weight", "places")
    best = hits.groupBy("tkey", *unit).applyInArrow(_best_of_hits, "tkey long, item_id long, start int, similarity double")
    best = best.groupBy("tkey", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("tkey", "item_id", (-F.col("best.start")).alias("start"), "best.similarity")


def _blocks(items: DataFrame, total: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Blocks of items of at most twice BLOCK_GRAMS shingles, each item whole, and the items that are longer than a block.

    Items are dealt to groups by hash, and each group (about BLOCK_GRAMS shingles) is cut by its running sum.
    """
    if total <= BLOCK_GRAMS:
        return ([items] if total else []), None
    counts = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("group").orderBy("item_id")) - F.col("n")
    counts = counts.withColumn("long", F.col("n") > BLOCK_GRAMS).withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(-(-total // BLOCK_GRAMS))))
    placed = counts.filter("not long").withColumn("piece", F.floor(before / BLOCK_GRAMS)).select("item_id", "group", "piece")
    placed = materialise(placed, "item-blocks")
    numbers = placed.select("group", "piece").distinct().collect()  # as many as there are passes
    dealt = materialise(items.join(small(placed), "item_id", "left"), "dealt-items")
    blocks = [dealt.filter((F.col("group") == g) & (F.col("piece") == p)) for g, p in numbers]
    return blocks, dealt.filter("group is null").drop("group", "piece")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, start, similarity): every leaked item of every row, with its best window (the first of equals).

    docs: key and text; benchmark: item_id and text. Null texts are empty; texts and items without words, and items
    with a null id, have no leaks. Repeated rows are reported each; rows of one item_id with several texts are one item
    of all of them. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    items = materialise(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_grams, "item_id long, size int, gram long").distinct(), "items")
    n, total = items.agg(F.countDistinct("item_id"), F.count(F.lit(1))).first()
    share = items.groupBy("gram").agg(F.countDistinct("item_id").alias("n"))
    weight = F.round(1000 * F.log(1 + F.lit(n) / F.col("n"))).cast("long")
    items = materialise(items.join(share.select("gram", weight.alias("weight")), "gram"), "item-weights")
    out = spark.createDataFrame([], f"doc_id {kind}, item_id long, start int, similarity double")
    blocks, long = _blocks(items, total)
    for rows_ in blocks:
        block = Block(rows_.toArrow())
        shared = spark.sparkContext.broadcast(block)
        windows = docs.select("tkey", "text").mapInArrow(_windows(shared), f"tkey long, size int, {', '.join(f'{c} int' for c in PRINT)}")
        windows = materialise(windows, "windows")
        rows = []
        for (item, size), (grams, weight_) in block.items.items():
            rows.append((item, size, *pack((signs(grams) * root(weight_)[:, None]).sum(axis=0, keepdims=True, dtype=np.int64))[0].tolist()))
        prints = spark.createDataFrame(rows, f"item_id long, size int, {', '.join(f'{c} int' for c in PRINT)}")
        near = materialise(hamming_join(windows, prints), "near")
        found = windows.join(small(near), ["size", *PRINT]).groupBy("tkey").agg(F.collect_set(F.struct("item_id", "size")).alias("found"))
        found = materialise(found, "found")
        text = docs.join(small(found.select("tkey")), "tkey", "left_semi").join(small(found, members=F.size("found")), "tkey").select("doc_id", "text", "found")
        out = out.unionByName(text.mapInArrow(_verifier(shared), f"doc_id {kind}, item_id long, start int, similarity double"))
    if long is not None:
        far = materialise(long_leaks(docs.select("tkey", "text"), long), "long-leaks")
        out = out.unionByName(docs.select("doc_id", "tkey").join(small(far), "tkey").drop("tkey"))
    return out.withColumnRenamed("doc_id", key)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (any columns, with text) in which no item leaked."""
    key = unused(docs, "_tkey")
    keyed = docs.select("text").withColumn(key, F.xxhash64("text"))
    bad = materialise(leaks(keyed, benchmark, key).select(key).distinct(), "leaked")
    return docs.withColumn(key, F.xxhash64("text")).join(small(bad), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

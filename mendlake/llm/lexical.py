"""Ranked lexical search by pipelined term partitioning.

The items' terms are dealt to owners by hash. One scan of the documents posts, for every block of some thousand
documents and every owner, which of the owner's terms a document holds and how often. An item's bundle of a block is a
sparse accumulator (documents and their scores so far); the bundles go from owner to owner, each time by a cogroup with
that owner's postings of the block, which adds integer contributions. The last owner hands on the best documents of a
block for each item, and a ranking over those ends the search.

Blocks bound every task's memory (BLOCK_DOCS documents or BLOCK_WORDS words, ITEMS items), so neither a word that all
documents hold nor a source with a third of the rows makes a large group: its postings lie in as many blocks as its
documents do. More than ITEMS items are searched in passes, more than PAIRS pairs of item and term by more owners.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.llm.store import fresh_path, materialise
from mendlake.llm.words import ALNUM, words

BEST = 50
#: Owners of a pass, at least; pairs of item and term of an owner; owners whose terms one scan looks for; items of a pass.
OWNERS, PAIRS, OWNERS_A_SCAN, ITEMS = 3, 200_000, 5, 1000
BLOCK_DOCS, BLOCK_WORDS = 4096, 1 << 22
HEAD = -1  # in place of an owner: the block's documents and their sizes


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in words(batch.column(1), ALNUM):
            for i in range(b - a):
                terms = np.unique(w.hash[w.first[i] : w.first[i + 1]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(terms), a + i))), pa.array(terms.view(np.int64))], ["item", "term"])


def _lists(values, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


class _Block:
    """Documents with terms, in the order of the scan, and what they hold of the vocabulary."""

    def __init__(self, number: int):
        self.number, self.docs, self.sizes, self.keys, self.counts, self.n_docs, self.n_words = number, [], [], [], [], 0, 0

    def add(self, docs: pa.Array, w, vocabulary: np.ndarray) -> None:
        sizes = np.diff(w.first)
        full = np.flatnonzero(sizes)
        slot = np.repeat(np.arange(self.n_docs, self.n_docs + len(full)), sizes[full])
        at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        hit = vocabulary[at] == w.hash
        keys, counts = np.unique(at[hit] * BLOCK_DOCS + slot[hit], return_counts=True)
        self.docs.append(docs.take(pa.array(full)))
        self.sizes.append(sizes[full])
        self.keys.append(keys)
        self.counts.append(counts)
        self.n_docs, self.n_words = self.n_docs + len(full), self.n_words + len(w.hash)

    def rows(self, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for the block's documents, then one for each owner that has postings, by term and document."""
        sizes, keys, counts = (np.concatenate(x) for x in (self.sizes, self.keys, self.counts))
        order = np.argsort(keys, kind="stable")
        term, slot, tf = keys[order] // BLOCK_DOCS, keys[order] % BLOCK_DOCS, counts[order]
        none = np.zeros(0, np.int64)
        docs = pa.concat_arrays(self.docs)
        yield self._row(HEAD, docs, sizes, none, none, none, none)
        for owner in np.unique(owners[term]):
            mine = owners[term] == owner
            terms, each = np.unique(term[mine], return_counts=True)
            yield self._row(owner, docs[:0], none, terms, each, slot[mine], tf[mine])

    def _row(self, owner: int, docs: pa.Array, sizes, *arrays) -> pa.RecordBatch:
        kinds = (np.int32, np.int32, np.int16, np.int32)
        lists = [_lists(docs, [len(docs)]), _lists(pa.array(sizes.astype(np.int32)), [len(sizes)])]
        lists += [_lists(pa.array(x.astype(k)), [len(x)]) for x, k in zip(arrays, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([self.number]), pa.array([int(owner)], pa.int32()), *lists], POSTED)


POSTED = ["block", "owner", "docs", "sizes", "terms", "counts", "slots", "tf"]


def _poster(shared, block_words: int) -> Callable:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, owners = shared.value
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):  # so that a block's places last
                part = batch.slice(first, 1024)
                for a, b, w in words(part.column(1), ALNUM):
                    if block.n_docs and (block.n_docs + b - a > BLOCK_DOCS or block.n_words + len(w.hash) > block_words):
                        yield from block.rows(owners)
                        block = _Block(block.number + 1)
                    block.add(part.column(0).slice(a, b - a), w, vocabulary)
        if block.n_docs:
            yield from block.rows(owners)

    return post


def postings(docs: DataFrame, vocabulary: np.ndarray, owners: np.ndarray) -> DataFrame:
    """Rows of POSTED in the shared folder. docs: (doc, text); vocabulary: sorted hashes, owners: the owner of each."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, owners))
    rest = T.StructType.fromDDL("sizes array<int>, terms array<int>, counts array<int>, slots array<smallint>, tf array<int>")
    schema = T.StructType([*T.StructType.fromDDL("block long, owner int"), T.StructField("docs", T.ArrayType(docs.schema["doc"].dataType)), *rest])
    path = fresh_path(spark, "postings")
    docs.mapInArrow(_poster(shared, BLOCK_WORDS), schema).write.option("compression", "zstd").partitionBy("owner").parquet(path)
    return spark.read.schema(T.StructType([*[f for f in schema if f.name != "owner"], schema["owner"]])).parquet(path)


def contributions(tf: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _stage(shared, n_items: int, totals: tuple[int, int], last: bool) -> Callable:
    """One owner's work on one block: the bundles on the left, the owner's postings on the right."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        weights, first, holders = shared.value  # of term t: its weight, and the items holders[first[t]:first[t + 1]]
        rows = {r["owner"]: i for i, r in enumerate(right.select(["owner"]).to_pylist())}
        one = lambda name, owner: right.column(name)[rows[owner]].values
        array = lambda name, owner: one(name, owner).to_numpy().astype(np.int64)
        n_docs, total = totals
        sizes = array("sizes", HEAD)
        m = 50 + 50 * sizes * n_docs // total
        scores = np.zeros((n_items, len(sizes)), np.int64)
        for item, slots, so_far in zip(left.column("item").to_pylist(), left.column("slots"), left.column("scores"), strict=True):
            scores[item, slots.values.to_numpy()] = so_far.values.to_numpy()
        for owner in rows.keys() - {HEAD}:
            slots, tf, at = array("slots", owner), array("tf", owner), 0
            for t, n in zip(array("terms", owner).tolist(), array("counts", owner).tolist(), strict=True):
                here = slots[at : at + n]
                scores[np.ix_(holders[first[t] : first[t + 1]], here)] += contributions(tf[at : at + n], m[here], int(weights[t]))
                at += n
        block = right.column("block")[0].as_py()
        return _best(scores, one("docs", HEAD)) if last else _bundles(block, scores)

    return add


def _bundles(block: int, scores: np.ndarray) -> pa.Table:
    row, slot = np.nonzero(scores)
    items, each = np.unique(row, return_counts=True)
    return pa.table({
        "block": pa.array(np.full(len(items), block)), "item": pa.array(items.astype(np.int32)),
        "slots": _lists(pa.array(slot.astype(np.int16)), each), "scores": _lists(pa.array(scores[row, slot]), each),
    })


def _best(scores: np.ndarray, docs: pa.Array) -> pa.Table:
    """The BEST documents of each item in this block, ties to the smaller document."""
    parts = []
    for item, row in enumerate(scores):
        at = np.flatnonzero(row)
        if len(at) > BEST:
            at = at[row[at] >= np.partition(row[at], -BEST)[-BEST]]
        t = pa.table({"item": pa.array(np.full(len(at), item, np.int32)), "doc": docs.take(pa.array(at)), "score": pa.array(row[at])})
        parts.append(t.take(pc.sort_indices(t, [("score", "descending"), ("doc", "ascending")], null_placement="at_end")[:BEST]) if len(at) > BEST else t)
    return pa.concat_tables(parts)


def _collected(df: DataFrame) -> pa.Table:
    """A table of bounded size on the driver: an owner's pairs or weights, some hundred thousand narrow rows."""
    return df.toArrow()


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the BEST documents of each item with a score above 0, equal scores by ascending doc.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Documents without a term (null or
    empty text) count nowhere and are never found. Each row of docs is a document of its own, also when an id repeats;
    null ids come after others. Rows of items that share an id are one item with the terms of all; a null id is an id.
    Items without terms, empty items or empty docs give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    pair = T.StructType([asked.schema["item"], T.StructField("term", T.LongType())])
    pairs = materialise(asked.mapInArrow(_item_terms, pair).distinct().withColumn("hash", F.xxhash64("item")), "pairs")
    passes = -(-pairs.select("item").distinct().count() // ITEMS)
    found = [_search(named, pairs.filter(F.pmod("hash", F.lit(passes)) == p).drop("hash")) for p in range(passes)]
    if not found:
        found = [pairs.select("item", F.lit(None).cast(named.schema["doc"].dataType).alias("doc"), F.lit(0).cast("long").alias("score")).limit(0)]
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)
    return best.select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")


def _search(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, doc, score) of one pass: the best of each block."""
    spark = docs.sparkSession
    n_owners = max(OWNERS, -(-pairs.count() // PAIRS))
    if n_owners > OWNERS_A_SCAN:  # several scans must see the same blocks
        docs = materialise(docs, "documents")
    names = sorted((r["item"] for r in pairs.select("item").distinct().collect()), key=lambda x: (x is None, x))  # about ITEMS
    place = {x: i for i, x in enumerate(names)}
    bundle = "block long, item int, slots array<smallint>, scores array<long>"
    best = T.StructType([T.StructField("item", T.IntegerType()), docs.schema["doc"], T.StructField("score", T.LongType())])
    bundles, totals = spark.createDataFrame([], bundle), None
    for low in range(0, n_owners, OWNERS_A_SCAN):
        group = range(low, min(n_owners, low + OWNERS_A_SCAN))
        own = _collected(pairs.filter(F.pmod("term", F.lit(n_owners)).between(group[0], group[-1])))
        term = own.column("term").to_numpy().view(np.uint64)
        asking = np.array([place[x] for x in own.column("item").to_pylist()], np.int64)
        vocabulary, which = np.unique(term, return_inverse=True)
        if not len(vocabulary):
            vocabulary = np.zeros(1, np.uint64)  # all documents are still counted
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(vocabulary) + 1))
        owners = np.mod(vocabulary.view(np.int64), n_owners)
        posted = postings(docs, vocabulary, owners)
        if totals is None:
            long = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
            head = posted.filter(F.col("owner") == HEAD).agg(F.sum(F.size("docs")).alias("n"), F.sum(long("sizes")).alias("words")).first()
            totals = (head["n"] or 0, head["words"] or 1)
        each = posted.filter(F.col("owner") != HEAD).select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        df = each.groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("df"))
        weigh = F.floor(1000 * F.log(F.lit(2.0 * totals[0] + 2) / (2 * F.col("df") + 1)))
        known = _collected(df.select("t", weigh.cast("long").alias("w")))
        weights = np.zeros(len(vocabulary), np.int64)
        weights[known.column("t").to_numpy()] = known.column("w").to_numpy()
        shared = spark.sparkContext.broadcast((weights, first, asking[order]))
        for owner in group:
            last = owner == n_owners - 1
            mine = posted.filter(F.col("owner").isin(HEAD, owner))
            stage = _stage(shared, len(names), totals, last)
            bundles = bundles.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(stage, best if last else bundle)
    items = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("place", T.IntegerType()), T.StructField("name", pairs.schema["item"].dataType)]))
    return bundles.join(F.broadcast(items), F.col("item") == F.col("place")).select(F.col("name").alias("item"), "doc", "score")

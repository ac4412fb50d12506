"""Approximate nearest neighbours by cross-polytope hashing.

A vector (padded to a power of two) goes through three rounds of random signs and a fast Hadamard transform, a pseudo
rotation; its hash is the signed axis nearest to it, one of 2 * 64 for vectors of 64. Each of TABLES tables has signs
of its own. A query probes the PROBES axes nearest to it in every table, in falling order of its coordinates, and all
vectors that lie there are reranked exactly: by inner product in double precision on the original vectors.

Only directions are hashed, so that no vector's length moves the others' axes; the reranking is by inner product. What
a query must probe for that is measured: SAMPLE queries are held against all vectors, and the least number of probes
that finds RECALL of their neighbours is taken, PROBES at least. Where that is most of the axes, all axes of one table
are probed, which is exact.

Spark deals buckets out: vectors by (table, axis, chunk), queries by (table, probed axis, chunk), with so many chunks
that a block has about BLOCK rows, however many vectors share an axis (a third of all may be equal). Blocks that meet
are scored by a cogrouped task; a candidate that an earlier table gives too is left out there, so that every candidate
is scored once. A block passes its best K of each query on; the rest is a top-K by query, cut down map-side.

On vectors without structure any method of this kind must look at much of the table (about half of all pairs are scored
there). With clusters, recall is higher.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.llm.store import materialise, small

TABLES, PROBES, ROUNDS = 4, 32, 3
BLOCK = 2048
SAMPLE, RECALL = 200, 0.95
MOST = 0.75  # share of the axes from which on all are probed
K = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two; scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.Generator(np.random.PCG64(977 + table)).integers(0, 2, (ROUNDS, x.shape[1])) * 2.0 - 1.0
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, probes: int) -> np.ndarray:
    """Signed axes (axis, or axis + d for its negative side) nearest to each row, the nearest first."""
    both = np.concatenate([x, -x], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, padded to a power of two."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large components stay finite
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 << (x.shape[1] - 1).bit_length()
    return np.concatenate([x, np.zeros((len(x), d - x.shape[1]))], axis=1)


def _hashed(tables: int, probes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = directions(_matrix(part.column(2)))
                axes = np.stack([nearest_axes(rotate(x, t), probes) for t in range(tables)], axis=1).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, axes.size + 1, tables * probes, dtype=np.int32)), pa.array(axes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], rows], ["row", "vec_id", "embedding", "axes"])

    return run


def _best(tables: int, probes: int, k: int) -> Callable:
    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries, right: vectors, that meet in table key[0]; the k best new vectors of every query."""
        table = key[0].as_py()
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            v, ids = _matrix(right.column("embedding")), right.column("vec_id").to_numpy()
            axes = _matrix(right.column("axes")).astype(np.int64)
            q, mine, me = _matrix(left.column("embedding")), left.column("vec_id").to_numpy(), left.column("row").to_numpy()
            probed = _matrix(left.column("axes")).astype(np.int64).reshape(len(q), tables, probes)
            for i in range(0, len(q), 256):
                part = slice(i, i + 256)
                near = q[part] @ v.T
                n = len(near)
                seen = np.zeros((n, len(v)), bool)
                for t in range(table):
                    at = np.zeros((n, axes[:, t].max() + 1 if len(axes) else 1), bool)
                    p = probed[part, t]
                    ok = p < at.shape[1]
                    at[np.nonzero(ok)[0], p[ok]] = True
                    seen |= at[:, axes[:, t]]
                near[seen | (me[part, None] == right.column("row").to_numpy())] = -np.inf
                kth = np.partition(near, max(0, len(v) - k), axis=1)[:, max(0, len(v) - k)]
                row, col = np.nonzero((near >= kth[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))[:, None]) & np.isfinite(near))
                exact = (q[part][row] * v[col]).sum(axis=1)  # the same sum for the same vectors, wherever they stand
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                for c, x in zip(out, (me[part][row[keep]], mine[part][row[keep]], ids[col[keep]], exact[keep]), strict=True):
                    c.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"row": pa.array(cols[0], pa.int64()), "query_id": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    return score


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, embedding (doubles) of the vectors that take part."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(good)


def search(vectors: DataFrame, every: int = 20, k: int = K, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`.

    Nearest by largest inner product, ties to the smaller id; a query's own row isn't its neighbour. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those without an id. Rows that repeat an id
    are vectors, and queries, of their own. An inner product needs vectors of one length, so those of each length that
    occurs are searched among themselves, one after the other. With fewer candidates, ranks end earlier; an empty table
    gives an empty result.
    """
    vectors = usable(vectors)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    for r in sizes:
        found = _search(vectors.filter(F.size("embedding") == r["d"]), r["d"], r["n"], every, k, tables, probes)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def _search(vectors: DataFrame, d: int, n: int, every: int, k: int, tables: int, probes: int) -> DataFrame:
    """search() among n vectors of length d."""
    axes = 2 << (d - 1).bit_length()
    schema = "row long, vec_id long, embedding array<double>, axes array<int>"
    placed = materialise(vectors.mapInArrow(_hashed(tables, 1), schema), "vectors")
    asking = placed.filter(F.col("vec_id") % every == 0).drop("axes")

    def found(queries: DataFrame, tables: int, probes: int) -> DataFrame:
        asked = materialise(queries.mapInArrow(_hashed(tables, probes), schema), "queries")
        return materialise(_top(_met(asked, placed, tables, probes, k), k), "nearest")

    probes = max(min(probes, axes), _enough(asking, placed, tables, k))
    if probes > MOST * axes:
        return found(asking, 1, axes).drop("row")
    out = found(asking, tables, probes)
    # Queries that met too few vectors look at all axes of a table, which hold every vector.
    enough = out.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, n - 1)).select("row")
    few = materialise(asking.join(small(enough), "row", "left_anti"), "few")
    if not few.isEmpty():
        out = out.join(small(few.select("row")), "row", "left_anti").unionByName(found(few, 1, axes))
    return out.drop("row")


def _enough(asking: DataFrame, placed: DataFrame, tables: int, k: int) -> int:
    """The least number of probes a table that finds RECALL of the true neighbours of SAMPLE queries."""
    asked = asking.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).collect()
    if not asked:
        return 1
    rows, q = np.array([r["row"] for r in asked]), np.array([r["embedding"] for r in asked])
    shared = placed.sparkSession.sparkContext.broadcast((rows, q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, q = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                mine = part.column(0).to_numpy()
                score = q @ _matrix(part.column(2)).T
                score[rows[:, None] == mine] = -np.inf
                col = np.argsort(-score, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(q)), col.shape[1])
                col = col.reshape(-1)
                ok = np.isfinite(score[row, col])
                row, col = row[ok], col[ok]
                at = pa.array(col)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), part.column(1).take(at), pa.array(score[row, col]), part.column(3).take(at)], ["query_id", "vec_id", "score", "axes"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = placed.mapInArrow(nearest, "query_id long, vec_id long, score double, axes array<int>").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "axes").collect()
    if not best:
        return 1
    row, theirs = np.array([r["query_id"] for r in best]), np.array([r["axes"] for r in best])
    x = directions(q)
    needed = np.full(len(row), 2 * x.shape[1])
    for t in range(tables):
        place = np.argsort(nearest_axes(rotate(x, t), 2 * x.shape[1]), axis=1)
        needed = np.minimum(needed, place[row, theirs[:, t]] + 1)
    return int(np.sort(needed)[int(np.ceil(RECALL * len(needed))) - 1])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")


def _met(asked: DataFrame, placed: DataFrame, tables: int, probes: int, k: int) -> DataFrame:
    """The best k of each query in every block that it meets."""
    by_axis = lambda df, p: df.select("*", F.posexplode("axes").alias("at", "axis")).withColumn("table", F.floor(F.col("at") / p).cast("int")).drop("at")
    rows, wants = by_axis(placed, 1).filter(F.col("table") < tables), by_axis(asked, probes)
    # Sizes of the buckets: at most tables * 2 * d rows.
    count = lambda df, name: df.groupBy("table", "axis").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    chunks = materialise(count(rows, "vs").join(count(wants, "qs"), ["table", "axis"]), "chunks")
    mine = lambda n: F.pmod(F.xxhash64("row", "table"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["table", "axis", "v", "q"]
    rows = rows.join(F.broadcast(chunks), ["table", "axis"]).select("table", "axis", mine("vs").alias("v"), each("qs").alias("q"), "row", "vec_id", "embedding", "axes")
    wants = wants.join(F.broadcast(chunks), ["table", "axis"]).select("table", "axis", each("vs").alias("v"), mine("qs").alias("q"), "row", "vec_id", "embedding", "axes")
    return wants.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_best(tables, probes, k), "row long, query_id long, vec_id long, score double")

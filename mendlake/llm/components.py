"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins and aggregations on node ids; nothing is collected. Rounds grow with the logarithm of the
longest chain. A hub with a third of all edges is a skewed key of a plain sort-merge join, which adaptive execution
splits; the minimum of a node's neighbours is summed map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlake.llm.store import drop_table, materialise

MAX_ROUNDS = 60
ROWS_A_TASK, LEAST_TASKS = 500_000, 8


def _done(e: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: every u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b) with another component than itself.

    component is the smallest node id reachable. Self loops, repeated edges and rows with nulls change nothing; an
    empty table gives an empty one.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = materialise(e, "edges")
    # Tasks follow the number of edges, not the session's shuffle partitions: rounds on few edges are mostly overhead.
    tasks = max(LEAST_TASKS, -(-e.count() // ROWS_A_TASK))
    for _ in range(MAX_ROUNDS):
        if _done(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: neighbours above u move to the least of u and all its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").coalesce(tasks), "edges")
        # small star: u and its lower neighbours move to the least of them; repeated edges go here
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        drop_table(e)
        drop_table(large)
        e = nxt
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")

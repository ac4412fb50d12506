"""Mixing sources to target weights by hierarchical budgets.

A tree domain > language > source carries target weights. The token budget of the root is dealt to the domains by
weight, a domain's to its languages, a language's to its sources; no node gets more than its subtree can supply
(tokens times epochs). What a node can't use goes to its siblings by their weights, and only what all siblings
together can't use goes back to the level above: each level is one water-filling among siblings whose limits are
subtree capacities, solved in closed form with window sums over the (few) nodes.

A leaf's documents are read in seeded epochs: epoch e orders them by a hash of seed, epoch and id. Whole epochs are
taken as long as the budget lasts, then the prefix of the next whose tokens reach it. The prefix is found in two
steps, so that a leaf with a third of all rows is never one task: token sums by hash bucket, whose running sums tell
the bucket in which the budget ends; only that bucket's rows are ordered. Buckets follow the leaf's number of
documents (about ROWS_A_BUCKET each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.llm.store import materialise, small

HEX = 12  # hex digits of the order hash: 48 bits
ROWS_A_BUCKET = 500
#: Weight of a node that the weights don't name.
OTHER_WEIGHT = 1.0


def tokens_of(text: Column) -> Column:
    """Words between spaces and control white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Deal each parent's budget to its children by weight, none above its cap; all of it if the caps allow.

    nodes: a row for each child with weight and cap and its parent's budget. With the children in order of
    cap / weight, the first k are full and the others get what is left by weight; k is the number of children whose
    ratio is below the share that would remain for them.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = W.partitionBy(*parent).orderBy("ratio", "node")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    df = nodes.withColumn("ratio", ratio)
    df = df.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_after", F.sum("weight").over(after))
    level = F.when(F.col("weight_after") > 0, (F.col(budget) - F.col("cap_before")) / F.col("weight_after")).otherwise(F.lit(0.0))
    df = df.withColumn("level", level)
    # The level of the first child that isn't full holds for all after it.
    df = df.withColumn("share", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "node", "level"))).over(W.partitionBy(*parent))["level"])
    full = F.col("share").isNull() | ((F.col("ratio") <= F.col("share")) & (F.col("weight") > 0))
    given = F.when(full & (F.col("weight") > 0), F.col("cap")).when(F.col("weight") > 0, F.greatest(F.lit(0.0), F.col("share") * F.col("weight"))).otherwise(F.lit(0.0))
    return df.withColumn(out, given).drop("ratio", "cap_before", "weight_after", "level", "share")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens, n_docs. Adds the token budget (long, rounded down) of every leaf."""

    def weight(kind: str, column: str) -> Column:
        named = weights.get(kind, {})
        return F.coalesce(*[F.when(F.col(column) == F.lit(k), F.lit(float(v))) for k, v in sorted(named.items())], F.lit(OTHER_WEIGHT))

    df = leaves.withColumn("leaf_cap", F.col("tokens").cast("double") * max_epochs)
    df = df.withColumn("root_budget", total)
    by_domain = df.groupBy("domain", "root_budget").agg(F.sum("leaf_cap").alias("cap"))
    domains = water_fill(by_domain.withColumn("node", F.col("domain")).withColumn("weight", weight("domain", "domain")), ["root_budget"], "root_budget", "domain_budget").select("domain", "domain_budget")
    by_lang = df.groupBy("domain", "lang").agg(F.sum("leaf_cap").alias("cap")).join(domains, "domain")
    langs = water_fill(by_lang.withColumn("node", F.col("lang")).withColumn("weight", weight("lang", "lang")), ["domain"], "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    by_source = df.join(langs, ["domain", "lang"]).withColumn("cap", F.col("leaf_cap")).withColumn("node", F.col("source")).withColumn("weight", weight("source", "source"))
    out = water_fill(by_source, ["domain", "lang"], "lang_budget", "budget_raw")
    return out.select("domain", "lang", "source", "tokens", "n_docs", F.floor(F.col("budget_raw") + 1e-6).cast("long").alias("budget"))


def choose(docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 0.5, max_epochs: int = 2, seed: int = 7, domain: Column | None = None, key: str = "doc_id") -> DataFrame:
    """The rows chosen: key, domain, lang, source, tokens, epoch (from 0), budget of the leaf.

    docs: key, text, lang, source. fraction: of all tokens, the budget of the root. A document is taken in an epoch
    if the tokens before it in the leaf's order are below what the budget has left for this epoch; so the last may
    pass the budget by less than its own length, and documents without tokens come with the prefix in which they lie.

    Nulls: a null lang, source or domain is the node '' (empty); a null text has no tokens; null keys sort as empty.
    Repeated rows and ties of the hash are ordered by key, and count as rows of their own. Empty tables give no rows.
    Rows of one key and length are dealt as one with a count, so that a key with a third of the rows is no large bucket.
    """
    node = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), node(domain if domain is not None else F.lit("all")).alias("domain"), node(F.col("lang")).alias("lang"), node(F.col("source")).alias("source"), tokens_of(F.col("text")).alias("tokens"))
    keys = ["domain", "lang", "source"]
    rows = rows.groupBy("_key", *keys, "tokens").agg(F.count(F.lit(1)).alias("_copies"))
    rows = materialise(rows, "mix-rows")  # words are counted once; the table has no texts
    held = F.col("tokens") * F.col("_copies")
    leaves = rows.groupBy(*keys).agg(F.sum(held).alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = (rows.agg(F.sum(held)).first()[0] or 0) * fraction
    budgets = leaf_budgets(leaves, weights, F.lit(float(total)), max_epochs)
    want = F.greatest(F.lit(0), F.least("tokens", F.col("budget") - F.col("epoch") * F.col("tokens")))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_A_BUCKET))
    epochs = budgets.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    epochs = epochs.select(*keys, "epoch", "budget", want.alias("want"), F.col("tokens").alias("leaf_tokens"), n_buckets.alias("n_buckets")).filter("want > 0")
    dealt = rows.join(small(materialise(epochs, "mix-budgets")), keys).withColumn("_h", order_hash(seed, F.col("epoch"), F.col("_key")))
    dealt = dealt.withColumn("_bucket", F.floor(F.col("_h") / F.lit(float(16**HEX)) * F.col("n_buckets")).cast("long"))
    sums = dealt.filter("want < leaf_tokens").groupBy(*keys, "epoch", "_bucket").agg(F.sum(held).alias("_in"))
    running = W.partitionBy(*keys, "epoch").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(running), F.lit(0)))
    whole = dealt.filter("want = leaf_tokens")
    part = dealt.filter("want < leaf_tokens").join(sums, [*keys, "epoch", "_bucket"]).filter("_before < want")
    before, part = part.filter("_before + _in < want"), part.filter("_before + _in >= want")
    inner = W.partitionBy(*keys, "epoch", "_bucket").orderBy("_h", "_key", "tokens").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("_row", F.coalesce(F.sum(held).over(inner), F.lit(0))).filter("_before + _row < want")
    fit = F.ceil((F.col("want") - F.col("_before") - F.col("_row")) / F.col("tokens"))  # copies that begin below the budget
    part = part.withColumn("_copies", F.when(F.col("tokens") > 0, F.least("_copies", fit)).otherwise(F.col("_copies")).cast("long"))
    cols = [F.col("_key").alias(key), *keys, "tokens", "epoch", "budget"]
    chosen = [x.select(*cols, "_copies") for x in (whole, before, part)]
    chosen = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    return chosen.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")

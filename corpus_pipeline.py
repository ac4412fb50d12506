"""Documents to a sharded training mixture: five operators of mendlake.llm in a row.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of documents (the last adds its
placement). Stages may run several jobs over docs, so docs should be a table: run() writes each stage's rows to the
shared folder and reads them again. A stage reads only doc_id, text, lang and source; other columns pass through.
Documents that have no doc_id, or share it with another text, are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mendlake.llm import decontaminate, forest, mixing, sharding, toxicity
from mendlake.llm.queries import MIX, MIX_EPOCHS, MIX_FRACTION, MIX_SEED, SHARDS, domain_of
from mendlake.llm.store import materialise, small, unused
from mendlake.operators.ordering import positions
from mendlake.tables import table


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _named(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each document: its doc_id, if that has one text only; else, and without an id, a number
    below all ids and zero, by the order of the digests of id and text. So rows are one document if both are equal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    prints = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("lo"), F.max(F.xxhash64(text)).alias("hi"))
    several = materialise(prints.filter("lo <> hi").select(F.col("doc_id").cast("long").alias(name)), "several-texts")
    flag, digest = unused(docs, "_several"), unused(docs, "_digest")
    out = docs.withColumn(name, F.col("doc_id").cast("long"))
    if several.isEmpty() and docs.filter("doc_id is null").isEmpty():
        return out
    out = out.join(small(several.withColumn(flag, F.lit(True))), name, "left")
    unclear = F.coalesce(F.col(flag), F.lit(False)) | F.col(name).isNull()
    made = out.filter(unclear).withColumn(digest, F.sha2(F.concat(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("\n"), text), 256))
    least = docs.agg(F.least(F.min(F.col("doc_id").cast("long")), F.lit(0))).first()[0]
    place = unused(docs, "_place")
    numbers = materialise(positions(made.select(digest).distinct(), digest, name=place), "numbers")
    made = made.drop(name).join(small(numbers), digest).withColumn(name, F.lit(least) - 1 - F.col(place))
    columns = [name, *docs.columns]
    return out.filter(~unclear).select(*[f"`{c}`" for c in columns]).unionByName(made.select(*[f"`{c}`" for c in columns]))


def _variants(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, _row (a struct of columns), _json and _n: the different rows of each document and how often each occurs."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.select(key, row.alias("_row"), F.to_json(row).alias("_json")).groupBy(key, "_json").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if set(toxicity.OUT) & {c.lower() for c in docs.columns}:  # the scores would take the place of columns of docs
        packed = docs.select(F.struct(*_columns(docs)).alias("_doc"), F.col("text").alias("_text"))
        return toxicity.score(packed, model, "_text").filter("not toxic").select("_doc.*")
    return toxicity.score(docs, model).filter("not toxic").select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest number (see _named()). Of rows that have
    its id and text, the one that comes first as JSON stays."""
    i = unused(docs, "_id")
    named = _named(docs, i)
    found = forest.near_duplicates(named.select(F.col(i).alias("doc_id"), "text"))
    kept = materialise(found.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    of = lambda which: small(kept.filter(which).select(F.col("doc_id").alias(i)))
    out = named.join(of("n = 1"), i, "left_semi").select(*_columns(docs))
    if not kept.filter("n > 1").isEmpty():
        rows = _variants(named.join(of("n > 1"), i, "left_semi"), i, docs.columns)
        out = out.unionByName(rows.groupBy(i).agg(F.min_by("_row", "_json").alias("_row")).select("_row.*"))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: a row for every epoch.

    Rows with one id and text are copies of one document; what the mixture takes of it is dealt out among them, in the
    order of the rows as JSON: each gets the whole part, and the first ones one more."""
    i, n, e = (unused(docs, x) for x in ("_id", "_times", "_epoch"))
    named = _named(docs, i)
    chosen = mixing.choose(named.select(F.col(i).alias("doc_id"), "text", "lang", "source"), MIX, MIX_FRACTION, MIX_EPOCHS, MIX_SEED, domain_of("source"))
    times = chosen.groupBy(F.col("doc_id").alias(i)).agg(F.count(F.lit(1)).alias(n))
    copies = named.groupBy(i).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    times = materialise(times.join(copies, i, "left"), "times")
    every = lambda df, count: df.withColumn(e, F.explode(F.sequence(F.lit(1), count.cast("int"))))
    out = every(named.join(small(times.filter("copies is null").select(i, n)), i), F.col(n)).select(*_columns(docs))
    several = times.filter("copies is not null")
    if not several.isEmpty():
        rows = _variants(named.join(small(several.select(i)), i, "left_semi"), i, docs.columns).join(several, i)
        before = F.sum("_n").over(W.partitionBy(i).orderBy("_json")) - F.col("_n")
        more = F.greatest(F.lit(0), F.least(F.col("_n"), F.col(n) % F.col("copies") - before))
        taken = rows.withColumn("_take", F.col("_n") * F.floor(F.col(n) / F.col("copies")) + more).filter("_take > 0")
        out = out.unionByName(every(taken, F.col("_take")).select("_row.*"))
    return out


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the shard that holds it."""
    return sharding.place(docs, "doc_id", SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The ordinal model of the first stage is fitted by iteration, which SQL can't express; tests hold the stages against
#: brute force.
ORACLE_SQL = None

"""The pipeline's stages against brute force on their own inputs."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm import test_decontaminate, test_forest


def test_stages(spark, sf):
    from mendlake.llm.store import materialise

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf), name))
    assert all(df.columns == columns for df in kept[:-1]) and kept[-1].columns[: len(columns)] == columns
    rows = [[(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] for df in kept]
    assert 0.8 * len(rows[0]) <= len(rows[1]) < len(rows[0])
    assert sorted(i for i, _ in rows[2]) == [r[0] for r in test_forest.brute(rows[1]) if r[3]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {x[0] for x in test_decontaminate.brute(rows[2], items)}
    assert leaked and sorted(i for i, _ in rows[3]) == sorted(i for i, _ in rows[2] if i not in leaked)
    tokens = [sum(len((t or "").split()) for _, t in r) for r in rows]
    assert 0.4 <= tokens[4] / tokens[3] <= 0.95 and {i for i, _ in rows[4]} <= {i for i, _ in rows[3]}
    assert sorted(rows[5]) == sorted(rows[4]) and kept[5].filter("shard is null").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect())) == sorted(map(tuple, kept[5].select("doc_id", "shard").collect()))


def test_hard_rows(spark, sf):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "src1", "x"), (1, text, "en", "src1", "x"), (None, "only this", None, None, "y"), (2, None, "en", "src2", "z"), (3, text + " eleven", "en", "src1", "w"), (4, "", "de", "src3", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic string")
    for name in ("_id", "_n", "n", "_tkey", "tkey", "kept", "epoch", "_text", "found"):  # names that the stages use
        docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        full, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert full.columns[: len(docs.columns)] == docs.columns and none.count() == 0, name
        assert full.filter("_id = 'mine' and _tkey = 'mine' and n = 'mine'").count() == full.count(), name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "4", "None"]
    assert corpus_pipeline.drop_toxic(spark, docs, sf).filter(F.col("toxic") == "x").count() == 2


def test_numbers_of_documents_without_ids(spark):
    rows = [(7, "a"), (7, "a"), (-5, "b"), (8, "c"), (8, "d"), (None, "c"), (None, "e"), (None, "e"), (None, None), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_digest", F.lit("mine"))
    got = [tuple(r) for r in corpus_pipeline._named(docs, "i").select("i", "doc_id", "text", "_digest").collect()]
    assert sorted(map(str, (r[1:] for r in got))) == sorted(str((*r, "mine")) for r in rows)
    own = {r[1]: r[0] for r in got if r[1] in (7, -5, 9)}
    assert own == {7: 7, -5: -5, 9: 9}
    made = {(i, t or ""): n for n, i, t, _ in got if i is None or i == 8}
    assert sorted(made.values()) == [-10, -9, -8, -7, -6] and len({n for n, *_ in got}) == 8  # below the smallest id
    assert corpus_pipeline._named(docs.filter("doc_id = 7"), "i").filter("i = 7").count() == 2
    assert corpus_pipeline._named(docs.limit(0), "i").count() == 0

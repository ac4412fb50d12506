"""Readers of the files that repair pipelines keep: TSV, JSON lines (torn or strict), JSON arrays, id lists, splits."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.operators.joins import first_wins
from mendlake.operators.ordering import half_splits
from mendlake.schemas import BUGGY_REQUIRED
from mendlake.sources.arrow_files import read_arrow
from mendlake.tables import written_once


def tsv(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated files with a header and quoted, multi-line fields; all text without a schema. Empty fields are
    null: fill them with na.fill('')."""
    reader = spark.read.options(sep="\t", header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return (reader.schema(schema) if schema else reader).csv(paths)


def tsv_with_keys(spark: SparkSession, paths: str | list[str], keys: tuple[str, ...] = ("task_id", "question_id")) -> DataFrame:
    """TSV whose keys stay text (with their leading zeros) and whose other columns get the types that they look like."""
    raw = tsv(spark, paths)
    inferred = spark.read.options(sep="\t", header=True, multiLine=True, quote='"', escape='"', inferSchema=True).csv(paths).schema
    return raw.select(*[F.col(f.name) if f.name in keys else F.col(f.name).cast(f.dataType) for f in inferred])


def files_or_folder(spark: SparkSession, path: str, pattern: str) -> str:
    """path itself if it is a file, else the files two levels below it with names of a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return path if status.isFile() else f"{path.rstrip('/')}/*/{pattern}"


def with_source(df: DataFrame, name: str = "source_tsv") -> DataFrame:
    """df with the path of the file that each row is from."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def tsv_halves(spark: SparkSession, paths: str | list[str], mode: str = "all", seed: int = 1012, name: Column | None = None) -> DataFrame:
    """The rows of several TSV files, all text and without nulls, with source_tsv, the row's place in its file (pos), its
    half by its own file's permutation (split) and its place in that (rank).

    mode: dev, test or all. name: what a file is called for its permutation, its last part without. A file with fields
    of several lines is read by one task, in its order, so places are counted there; only files and their sizes are
    joined.
    """
    if mode not in ("dev", "test", "all"):
        raise ValueError(f"mode {mode}")
    rows = with_source(tsv(spark, paths)).na.fill("").withColumn("_id", F.monotonically_increasing_id())
    sizes = rows.groupBy("source_tsv").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n"))
    called = name if name is not None else F.regexp_extract("source_tsv", "([^/]+)$", 1)
    sizes = written_once(sizes.withColumn("name", called), "files")  # a row a file
    placed = rows.join(F.broadcast(sizes.select("source_tsv", "_first", "name")), "source_tsv").withColumn("pos", F.col("_id") - F.col("_first"))
    both = placed.join(half_splits(sizes.select("name", "n").distinct(), seed), ["name", "pos"]).drop("_id", "_first", "name")
    return both if mode == "all" else both.filter(F.col("split") == mode)


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def buggy_rows(df: DataFrame) -> DataFrame:
    """Lower-case names, `prediction` as buggy_code where there is none, no nulls; raises on missing columns."""
    df = df.toDF(*[c.lower() for c in df.columns])
    if "buggy_code" not in df.columns and "prediction" in df.columns:
        df = df.withColumnRenamed("prediction", "buggy_code")
    if missing := [c for c in BUGGY_REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    counts = [c for c in ("selected_assert_index", "baseline_total", "baseline_failed", "baseline_passed", "pass", "fail", "total") if c in df.columns]
    return df.withColumns({c: counted(F.col(c)) for c in counts}).na.fill("")


def counted(x: Column) -> Column:
    """A count; what isn't a number is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0)).cast("int")


def measured(x: Column) -> Column:
    """A number; null for what isn't one."""
    return x.try_cast("double")


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines. Blank and torn lines are skipped, or fail the read if strict."""
    if strict:
        return spark.read.schema(schema).json(paths, mode="FAILFAST")
    bad = "_torn"
    parsed = F.from_json("value", T.StructType([*schema, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad})
    rows = spark.read.text(paths).filter(F.trim("value") != "").select(parsed.alias("_row"))
    return rows.filter(F.col(f"_row.{bad}").isNull() & F.col("_row").isNotNull()).select(*[F.col(f"_row.`{c}`") for c in schema.names])


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents that are arrays of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def id_list(spark: SparkSession, path: str, name: str = "task_id") -> DataFrame:
    """Distinct, trimmed, non-empty ids, in order, of a JSON list of strings; raises if it isn't one."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("ids"), F.trim("value").startswith("[").alias("is_list"))
    if not lists.filter("not is_list").isEmpty():
        raise ValueError(f"{path} holds no list")
    return lists.select(F.explode("ids").alias(name)).select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct().orderBy(name)


def split_of(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table that is partitioned by `split`; raises if there is none."""
    df = spark.read.parquet(path).filter(F.col("split") == split)
    if df.isEmpty():
        raise ValueError(f"{path} has no split {split}")
    return df


def all_splits(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of every split."""
    return spark.read.parquet(path).select("split", *columns)


def missing_ids(required: DataFrame, present: DataFrame, key: str) -> None:
    """Raises if a required id isn't present, with some of those that aren't."""
    lost = [r[0] for r in required.select(key).distinct().join(present.select(key).distinct(), key, "left_anti").orderBy(key).limit(20).collect()]
    if lost:
        raise ValueError(f"missing {key}: {', '.join(map(str, lost))}")


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several Parquet tables that exists and has rows; raises with what was wrong with each."""
    wrong = []
    for path in paths:
        try:
            df = spark.read.parquet(path)
            if not df.isEmpty():
                return df
            wrong.append(f"{path}: empty")
        except AnalysisException as e:
            wrong.append(f"{path}: {e.getCondition()}")
    raise ValueError("; ".join(wrong))


def problem_bank(spark: SparkSession, sources: list[tuple[str, str]], key: str, *order: str) -> DataFrame:
    """A bank of problems, one for each id, from the first of several sources that has any.

    sources: (format, path), tried in order: arrow, or a format of Spark's. A source that isn't there, that can't be
    read, that lacks the key or has no row with one isn't taken; if none is, what was wrong with each is raised. Ids are
    texts without blanks at their ends; blank ones are no ids; of rows with one id the first in order counts.
    """
    wrong = []
    for kind, path in sources:
        try:
            df = read_arrow(spark, path) if kind == "arrow" else spark.read.format(kind).load(path)
            if key not in df.columns:
                wrong.append(f"{kind} {path}: no column {key}")
                continue
            bank = df.withColumn(key, F.trim(F.col(key).cast("string"))).filter(F.coalesce(key, F.lit("")) != "")
            if bank.isEmpty():
                wrong.append(f"{kind} {path}: no problems")
                continue
            return first_wins(bank, [key], *(order or [c for c in bank.columns if c != key]))
        except (PySparkException, FileNotFoundError) as e:
            wrong.append(f"{kind} {path}: {str(e).strip().splitlines()[0][:200]}")
    raise ValueError("; ".join(wrong))


def or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An earlier output as TSV, or an empty table where there is none or where its columns are others."""
    try:
        found = tsv(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if set(schema.names) - set(found.columns):
        return spark.createDataFrame([], schema)
    return found.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])

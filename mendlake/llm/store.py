"""Shared tables that cut lineage, and joins whose broadcast side is measured first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendlake.tables import shared_dir

#: Rows of a narrow table (a few longs a row) that may be broadcast: about 50 MB.
BROADCAST_ROWS = 1_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    A lost executor then costs the rereading of files, and Python work above the table is not repeated.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of materialise() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if shared_dir(spark).removeprefix("file://").rstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, members: Column | None = None) -> DataFrame:
    """df marked for broadcast if it was counted to have at most so many rows; else df, and Spark shuffles.

    df should be a materialised, narrow table: it is counted here. members: of a table with arrays, how many members a
    row has; they count like rows.
    """
    n = df.count() if members is None else df.agg(F.count(F.lit(1)) + F.coalesce(F.sum(members), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

"""Metrics of a stream, a row for each batch and metric, in a table that grows with the stream."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BINS = 20
ROW = "query string, batch long, at timestamp, metric string, value double, bins array<bigint>"


def measured(df: DataFrame, name: str, x: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """df, streaming or not, observed under a name: rows, nulls, sum, least, most of x and its counts in equal bins.

    Values outside [low, high] fall in the first or last bin, so that bins are the same in every batch.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(x) - low) / (high - low) * bins)))
    counts = F.array(*[F.count_if(F.col(x).isNotNull() & (at == i)) for i in range(bins)])  # least() passes over nulls
    nulls = F.count_if(F.col(x).isNull())
    return df.observe(name, F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"), F.sum(x).alias("sum"), F.min(x).alias("least"), F.max(x).alias("most"), counts.alias("bins"))


class MetricTable(StreamingQueryListener):
    """Writes what measured() observes to a table: a row for each batch and scalar, and one for its bins.

    Rows are kept until there are `every`, then appended by a thread of its own, as Spark must not be called from where
    it tells of progress; close() writes the rest. A batch that is run again after a failure is told of again: the last
    row of a query, batch and metric counts.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 500):
        self._spark, self._path, self._every = spark, path, every
        self._rows: list[tuple] = []
        self._writer = ThreadPoolExecutor(1)
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        for name, row in p.observedMetrics.items():
            if not row["rows"]:  # a batch without data
                continue
            for k, v in row.asDict().items():
                scalar = None if v is None or k == "bins" else float(v)
                self._rows.append((p.name or str(p.id), p.batchId, at, f"{name}.{k}", scalar, list(v) if k == "bins" else None))
        if len(self._rows) >= self._every:
            self._flush()

    def onQueryTerminated(self, event) -> None:
        self._flush()

    def _flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self._writer.submit(lambda: self._spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(self._path))

    def close(self) -> DataFrame:
        """The table, after all that was told of so far."""
        self._spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
        self._spark.streams.removeListener(self)
        self._flush()
        self._writer.shutdown(wait=True)
        return self._spark.read.schema(ROW).parquet(self._path)


def by_batch(metrics: DataFrame) -> DataFrame:
    """A row for each query and batch: rows, sum, least, most, bins; of a batch that ran twice, its last."""
    last = metrics.groupBy("query", "batch", "metric").agg(F.max_by(F.struct("value", "bins"), "at").alias("v"))
    of = lambda k, field="value": F.max(F.when(F.col("metric").endswith(f".{k}"), F.col(f"v.{field}"))).alias(k)
    return last.groupBy("query", "batch").agg(of("rows"), of("nulls"), of("sum"), of("least"), of("most"), of("bins", "bins"))


def together(batches: DataFrame) -> list[Column]:
    """Aggregates of by_batch() over all batches."""
    bins = F.aggregate(F.collect_list("bins"), F.array_repeat(F.lit(0).cast("long"), BINS), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return [F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in ("rows", "sum")], F.min("least").alias("least"), F.max("most").alias("most"), bins.alias("bins")]

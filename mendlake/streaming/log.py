"""Append-only logs: replay of the last record of each key, in batch and as a stream, and progressive summaries.

A log on disk is a folder log=<name> of segments, folders segment=<number> from 0 on with a file of bytes each, which
follow one another without regard to line ends: a writer that is stopped leaves a torn line, and one that goes on may
end it in its next segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from mendlake.operators.joins import last_wins
from mendlake.tables import shared_dir

#: Bytes of files of one batch of a stream, where no number of files is given: batches then grow with the input, not with
#: how many files it is cut into.
BYTES_A_BATCH = 128 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _per_batch(files: int | None) -> dict[str, int]:
    return {"maxFilesPerTrigger": files} if files else {"maxBytesPerTrigger": BYTES_A_BATCH}


def relevant(log: DataFrame, experiment: str, events: list[str], key: str) -> DataFrame:
    """Records of an experiment (or of none) with one of the events and a key that isn't blank."""
    return log.filter((F.coalesce("experiment", F.lit("")).isin("", experiment)) & F.col("event").isin(*events) & (F.trim(F.coalesce(key, F.lit(""))) != ""))


def replay(log: DataFrame, keys: list[str], *offset: str) -> DataFrame:
    """The state after replaying a log: the last record of each key."""
    return last_wins(log, keys, *offset)


@contextmanager
def state_provider(spark: SparkSession, name: str = ROCKSDB):
    """The state store of the streams that are started within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def streamed_state(
    spark: SparkSession, path: str, schema: T.StructType, keys: list[str], offset: list[str], files_per_batch: int | None = None, fold: Callable[[DataFrame], DataFrame] | None = None, base: str | None = None,
) -> DataFrame:
    """replay() of a folder of Parquet files as a stream.

    The last record of each key is kept in the state store and read from there, so what is read in the end is a row for
    each key, however many batches there were. fold: from the files' rows to those that count. base: a folder of the shared disk that outlives the call; a later call
    with the same one goes on behind the files that were read. The trigger reads what is there and stops. A key's rows
    must differ in offset.
    """
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).options(**_per_batch(files_per_batch)).parquet(path)
    rows = fold(stream) if fold else stream
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[f"`{c}`" for c in rows.columns]), F.struct(*offset)).alias("last"))
    with state_provider(spark):
        query = last.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    if not query.lastProgress and not _begun(spark, f"{base}/state/state"):
        return spark.createDataFrame([], rows.schema)
    state = spark.read.format("statestore").load(f"{base}/state")
    value = state.schema["value"].dataType.names[0]  # the record; the offset is the second
    return state.select(F.col(f"value.`{value}`").alias("last")).select("last.*")


def _begun(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


class Tails(StatefulProcessor):
    """The torn lines of a log: what follows a segment's last line end waits for the next segment's first one.

    Segments that come before their turn are kept until it is theirs; one that comes again changes nothing. Those of a
    batch that come in their turn don't go through the state, whose every call is a message to the JVM.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "next long, text string")
        self.early = handle.getMapState("early", "segment long", "head string, tail string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        following, text = self.open.get() if self.open.exists() else (0, "")
        now = {r.segment: (r.head, r.tail) for r in rows if r.segment >= following}
        waiting = self.early.exists()
        while following in now or (waiting and self.early.containsKey((following,))):
            head, tail = now.pop(following, None) or self.early.getValue((following,))
            if waiting:
                self.early.removeKey((following,))
            text += head
            if tail is not None:
                yield Row(log=key[0], segment=following, line=0, text=text)
                text = tail
            following += 1
        for segment, piece in now.items():
            self.early.updateValue((segment,), piece)
        self.open.update((following, text))

    def close(self) -> None:
        pass


LINE = "log string, segment long, line int, text string"


def log_lines(spark: SparkSession, path: str, base: str, files_per_batch: int | None = None) -> DataStreamWriter:
    """A stream of the whole lines of the logs below path (log=*/segment=*/*) into the table {base}/lines, not started.

    log, segment and line number a line: 0 is the one that ends in the segment, but may have begun before. Only a
    segment's first and last piece go through the state; lines between are read as they are. Bytes are one character
    each until a line is whole, so that a character may be torn, too. A last line without an end is none yet. The
    writer's checkpoint is in base: started anew, it goes on where it was stopped.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.options(**_per_batch(files_per_batch)).option("recursiveFileLookup", True).load(path)
    parts = F.split(F.decode("content", "ISO-8859-1"), "\n", -1)
    of = lambda pattern: F.regexp_extract("path", pattern, 1)
    cut = found.select(of("/log=([^/]*)/").alias("log"), of("/segment=([0-9]+)/").cast("long").alias("segment"), parts.alias("parts"))
    n = F.size("parts")
    edges = cut.select("log", "segment", F.col("parts")[0].alias("head"), F.when(n > 1, F.get("parts", n - 1)).alias("tail"))
    inner = cut.filter(n > 2).select("log", "segment", F.posexplode(F.slice("parts", F.lit(2), n - 2)).alias("line", "text"))
    torn = edges.groupBy("log").transformWithState(statefulProcessor=Tails(), outputStructType=LINE, outputMode="Append", timeMode="None")
    lines = torn.unionByName(inner.withColumn("line", F.col("line") + 1))
    whole = lines.withColumn("text", F.encode("text", "ISO-8859-1").cast("string"))
    return whole.writeStream.format("parquet").option("path", f"{base}/lines").option("checkpointLocation", f"{base}/tails").outputMode("append")


def streamed_log(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], base: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """replay() of the JSON logs below path as streams: the last record of each key by log, segment and line.

    Lines that aren't JSON records are skipped. Both streams go on where they were stopped if base is kept.
    """
    base = base or f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    with state_provider(spark):
        log_lines(spark, path, base, files_per_batch).trigger(availableNow=True).start().awaitTermination()

    def records(lines: DataFrame) -> DataFrame:
        bad = "_torn"
        parsed = F.from_json("text", T.StructType([*schema, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad})
        rows = lines.filter(F.trim("text") != "").withColumn("_row", parsed).filter(F.col(f"_row.{bad}").isNull() & F.col("_row").isNotNull())
        return rows.select("log", "segment", "line", *[F.col(f"_row.`{c}`").alias(c) for c in schema.names])

    return streamed_state(spark, f"{base}/lines", T.StructType.fromDDL(LINE), keys, ["log", "segment", "line"], files_per_batch, records, base)


def running_totals(stream: DataFrame, keys: list[str], aggs: list) -> DataFrame:
    """Totals of a stream for the complete output mode: summaries that are replaced as results come in."""
    return stream.groupBy(*keys).agg(*aggs)

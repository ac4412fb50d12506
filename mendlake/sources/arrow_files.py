"""Arrow IPC files as a data source: a task reads some record batches of one file and hands them on as they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

SUFFIX = ".arrow"


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """The file itself, or all files below a folder whose name ends in SUFFIX, in order."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return fs, [root]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return fs, sorted(x.path for x in found if x.is_file and x.path.endswith(SUFFIX))


@dataclass
class Batches(InputPartition):
    file: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, batches: int):
        self._path, self._names, self._batches = path, schema.names, batches

    def partitions(self) -> list[Batches]:
        """Runs of record batches; only the files' footers are read for that."""
        fs, names = _files(self._path)
        out = []
        for name in names:
            with fs.open_input_file(name) as f:
                n = pa.ipc.open_file(f).num_record_batches
            out += [Batches(name, i, min(n, i + self._batches)) for i in range(0, n, self._batches)]
        return out

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self._path if "://" in self._path else f"file://{self._path}")
        with fs.open_input_file(partition.file) as f:
            file = pa.ipc.open_file(f)
            for i in range(partition.first, partition.last):
                yield file.get_batch(i).select(self._names)


class ArrowFiles(DataSource):
    """format("arrow_files"), with options path and batches (record batches a task, 1 without)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        fs, names = _files(self.options["path"])
        if not names:
            raise FileNotFoundError(f"{self.options['path']} has no {SUFFIX} files")
        with fs.open_input_file(names[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema, int(self.options.get("batches", "1")))


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | None = None, batches: int = 1) -> DataFrame:
    """Arrow files at path; a schema leaves the other columns unread."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files").option("path", path).option("batches", str(batches))
    return (reader.schema(schema) if schema else reader).load()


def write_arrow(df: DataFrame, path: str) -> int:
    """df as Arrow files below path, a file for each task that has rows; how many rows. path is on a disk that all
    machines share. A task that is run again writes its file anew."""
    columns = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        n, out, file = 0, None, None
        for batch in batches:
            if batch.num_rows and out is None:
                fs.create_dir(root, recursive=True)
                file = fs.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():05d}{SUFFIX}")
                out = pa.ipc.new_file(file, batch.rename_columns(columns).schema)
            if batch.num_rows:
                out.write_batch(batch.rename_columns(columns))
                n += batch.num_rows
        if out is not None:
            out.close()
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return df.mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0

"""Writers: logs that grow, tables that are replaced, documents of one row, and the report as LaTeX."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlake.tables import apart


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_tsv(df: DataFrame, path: str, append: bool = False) -> None:
    """TSV that readers.tsv() reads back: quoted, with doubled quotes; nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "struct", "map")) else F.col(f.name) for f in df.schema]
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # else Spark strips texts as it writes them
    df.select(*flat).write.mode("append" if append else "overwrite").options(sep="\t", header=True, quote='"', escape='"', quoteAll=True, **whole).csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small table's rows as one indented JSON document, an array of them."""
    row = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    df.agg(F.to_json(row, {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_bytes(df: DataFrame, folder: str) -> int:
    """A file for each row (name, content: text) below folder, which all machines share; how many there are.

    For bytes that end nowhere in particular, such as a log's segments. A task that is run again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return df.select("name", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def log_rows(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Rows of a wide text log: the columns in their order, decimals with so many digits, blank for null and for
    columns that df lacks, arrays, structs and maps as JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def text(c: str) -> Column:
        x = F.col(f"`{c}`")
        if kinds[c] in ("double", "float"):
            x = fixed(x, digits)
        elif kinds[c].startswith(("array", "struct", "map")):
            x = F.to_json(x)
        return x.alias(c)

    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in kinds else F.lit("")
    return apart(df.select(*[text(c) for c in columns if c in kinds])).select(*[cell(c).alias(c) for c in columns])


def by_mode(df: DataFrame, path: str) -> None:
    """A folder for each mode."""
    df.write.mode("overwrite").partitionBy("mode").json(path)


def fixed(x: Column, digits: int) -> Column:
    """Decimals as text, blank for null. A number that lies exactly between two goes to the even digit, as C has it."""
    half = x * float(2 ** (digits + 1))  # only whole halves of the last digit lie there, and they are exact
    even = F.when((half == F.floor(half)) & (F.abs(half) < 2.0**53), F.bround(x.cast("double"), digits)).otherwise(x)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", even)).otherwise("")


def latex(report: DataFrame, labels: list[str]) -> str:
    """The report table (a row for each of about ten experiments) as a LaTeX tabular."""
    numbers = [c for c in report.columns if c not in labels]
    rows = report.collect()
    lines = [rf"\begin{{tabular}}{{{'l' * len(labels)}|{'c' * len(numbers)}}}", r"\toprule", " & ".join([*labels, *numbers]).replace("_", r"\_") + r" \\", r"\midrule"]
    for r in rows:
        cells = [str(r[c]) for c in labels] + ["" if r[c] is None else f"{r[c]:.1f}" for c in numbers]
        lines.append(" & ".join(cells).replace("_", r"\_") + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}"])

"""WARC archives with an index, and reads of selected records by coalesced byte ranges.

Writing: one pass over the pages writes an archive of gzip members (one a record) for every task, and gives a row of
the index for every record: file, offset, length, URL, digest. The index is a Parquet table; Spark commits its rows
once, so what a task wrote before it was lost is an archive that no row names. Repeated payloads are found by their
digests alone. Those that repeat at least HOT times are broadcast, the others too if they were counted to be few enough;
else pages meet them in a shuffle in which no digest has HOT rows.

Reading: the index is filtered first, then dealt out by file and stretches of RANGE bytes and sorted by offset, to as
many tasks as the records' bytes call for; neighbouring records (gaps up to GAP) are one read. Archives are opened by pyarrow.fs, so any file system that it
knows by URI will do (on HDFS the executors need libhdfs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendlake.llm.store import fresh_path, materialise, small

#: Bytes after which a task begins another archive, of one read at most, and between records of one read at most.
ARCHIVE, RANGE, GAP = 256 << 20, 8 << 20, 64 << 10
#: Bytes of records for a reading task, at most and (while there are fewer tasks than cores) at least.
TASK, LEAST_TASK = 64 << 20, 1 << 20
#: Pages from which a digest is hot.
HOT = 1_000
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, file string, offset long, length long"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, sha1: str, first: int | None) -> bytes:
    """A WARC record, not compressed. first: the page whose response this record revisits, if it does."""
    revisit = first is not None
    http = HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not lines[0].startswith("WARC/1.") or len(block) != int(fields["content-length"]):
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v or "")) else None
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    kind, sha1 = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha1, "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def _writer(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        out, name, offset, files = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                    if out is None or offset >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{files}.warc.gz"
                        out, offset, files = store.open_output_stream(f"{root}/{name}", compression=None), 0, files + 1
                    payload = (html.as_py() or "").encode()
                    page, url, first = page.as_py(), url.as_py(), first.as_py()
                    sha1 = digest(payload)
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, sha1, first)) + packer.flush()
                    out.write(member)
                    rows.append((page, url, sha1, "response" if first is None else "revisit", first, len(payload), f"{folder}/{name}", offset, len(member)))
                    offset += len(member)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return write


def write(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) in the shared folder; returns their index (INDEX).

    Of pages with equal payloads of at least min_bytes bytes, that with the smallest page_id is a response and the
    others revisit it. A null html is empty. Rows that repeat the smallest page_id of a payload are all responses; a
    row with a null page_id revisits if any page with an id has its payload. Extra columns are not read; an empty table
    gives an empty index.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    seen = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    again = materialise(seen.filter("n > 1 and low is not null"), "repeated")
    hot = small(again.filter(F.col("n") >= HOT).select("sha", F.col("low").alias("hot")))
    low = F.coalesce("hot", "low")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") != low), low)
    own = F.coalesce("page_id", F.xxhash64("url")).cast("string").cast("binary")
    cold = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat("sha", own))  # of a hot row: a key that nothing has, so that none piles up
    rows = keyed.join(hot, "sha", "left").withColumn("cold", cold)
    rows = rows.join(small(again.filter(F.col("n") < HOT).select(F.col("sha").alias("cold"), "low")), "cold", "left").select("page_id", "url", "html", first.alias("first"))
    folder = fresh_path(spark, "warc")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return materialise(rows.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(payloads: bool) -> Callable:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names, kinds = names + ["payload"] * payloads, kinds + [pa.binary()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None

        def fetch(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal opened, source
            if group[0][0] != opened:
                if source is not None:
                    source.close()
                opened = group[0][0]
                store, name = fs.FileSystem.from_uri(opened)
                source = store.open_input_file(name)
            start = group[0][1]
            source.seek(start)
            raw = source.read(max(o + n for _, o, n in group) - start)
            rows = [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for _, o, n in group]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if group and (file != group[0][0] or offset > group[-1][1] + group[-1][2] + GAP or offset + length > group[0][1] + RANGE):
                    yield fetch(group)
                    group = []
                group.append((file, offset, length))
        if group:
            yield fetch(group)
        if source is not None:
            source.close()

    return read


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of index (file, offset, length) name; each response's payload is held to its digest."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_TASK)))
    dealt = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / (RANGE if size > TASK else LEAST_TASK)))
    dealt = dealt.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return dealt.mapInArrow(_reader(payloads), schema)

"""WARC: archives written by the tasks of a join, and read back by a salvage reader.

Of pages with equal payloads the one with the largest page_id is a response, the others are revisits
of it. A task writes files of its own names to the shared folder, rolled at ROLL bytes; only those that
a finished task has listed are read, so a lost or repeated task leaves at most unread files.

The reader checks each record's member, headers, length and digests. After a failed check it searches
for the next valid member or version line, also within a member of many records, goes on there, and logs
the bytes in between as a gap. What it finds so is marked as salvaged.

A null html is an empty payload. Rows without a page_id are responses of their own and are revisited by
none. Repeated rows are written each; those with the largest page_id are all responses. Empty tables
give empty results; only the named columns are read.
"""

from __future__ import annotations

import mmap
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import local_path, open_shared, shared_dir, small_batches, stored, text_of
from seqloom.llm.warc import Gap, digest, salvage, write_record

ROLL = 128 << 20


def decided(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses.

    Payloads are grouped by digest with partial aggregation; texts move once, by page_id, so a group
    of copies is spread over all tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(html_col).cast("binary").alias("payload"))
    keys = rows.select("page_id", F.sha1("payload").alias("sha"))
    last = keys.where("page_id is not null").groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = keys.join(last, "sha").where("page_id <> last").select("page_id", "sha", F.col("last").alias("refers_to")).distinct()
    return rows.withColumn("sha", F.sha1("payload")).join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")


def write(rows: DataFrame, home: str, roll: int = ROLL) -> DataFrame:
    """Write decided pages to archives below ``home``; (path, records, bytes) of each file, stored."""
    small_batches(rows.sparkSession)

    def work(batches):
        out, path, size, n = None, None, 0, 0
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    path, size, n = f"{home}/archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(path, "wb")
                record = write_record(page, url, payload, digest(payload), refers)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= roll:
                    out.close()
                    out = None
                    yield _listed(path, n, size)
        if out is not None:
            out.close()
            yield _listed(path, n, size)

    return stored(rows.mapInArrow(work, "path string, records long, bytes long"), f"{home}/files")


def _listed(path: str, records: int, size: int):
    return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})


_READ = "path string, offset long, inner long, length long, salvaged boolean, reason string, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_COLUMNS = [c.split()[0] for c in _READ.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for c in _READ.split(", ")])


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files in column ``path``, and the gaps: rows with a reason and without a type.

    payload_digest and payload_bytes are of the full payload: worked out for a response, as recorded
    for a revisit.
    """
    spark = files.sparkSession
    small_batches(spark)
    listed = files.select("path")
    listed = listed.repartition(max(1, min(listed.count(), 4 * spark.sparkContext.defaultParallelism)))

    def work(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for x in _records(path):
                    if isinstance(x, Gap):
                        rows.append((path, x.offset, x.inner, x.length, None, x.reason, *[None] * 7))
                    else:
                        kind, h = x.headers.get("warc-type"), x.headers
                        full = kind != "revisit"
                        size = len(x.payload) if full else _number(x.http.get("content-length"))
                        name = digest(x.payload) if full else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((path, x.offset, x.inner, x.length, x.salvaged, None, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), name, size, x.payload if payloads else None))
                        held += len(x.payload) if payloads else 0
                    if len(rows) >= 1000 or held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return listed.mapInArrow(work, _READ)


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isdigit() else None


def _batch(rows):
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_COLUMNS), schema=_ARROW, preserve_index=False)


def _records(uri: str):
    if path := local_path(uri):
        with open(path, "rb") as f:
            if f.seek(0, 2):
                with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                    yield from salvage(data)
    else:
        with open_shared(uri, "rb") as f:
            yield from salvage(f.read())


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: bytes of each file that held no valid record."""
    return found.where("type is null").select("path", "offset", "inner", "length", "reason")


def read_archives(spark: SparkSession, paths: list[str], payloads: bool = True) -> DataFrame:
    return read(spark.createDataFrame([(p,) for p in paths], "path string"), payloads)


def digests(found: DataFrame) -> DataFrame:
    """The pages that records were written for."""
    def page(name):
        return F.regexp_extract(name, r"^<urn:seqloom:page:(-?\d+)>$", 1)

    def number(name):
        return F.when(page(name) != "", page(name).cast("long"))

    return found.where("type is not null").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    files = write(decided(pages), shared_dir(pages.sparkSession))
    return digests(read(files, payloads=False))

"""Token-ID files in ascending doc_id order, coded by an adaptive context-mixing range coder.

Documents are dealt to tasks by ranges of doc_id and sorted there, so that the files, in the order of
their task and number, hold all ids in order. A file is a row of blocks, each coded anew and with its
own checksums, and a checksummed table of its documents at the end. Tasks write under names of their
own to the shared folder; only files that a finished task has listed are read.

Null and empty texts are the end id alone. Rows that repeat a doc_id follow one another; rows without
one come first. An empty table writes no file. Only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import open_shared, shared_dir, small_batches, stored, text_of
from seqloom.llm.op02_bpe import TOKENIZER
from seqloom.llm.rangecoder import BLOCK, Corrupt, pack_block, unpack_block
from seqloom.llm.wordbpe import TOGETHER, tokenizer_path, word_bpe

END_ID = 1
#: Ids after which a task begins another file.
ROLL = 1 << 25
#: Pieces of words that a worker remembers, in each of two generations.
PIECES = 500_000
#: The document table at a file's end: doc_id, whether it is null, ids. Then its crc32, its length and a mark.
_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])
_MARK = b"IDS1"
_FILES = "task int, number int, path string, docs long, ids long, bytes long"


class _Writer:
    def __init__(self, path: str, alphabet: int):
        self.path, self.alphabet, self.out = path, alphabet, open_shared(path, "wb")
        self.rows, self.held, self.size, self.ids, self.bytes = [], [], 0, 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.rows.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        self.ids += len(ids)
        if self.size >= BLOCK:
            self.flush(BLOCK)

    def flush(self, least: int) -> None:
        """Write blocks while as many ids are held."""
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.int32)
        at = 0
        while len(ids) - at >= least and at < len(ids):
            block = pack_block(ids[at : at + BLOCK], self.alphabet)
            self.out.write(block)
            self.bytes += len(block)
            at += BLOCK
        self.held, self.size = [ids[at:]], max(len(ids) - at, 0)

    def close(self):
        self.flush(1)
        table = zlib.compress(np.array(self.rows, _ROW).tobytes(), 1)
        tail = table + np.array([zlib.crc32(table), len(table)], "<u4").tobytes() + _MARK
        self.out.write(tail)
        self.out.close()
        return len(self.rows), self.ids, self.bytes + len(tail)


def _gathered(batches):
    """Tables of one chunk, of so many rows as hold TOGETHER bytes of text, or a batch more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def write(docs: DataFrame, home: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL) -> DataFrame:
    """Encode and write; the files, in order, with the place of their first id: (task, number, path, docs, ids, bytes, start)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").withColumn("task", F.spark_partition_id())

    def work(batches):
        bpe, writer, number, task = word_bpe(tokenizer_path(tokenizer), PIECES), None, 0, 0
        alphabet, end = max(len(bpe.strings), end_id + 1), (end_id,)

        def listed():
            d, k, b = writer.close()
            cells = (task, number, writer.path, d, k, b)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["task", "number", "path", "docs", "ids", "bytes"])

        for batch in _gathered(batches):
            for task, doc_id, ids in zip(batch["task"].to_pylist(), batch["doc_id"].to_pylist(), bpe.encode_all(batch["text"].chunk(0), end)):
                if writer is None:
                    writer = _Writer(f"{home}/ids/{uuid.uuid4().hex}.ids", alphabet)
                writer.add(doc_id, ids)
                if writer.ids >= roll:
                    yield listed()
                    writer, number = None, number + 1
        if writer is not None:
            yield listed()

    files = stored(dealt.mapInArrow(work, _FILES), f"{home}/files")
    # Where each file begins: the sums of the tasks before, of which there are few, and of the task's files before.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("task").agg(F.sum("ids").alias("of_task")).select("task", F.coalesce(F.sum("of_task").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(bases, "task").select(*files.columns, (F.col("base") + F.coalesce(F.sum("ids").over(earlier), F.lit(0))).alias("start"))


def _table(raw: bytes) -> tuple[np.ndarray, int]:
    crc, size = np.frombuffer(raw[-12:-4], "<u4").tolist()
    data = raw[-12 - size : -12]
    if raw[-4:] != _MARK or len(data) < size or zlib.crc32(data) != crc:
        raise Corrupt("document table damaged")
    return np.frombuffer(zlib.decompress(data), _ROW), len(raw) - 12 - size


def documents(path: str):
    """(doc_id, ids) of a file, one document after another, with one block in memory at a time besides the file."""
    with open_shared(path, "rb") as f:
        raw = f.read()
    rows, end = _table(raw)
    at, held = 0, np.empty(0, np.int64)
    for doc_id, null, n in rows.tolist():
        parts, missing = [], n
        while missing > len(held):
            parts.append(held)
            missing -= len(held)
            if at >= end:
                raise Corrupt("fewer ids than the table names")
            held, at = unpack_block(raw, at)
        parts.append(held[:missing])
        held = held[missing:]
        yield None if null else doc_id, np.concatenate(parts)
    if at != end or len(held):
        raise Corrupt("more ids than the table names")


def read(files: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files, from the files."""
    spark = files.sparkSession
    small_batches(spark)
    listed = files.select("path", "start")
    listed = listed.repartition(max(1, listed.count()))

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                for doc_id, one in documents(path):
                    rows.append((doc_id, start, len(one), zlib.crc32(one.astype("<u4").tobytes()), one if ids else None))
                    start, held = start + len(one), held + len(one) * ids
                    if len(rows) >= 5000 or held > 1 << 22:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return listed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _rows(rows):
    *plain, ids = zip(*rows)
    lists = pa.array([None if x is None else x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in plain), lists], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def round_trip(docs: DataFrame) -> DataFrame:
    """What the files hold, without the ids themselves."""
    return read(write(docs, shared_dir(docs.sparkSession)), ids=False).drop("ids")

"""FASTA and FASTQ as a Spark data source.

One partition reads a file, compressed or not, so that ``rec_no`` is the record's place in it. With
``split_mb`` plain files are cut into byte ranges, each read by a task of its own from the first record
that begins in it; ``rec_no`` is then the record's byte offset: it still orders records, but does not
pair mates. ``file_no`` is the file's place among those of the path, in order of their names: records of
files of one name in several folders are told apart by it, and the n-th files of two paths are mates.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.session import ship
from seqloom.sources.files import is_compressed, listed, opened, size_of

SCHEMA = "file string, mate int, rec_no bigint, id string, seq string, qual string, raw string, file_no int"


class FormatError(ValueError):
    pass


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    end: int = -1
    number: int = 0


def _line(x: bytes) -> bytes:
    return x.rstrip(b"\r\n")


def records(f, path: str, mate: int, start: int = 0, end: int = -1, raw: bool = True) -> Iterator[tuple]:
    """Records that begin at or behind ``start`` and before ``end``; by place if there is no end, else by offset."""
    name, by_offset = os.path.basename(path), end >= 0
    at = _first(f, start) if by_offset else 0
    line = f.readline()
    while line in (b"\n", b"\r\n"):
        at += len(line)
        line = f.readline()
    no = 0
    while line and (not by_offset or at < end):
        begin = at
        at += len(line)
        kind, head = line[:1], _line(line[1:])
        if kind == b">":
            lines, line = [line], f.readline()
            while line and line[:1] != b">":
                lines.append(line)
                at += len(line)
                line = f.readline()
            seq, qual = b"".join(map(_line, lines[1:])), None
        elif kind == b"@":
            lines = [line, f.readline()]
            seq = [_line(lines[1])]
            more = f.readline()
            while more and more[:1] != b"+":
                lines.append(more)
                seq.append(_line(more))
                more = f.readline()
            seq = b"".join(seq)
            lines.append(more)
            qual = b""
            while len(qual) < len(seq) or not qual:
                more = f.readline()
                if not more:
                    break
                lines.append(more)
                qual += _line(more)
                if not seq:
                    break
            if len(qual) != len(seq):
                raise FormatError(f"{name}: quality and sequence of record {no + 1} differ in length")
            at += sum(map(len, lines[1:]))
            line = f.readline()
            while line in (b"\n", b"\r\n"):
                at += len(line)
                line = f.readline()
        else:
            raise FormatError(f"{name}: record {no + 1} begins with neither > nor @")
        text = b"".join(lines) if raw else None
        if raw and not text.endswith(b"\n"):
            text += b"\n"
        yield (name, mate, begin if by_offset else no, *(None if x is None else x.decode("utf-8", "replace") for x in (head, seq, qual, text)))
        no += 1


def _first(f, start: int) -> int:
    """Go to the first record that begins at or behind ``start``; its offset.

    In FASTQ a quality line may begin with @ too; a record is told by the + two lines on and equal
    lengths of the lines between.
    """
    if start == 0:
        f.seek(0)
        return 0
    f.seek(0)
    fasta = f.read(1) != b"@"
    f.seek(start - 1)
    at = start - 1 + len(f.readline())
    while True:
        f.seek(at)
        lines = [f.readline() for _ in range(1 if fasta else 4)]
        if not lines[0] or (fasta and lines[0][:1] == b">"):
            break
        if not fasta and lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(_line(lines[1])) == len(_line(lines[3])):
            break
        at += len(lines[0])
    f.seek(at)
    return at


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.mate = int(options.get("mate", "1"))
        self.raw = options.get("raw", "true").lower() == "true"
        self.split = int(float(options.get("split_mb", "0")) * (1 << 20))

    def partitions(self):
        out = []
        for n, p in enumerate(listed(self.path)):
            size = size_of(p)
            if self.split and size > self.split and not is_compressed(p):
                out += [Part(p, a, min(a + self.split, size), n) for a in range(0, size, self.split)]
            else:
                out.append(Part(p, number=n))
        return out

    def read(self, partition):
        with opened(partition.path) as f:
            for r in records(f, partition.path, self.mate, partition.start, partition.end, self.raw):
                yield (*r, partition.number)


class FastxSource(DataSource):
    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, path: str, mate: int = 1, *, raw: bool = True, split_mb: float = 0) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("mate", mate).option("raw", str(raw).lower()).option("split_mb", split_mb).load(path)

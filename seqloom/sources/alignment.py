"""SAM and BAM as Spark data sources.

One partition reads a file, so that ``rec_no`` is the record's place in it. With ``split_mb`` plain SAM
files are cut into byte ranges, each read by a task of its own from the first line that begins in it;
``rec_no`` is then the line's byte offset, which orders records as well.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.session import ship
from seqloom.sources.files import is_compressed, listed, opened, size_of

SCHEMA = (
    "file string, rec_no bigint, id string, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int,"
    " seq string, qual string, tags array<struct<tag:string,type:string,value:string>>"
)
# Fixed values of the format: codes of bases and operations, and the binary layout of tag values.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class FormatError(ValueError):
    pass


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    end: int = -1


def sam_header(path: str) -> list[str]:
    out = []
    with opened(path) as f:
        for line in f:
            if line[:1] != b"@":
                break
            out.append(line.decode("utf-8", "replace").rstrip("\r\n"))
    return out


def parse_tag(text: str) -> tuple[str, str, str]:
    parts = text.split(":", 2)
    if len(parts) != 3:
        raise FormatError(f"no such tag: {text}")
    return parts[0], parts[1], parts[2]


def _lines(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of lines that begin at or behind ``start`` and before ``end``."""
    at = start
    if start:
        f.seek(start - 1)
        at += len(f.readline()) - 1
    while end < 0 or at < end:
        line = f.readline()
        if not line:
            return
        yield at, line
        at += len(line)


def sam_records(path: str, start: int = 0, end: int = -1) -> Iterator[tuple]:
    name, place, head = os.path.basename(path), 0, True
    with opened(path) as f:
        for at, line in _lines(f, start, end):
            if line[:1] == b"@" and head:  # the header, which a range may begin in; no record's name begins so
                continue
            no, head = at if end >= 0 else place, False
            x = line.decode("utf-8", "replace").rstrip("\r\n").split("\t")
            if x == [""]:
                continue
            if len(x) < 11:
                raise FormatError(f"{name}: record {no + 1} has {len(x)} columns")
            yield (name, no, x[0], x[0], int(x[1]), x[2], int(x[3]), int(x[4]), x[5], x[6], int(x[7]), int(x[8]), "" if x[9] == "*" else x[9], x[10], [parse_tag(t) for t in x[11:]])
            place += 1


def _exactly(f, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise FormatError("file cut short")
    return raw


def bam_start(f) -> tuple[list[str], list[tuple[str, int]]]:
    """The header lines and the reference sequences of an open BAM file."""
    if _exactly(f, 4) != b"BAM\x01":
        raise FormatError("not a BAM file")
    text = _exactly(f, struct.unpack("<i", _exactly(f, 4))[0]).rstrip(b"\0").decode("utf-8", "replace")
    refs = []
    for _ in range(struct.unpack("<i", _exactly(f, 4))[0]):
        name = _exactly(f, struct.unpack("<i", _exactly(f, 4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", _exactly(f, 4))[0]))
    return [x for x in text.split("\n") if x], refs


def bam_header(path: str) -> list[str]:
    with opened(path) as f:
        return bam_start(f)[0]


def _tags(raw: bytes) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in NUMBERS:
            code = "<" + NUMBERS[kind]
            value = struct.unpack_from(code, raw, at)[0]
            at += struct.calcsize(code)
            out.append((tag, "f" if kind == "f" else "i", f"{value:g}" if kind == "f" else str(value)))
        elif kind == "A":
            out.append((tag, "A", chr(raw[at])))
            at += 1
        elif kind in "ZH":
            end = raw.index(0, at)
            out.append((tag, kind, raw[at:end].decode("utf-8", "replace")))
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            code = f"<{n}{NUMBERS[sub]}"
            values = struct.unpack_from(code, raw, at + 5)
            at += 5 + struct.calcsize(code)
            out.append((tag, "B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])))
        else:
            raise FormatError(f"no such tag type: {kind}")
    return out


def bam_records(path: str, start: int = 0, end: int = -1) -> Iterator[tuple]:
    name, no = os.path.basename(path), 0
    with opened(path) as f:  # blocks of a BAM file are gzip members
        _, refs = bam_start(f)
        names = [r for r, _ in refs]
        while size := f.read(4):
            if len(size) < 4:
                raise FormatError(f"{name}: file cut short")
            raw = _exactly(f, struct.unpack("<i", size)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
            at = 32
            qname = raw[at : at + l_name - 1].decode("utf-8", "replace")
            at += l_name
            cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", raw, at)) or "*"
            at += 4 * n_cigar
            packed = raw[at : at + (l_seq + 1) // 2]
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
            at += len(packed)
            qual = raw[at : at + l_seq]
            at += l_seq
            quality = "*" if not l_seq or qual[:1] == b"\xff" else "".join(chr(q + 33) for q in qual)
            rname = names[ref] if ref >= 0 else "*"
            rnext = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
            yield (name, no, qname, qname, flag, rname, pos + 1, mapq, cigar, rnext, next_pos + 1, tlen, seq, quality, _tags(raw[at:]))
            no += 1


class SamReader(DataSourceReader):
    records = staticmethod(sam_records)

    def __init__(self, path, split_mb: str = "0"):
        self.path, self.split = path, int(float(split_mb) * (1 << 20))

    def partitions(self):
        out = []
        for p in listed(self.path):
            size = size_of(p)
            if self.split and size > self.split and not is_compressed(p):
                out += [Part(p, a, min(a + self.split, size)) for a in range(0, size, self.split)]
            else:
                out.append(Part(p))
        return out

    def read(self, partition):
        yield from self.records(partition.path, partition.start, partition.end)


class BamReader(SamReader):
    records = staticmethod(bam_records)


class SamSource(DataSource):
    @classmethod
    def name(cls):
        return "sam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SamReader(self.options["path"], self.options.get("split_mb", "0"))


class BamSource(SamSource):
    @classmethod
    def name(cls):
        return "bam"

    def reader(self, schema):
        return BamReader(self.options["path"])


def read_alignments(spark: SparkSession, path: str, kind: str, *, split_mb: float = 0) -> DataFrame:
    if kind not in ("sam", "bam"):
        raise FormatError(f"alignments are read from sam and bam, not {kind}")
    ship(spark)
    spark.dataSource.register(SamSource if kind == "sam" else BamSource)
    return spark.read.format(kind).option("split_mb", split_mb).load(path)


def header(path: str, kind: str) -> list[str]:
    return sam_header(path) if kind == "sam" else bam_header(path)

"""Alignments to SAM and BAM, in input order."""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row

from seqloom import __version__
from seqloom.session import ship
from seqloom.sources.alignment import BASES, NUMBERS, OPERATIONS, FormatError

PROGRAM = "seqloom"
_BLOCK = 0xFF00
#: The empty block that ends a BAM file, a fixed value of the format.
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def program_line(command: str) -> str:
    return f"@PG\tID:{PROGRAM}\tPN:{PROGRAM}\tCL:{command}\tVN:{__version__}"


def output_kind(out: str | None, kind: str) -> str:
    """sam or bam by the output's extension, else as the input; standard output is always sam."""
    if out is None:
        return "sam"
    name = out.rsplit("/", 1)[-1]
    found = name.rsplit(".", 1)[1] if "." in name else kind
    if found not in ("sam", "bam"):
        raise FormatError(f"alignments are written to sam and bam, not {found}")
    return found


def _rows(kept: DataFrame):
    return kept.orderBy("file", "rec_no").toLocalIterator(prefetchPartitions=True)


def sam_line(r) -> str:
    cells = [r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.rnext, r.pnext, r.tlen, r.seq or "*", r.qual]
    return "\t".join([*map(str, cells), *(f"{t.tag}:{t.type}:{t.value}" for t in r.tags)]) + "\n"


def _lines(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield sam_line(Row(**{**r, "tags": [Row(**t) for t in r["tags"]]}))


def write_sam_parts(kept: DataFrame, header: list[str], folder: str) -> None:
    """A folder of ordered parts that the tasks write, and ``_header.sam``: put before the parts it makes one file."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in _lines([batch])], pa.string())], names=["line"])

    ship(kept.sparkSession)
    kept.orderBy("file", "rec_no").mapInArrow(work, "line string").write.mode("errorifexists").text(folder)
    with open(os.path.join(folder, "_header.sam"), "w", encoding="utf-8", newline="") as f:
        f.writelines(x + "\n" for x in header)


def write_bam_parts(kept: DataFrame, header: list[str], folder: str) -> None:
    """A folder of ordered parts of whole blocks that the tasks write; in the order of their names they make one file.

    Tasks write under names of their own and report them; only reported parts get their names.
    """
    os.makedirs(folder)
    numbers = {name: i for i, (name, _) in enumerate(references(header))}

    def work(batches):
        path = os.path.join(folder, f"_{uuid.uuid4().hex}")
        f = Blocks(path)
        for batch in batches:
            for r in batch.to_pylist():
                f.write(bam_record(Row(**{**r, "tags": [Row(**t) for t in r["tags"]]}), numbers))
        f.close(last=False)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path], pa.string())], names=["part", "path"])

    ship(kept.sparkSession)
    done = kept.orderBy("file", "rec_no").mapInArrow(work, "part int, path string").collect()  # a row for each part
    f = Blocks(os.path.join(folder, "part-00000"))
    f.write(_head(header))
    f.close(last=False)
    for n, r in enumerate(sorted(done), 1):
        os.rename(r.path, os.path.join(folder, f"part-{n:05d}"))
    Blocks(os.path.join(folder, f"part-{len(done) + 1:05d}")).close()


def write_sam(kept: DataFrame, header: list[str], out=None) -> None:
    """To a path, or to an open text file; standard output if there is neither."""
    to = open(out, "w", encoding="utf-8", newline="") if isinstance(out, str) else out or sys.stdout
    try:
        to.writelines(x + "\n" for x in header)
        to.writelines(map(sam_line, _rows(kept)))
    finally:
        if isinstance(out, str):
            to.close()


class Blocks:
    """A file of compressed blocks; blocks of several such files in a row are one file."""

    def __init__(self, path: str):
        self.out, self.held = open(path, "wb"), bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= _BLOCK:
            self._block(bytes(self.held[:_BLOCK]))
            del self.held[:_BLOCK]

    def _block(self, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(data) + z.flush()
        self.out.write(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data)))

    def close(self, last: bool = True) -> None:
        if self.held:
            self._block(bytes(self.held))
        if last:
            self.out.write(_EOF)
        self.out.close()


def _bin(begin: int, end: int) -> int:
    """The smallest index bin that holds [begin, end): six levels, each an eighth of the one above."""
    end -= 1
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if begin >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def _tag_bytes(tag: str, kind: str, value: str) -> bytes:
    head = tag.encode() + kind.encode()
    if kind == "i":
        n = int(value)
        return tag.encode() + (b"i" + struct.pack("<i", n) if n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    if kind == "A":
        return head + value.encode()[:1]
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "B":
        sub, *numbers = value.split(",")
        return head + sub.encode() + struct.pack("<i", len(numbers)) + struct.pack(f"<{len(numbers)}{NUMBERS[sub]}", *(float(x) if sub == "f" else int(x) for x in numbers))
    raise FormatError(f"no such tag type: {kind}")


def bam_record(r, refs: dict[str, int]) -> bytes:
    seq = r.seq or ""
    operations, n = [], ""
    for c in "" if r.cigar == "*" else r.cigar:
        if c.isdigit():
            n += c
        else:
            operations.append((int(n), OPERATIONS.index(c)))
            n = ""
    code = {c: i for i, c in enumerate(BASES)}
    bases = [code.get(c.upper(), 15) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(bases[::2], bases[1::2]))
    quality = b"\xff" * len(seq) if r.qual == "*" else bytes(ord(c) - 33 for c in r.qual)
    ref = refs.get(r.rname, -1)
    mate = ref if r.rnext == "=" else refs.get(r.rnext, -1)
    span = sum(n for n, op in operations if OPERATIONS[op] in "MDN=X") or 1
    pos = r.pos - 1
    name = r.qname.encode() + b"\0"
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name), r.mapq, _bin(pos, pos + span) if pos >= 0 else 4680, len(operations), r.flag, len(seq), mate, r.pnext - 1, r.tlen)
    body = fixed + name + b"".join(struct.pack("<I", n << 4 | op) for n, op in operations) + packed + quality + b"".join(_tag_bytes(t.tag, t.type, t.value) for t in r.tags)
    return struct.pack("<i", len(body)) + body


def references(header: list[str]) -> list[tuple[str, int]]:
    """Names and lengths of the reference sequences."""
    rows = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header if line.startswith("@SQ")]
    return [(r["SN"], int(r["LN"])) for r in rows]


def _head(header: list[str]) -> bytes:
    refs, text = references(header), "".join(x + "\n" for x in header).encode()
    names = b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n) for name, n in refs)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + names


def write_bam(kept: DataFrame, header: list[str], out: str) -> None:
    f = Blocks(out)
    try:
        f.write(_head(header))
        numbers = {name: i for i, (name, _) in enumerate(references(header))}
        for r in _rows(kept):
            f.write(bam_record(r, numbers))
    finally:
        f.close()

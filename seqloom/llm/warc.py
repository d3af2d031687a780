"""Records of web archives as bytes: writing one, and reading a damaged file on past its faults."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_LINE = re.compile(rb"WARC/\d\.\d\r?\n")
_MAGIC = b"\x1f\x8b\x08"
#: Inflated bytes of a member that are kept while its checksum is worked out; a larger member is inflated twice.
_KEEP = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:seqloom:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    m = re.fullmatch(r"<urn:seqloom:page:(-?\d+)>", identifier or "")
    return int(m[1]) if m else None


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url)


def write_record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit that names the response with the same one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _uri(url) if url else None,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Refers-To": record_id(refers_to) if refers_to is not None else None,
        "WARC-Profile": REVISIT_PROFILE if refers_to is not None else None,
        "Content-Length": str(len(block)),
    }
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    """A valid record. ``inner`` is its place in the inflated member where that holds several, and ``length`` then counts inflated bytes.

    ``salvaged`` marks what was found by search behind a fault, or in a member whose checksum fails: its
    block satisfies its digests, but it may have been quoted in a damaged record's payload.
    """

    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    http: dict[str, str] = field(default_factory=dict)
    inner: int | None = None
    salvaged: bool = False


@dataclass
class Gap:
    """Bytes [offset, offset + length) that held no valid record, and what was wrong at their start; ``inner`` as for a record.

    A member whose checksum fails is a gap as a whole, also where records of it were salvaged.
    """

    offset: int
    length: int
    reason: str
    inner: int | None = None


class Damaged(Exception):
    """A fault; ``end`` is where the damaged record ends, if its own length says so and a record or the end follows there."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


class _Plain:
    """Bytes, or a map of a file, that are all there."""

    def __init__(self, data):
        self.data = data

    def slice(self, a: int, b: int) -> bytes:
        return bytes(self.data[a:b])

    def newline(self, at: int) -> int:
        return self.data.find(b"\n", at)

    def release(self, before: int) -> None:
        pass


class _Inflating:
    """A member's content, inflated as far as it is asked for; what was released is gone. A fault ends it."""

    def __init__(self, data, start: int):
        self.data, self.at, self.z = data, start, zlib.decompressobj(31)
        self.buffer, self.base, self.over = bytearray(), 0, False

    def _fill(self, to: int | None) -> bool:
        while not self.over and (to is None or self.base + len(self.buffer) < to):
            piece = self.z.unconsumed_tail or bytes(self.data[self.at : self.at + _CHUNK])
            self.at += 0 if self.z.unconsumed_tail else len(piece)
            try:
                got = self.z.decompress(piece, 1 << 20)
            except zlib.error:
                got, piece = b"", b""
            self.buffer += got
            self.over = self.z.eof or not piece
            if to is None:
                return bool(got) or not self.over
        return to is not None and self.base + len(self.buffer) >= to

    def slice(self, a: int, b: int) -> bytes:
        self._fill(b)
        return bytes(self.buffer[a - self.base : b - self.base])

    def newline(self, at: int) -> int:
        while True:
            i = self.buffer.find(b"\n", at - self.base)
            if i >= 0:
                return self.base + i
            at = max(at, self.base + len(self.buffer))
            if self.over or not self._fill(None):
                return -1

    def release(self, before: int) -> None:
        del self.buffer[: before - self.base]
        self.base = before


def _headers(src, at: int) -> tuple[dict[str, str], int]:
    """The header lines from ``at`` up to an empty line, and where that line ends. The first line that is none ends the search."""
    out, last = {}, None
    while (end := src.newline(at)) >= 0:
        line = src.slice(at, end).rstrip(b"\r")
        at = end + 1
        if not line:
            return out, at
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            k, v = line.split(b":", 1)
            last = k.strip().lower().decode("utf-8", "replace")
            out[last] = v.strip().decode("utf-8", "replace")
        else:
            raise Damaged("header line")
    raise Damaged("headers without an end")


def _version(src, at: int) -> int:
    """Where the version line at a place ends, or -1."""
    m = _LINE.match(src.slice(at, at + 12))
    return at + m.end() if m else -1


def _parse(src, start: int) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at ``start``, and where it ends."""
    at = _version(src, start)
    if at < 0:
        raise Damaged("no version line")
    headers, body = _headers(src, at)
    length = headers.get("content-length", "")
    if not (length.isdigit() and length.isascii()):
        raise Damaged("no content length")
    end = body + int(length)
    block = src.slice(body, end)
    if len(block) < int(length):
        raise Damaged("block cut short")
    tail = src.slice(end, end + 4)
    if tail != b"\r\n\r\n" and tail[:2] != b"\n\n":
        raise Damaged("no end of record")
    return headers, block, end + (4 if tail == b"\r\n\r\n" else 2)


def _verified(headers: dict[str, str], block: bytes) -> Record:
    for name in ("warc-record-id", "warc-type", "warc-date"):
        if not headers.get(name):
            raise Damaged(f"no {name}")
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named[5:] != digest(block):
        raise Damaged("block digest")
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        inside = _Plain(block)
        http, body = _headers(inside, inside.newline(0) + 1)
        payload = block[body:]
    named = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and named.startswith("sha1:") and named[5:] != digest(payload):
        raise Damaged("payload digest")
    return Record(0, 0, headers, payload, http)


def _record(src, start: int) -> tuple[Record, int]:
    headers, block, end = _parse(src, start)
    try:
        return _verified(headers, block), end
    except Damaged as e:
        # Its length holds if a record or the end follows; what is quoted in its payload is then passed over.
        follows = src.slice(end, end + 12)
        raise Damaged(str(e), end if not follows or _LINE.match(follows) or follows.startswith(_MAGIC) else None) from None


def _line_after(src, at: int) -> int:
    """The next version line on a line of its own behind ``at``, or -1."""
    while (at := src.newline(at) + 1) > 0:
        src.release(at)
        if _version(src, at) >= 0:
            return at
    return -1


def _sound(data, start: int) -> tuple[bytes | None, int, int, str | None]:
    """A member's content (None if it is large), where the member ends, the size of its content, and its fault. zlib checks CRC and size."""
    z, out, at, size = zlib.decompressobj(31), [], start, 0
    try:
        while not z.eof:
            piece = z.unconsumed_tail or bytes(data[at : at + _CHUNK])
            if not piece:
                return None, at, size, "member cut short"
            at += 0 if z.unconsumed_tail else len(piece)
            got = z.decompress(piece, 1 << 20)
            size += len(got)
            if size <= _KEEP:
                out.append(got)
    except zlib.error as e:
        return None, at, size, f"member: {str(e)[:60]}"
    return b"".join(out) if size <= _KEEP else None, at - len(z.unused_data), size, None


class _Search:
    """The next member with a record, or version line on a line of its own, from a place on; places only grow."""

    def __init__(self, data):
        self.data, self.zipped, self.line = data, -2, -2

    def __call__(self, at: int) -> int:
        data, size = self.data, len(self.data)
        while True:
            if -1 != self.zipped < at:
                self.zipped = data.find(_MAGIC, at)
            if -1 != self.line < at:
                m = _LINE.search(data, at)
                while m and m.start() and data[m.start() - 1] != 10:
                    m = _LINE.search(data, m.end())
                self.line = m.start() if m else -1
            places = [p for p in (self.zipped, self.line) if p >= 0]
            if not places:
                return size
            best = min(places)
            if best == self.line or _version(_Inflating(data, best), 0) >= 0:
                return best
            at = best + 1


def _inside(data, start: int, broken: bool, content: bytes | None, size: int) -> Iterator[Record | Gap]:
    """Records of one member, and the gaps in its content."""
    src = _Inflating(data, start) if content is None else _Plain(content)
    at, found_by_search = 0, broken
    while at < size:
        try:
            record, end = _record(src, at)
            record.offset, record.length, record.inner, record.salvaged = start, end - at, at, found_by_search
            # The only record of a member stands or falls with its checksum, which covers its headers too.
            if not broken or at or end < size:
                yield record
        except Damaged as e:
            end = e.end
            if end is None:
                end = _line_after(src, at)
                end, found_by_search = (size, found_by_search) if end < 0 else (end, True)
            yield Gap(start, end - at, str(e), at)
        at = end
        src.release(at)


def salvage(data) -> Iterator[Record | Gap]:
    """Every valid record of an archive's bytes (or map), compressed by member or plain, and the gaps between them.

    After a failed check the reader goes on where the damaged record ends by its own length, if a record
    or the end follows there, and else at the next member or version line, also within a member's
    content; so one fault costs one record and the bytes up to the next. Headers are read line by line and
    members piece by piece, so memory holds one record, and at most 64 MB of a member. A member's
    checksum covers its headers; in a plain archive, digests cover blocks only, and a changed byte in a
    header's value goes unseen.
    """
    pos, size, search, plain = 0, len(data), _Search(data), _Plain(data)
    found_by_search = False
    while pos < size:
        fault = None
        if bytes(data[pos : pos + 3]) == _MAGIC:
            content, end, inflated, fault = _sound(data, pos)
            parts = _inside(data, pos, fault is not None, content, inflated)
            first = next(parts, None)
            if fault is None and isinstance(first, Record) and first.length == inflated:
                first.length, first.inner, first.salvaged = end - pos, None, found_by_search
                yield first
            elif fault is None and isinstance(first, Gap) and first.length == inflated:
                yield Gap(pos, end - pos, first.reason)
            else:
                for x in itertools.chain([] if first is None else [first], parts):
                    if fault is None or isinstance(x, Record):
                        yield x
            if fault is None and not inflated:
                yield Gap(pos, end - pos, "empty member")
            found_by_search = False
        else:
            try:
                record, end = _record(plain, pos)
                record.offset, record.length, record.salvaged = pos, end - pos, found_by_search
                yield record
            except Damaged as e:
                fault, end = str(e), e.end
                if end is not None:
                    yield Gap(pos, end - pos, fault)
                    fault = None
        if fault is not None:
            end = search(pos + 1)
            found_by_search = True
            yield Gap(pos, end - pos, fault)
        pos = end


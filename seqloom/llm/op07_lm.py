"""LM scoring: an interpolated modified Kneser-Ney model of words, counted in Spark and memory-mapped by the workers.

Each order has adjusted counts: those of the highest order, and of what begins a text, are counts; an
n-gram below has the number of different words that stand before it. The order is 3 unless 2 is asked for.

Counting takes two passes over the training texts. The first counts words. In the second each task counts
the n-grams of FLUSH tokens at a time and deals them, as compressed sorted arrays, to shards of about
SHARD tokens. A trigram goes to the shard of its middle word: there all that follows its first two words
and all that precedes its last two is together, so one shuffle serves two orders. Trigrams around a word
of more than SHARD / 4 tokens are dealt by the first word as well, and how often such a word's
pairs are preceded is summed in a second, smaller shuffle by pair. So no shard holds much more than its
share, whatever the words and however many. Tasks write FILE shards to one file. Where there are more
files than FAN, n-grams are dealt in two steps, so that arrays do not get smaller as the data grow.

A file holds sorted hash arrays and a table of their places: n-grams seen once, and the others with their
numbers; numbers have the least width that holds them. An array keeps 32 bits of a hash behind those
that its directory implies, so that an absent n-gram is taken for a present one about four times in 10^9. A
pair in no other array that has one predecessor was seen once, so contexts seen once are not stored.
Workers map at most MAPS files at a time where the folder is mounted, without holding them open, and load at
most LOADS from other stores. They look up GROUP bytes of text at a time, as each look-up goes to every shard.
What the driver sees and sends has one size, whatever the data.

Tokens are the words of a text, A-Z in lower case, then one end; a begin mark precedes the first.
Null and empty texts are an end alone. Rows without an id are scored and not learnt from. Repeated
rows count each. With nothing to learn from, every text has probability one. Equal counts need no order. Only
the named columns are read, so others may have any name; a very long text is scored with its batch.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import sys
import uuid
from collections import OrderedDict
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ARROW_BYTES, local_path, open_shared, shared_dir, small_batches, stored, text_of

ORDER = 3
#: Tokens that a task counts before it sends them on.
FLUSH = 4_000_000
#: Tokens, and so n-grams, of a shard, and bytes of text that are taken for a token.
SHARD, TOKEN_BYTES = 2_000_000, 6
#: Shards of a file, which one task writes, and times as many shards for a shard of words.
FILE, WORD_SHARDS = 4, 8
#: Files that n-grams are dealt to in one step.
FAN = 1024
#: Whether a file can be mapped without a handle that stays open.
_CLOSED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: Files that a worker holds mapped, and loaded. Each batch goes through all files, so with fewer maps than files it maps each anew.
MAPS, LOADS = 16384 if _CLOSED else 512, 128
#: Bytes of text that are scored together: what one batch may have.
GROUP = ARROW_BYTES

_U = np.uint64
_TASK_WORDS = 1_000_000
_HOT = _U(1)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11) & ~1  # the last bit marks words that are dealt by pair


END, BEGIN, NONE = _hash(b"\x00end"), _hash(b"\x00begin"), _hash(b"\x00none")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(v * _U(0x9E3779B97F4A7C15) + w)


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h + _U(0x632BE59BD9B4E019)) % _U(n)).astype(np.int64)


def _place(u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each trigram: that of its middle word, where this is hot of its first two, where this begins the text of its last two."""
    own = np.where(hot, _pair(v, u), v)
    return _shard(np.where(v == _U(BEGIN), _pair(v, w), own), shards)


def pack(*columns: np.ndarray) -> bytes:
    """Columns as bytes. The first is sorted, so its differences are kept, byte plane by byte plane."""
    parts = []
    for i, x in enumerate(columns):
        x = np.asarray(x, dtype=_U)
        x = np.diff(x, prepend=_U(0)) if i == 0 else x
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(x.T).view(_U).ravel() for x in raw]
    out[0] = np.cumsum(out[0], dtype=_U)
    return out


def _pack_grams(hashes: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """N-grams of word numbers, sorted by their first column, with the hashes of the words in them, which are sorted by number."""
    used = np.zeros(len(hashes), bool)
    for c in columns:
        used[c] = True
    number = np.cumsum(used) - 1
    columns = [number[c] for c in columns]
    same = np.diff(columns[0], prepend=-1) == 0
    first = np.diff(columns[0], prepend=0)
    second = np.where(same, np.diff(columns[1], prepend=0), columns[1])  # may fall within a shard's run: kept modulo 2^32
    planes = [np.ascontiguousarray(x.astype(np.int64).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (first, second, *columns[2:], counts)]
    words, grams = pack(hashes[used]), zstandard.ZstdCompressor(level=1).compress(b"".join(planes))
    return len(words).to_bytes(4, "little") + words + grams


def _unpack_grams(blob: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    hashes = unpack(blob[4 : 4 + size], 1)[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + size :]), np.uint8).reshape(columns + 1, 4, -1)
    first, second, *rest = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
    starts = np.flatnonzero(np.r_[True, first[1:] != 0]) if len(first) else np.empty(0, np.int64)
    total = np.cumsum(second, dtype=np.uint32)
    base = np.repeat(total[starts] - second[starts], np.diff(np.r_[starts, len(first)]))
    return hashes, [np.cumsum(first, dtype=np.uint32), (total - base).astype(np.uint32), *rest[:-1]], rest[-1]


class _Words:
    """Numbers words in the order they are met and keeps their hashes."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.index = {}
        self.hashes: list[int] = [END, BEGIN, NONE]

    def ids(self, text: bytes) -> np.ndarray:
        """Nothing, begin, the words, end; each by its number here."""
        words = text.lower().split()  # of bytes: only A-Z change
        index, hashes = self.index, self.hashes
        out = np.empty(len(words) + 3, np.int64)
        out[0], out[1], out[-1] = 2, 1, 0
        for w in set(words).difference(index):
            index[w] = len(hashes)
            hashes.append(_hash(w))
        out[2:-1] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return out


def _training(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return rows.select(text_of(text_col).cast("binary").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _chunks(batches):
    """Token numbers of up to FLUSH tokens, document after document, with the words' hashes; numbers are in the order of the hashes."""
    words, docs, n = _Words(), [], 0

    def numbered():
        hashes = np.array(words.hashes, _U)
        rank = np.argsort(hashes)
        number = np.empty(len(hashes), np.int64)
        number[rank] = np.arange(len(hashes))
        ids = number[np.concatenate(docs)]
        return hashes[rank], ids, np.cumsum([len(d) for d in docs])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            docs.append(words.ids(text))
            n += len(docs[-1]) - 2
            if n >= FLUSH or len(words.hashes) > _TASK_WORDS:
                yield numbered()
                docs, n = [], 0
                words.forget()
    if docs:
        yield numbered()


_BLOBS = "kind int, part int, n long, blob binary, facts array<long>"
_BLOB_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()), ("facts", pa.list_(pa.int64()))])
#: What a blob holds: words with counts, contexts of one word, words with predecessors, n-grams, pairs; or numbers for the whole.
COUNT, CONTEXT, CONTINUED, GRAMS, PAIRS, FACTS3, FACTS2, FACTS1 = range(8)
_WIDTH = {COUNT: 2, CONTEXT: 5, CONTINUED: 2}


def _rows(rows):
    cells = [list(c) for c in zip(*rows)] or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _BLOB_ARROW)], schema=_BLOB_ARROW)


def _batched(rows):
    """Rows of blobs in batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > 8 << 20:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _slices(part: np.ndarray):
    """(part, from, to) of a sorted column."""
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((int(part[a]), a, b) for a, b in pairwise(cuts) if b > a)


def _words_by_shard(kind: int, shards: int, *columns: np.ndarray):
    """A blob for each shard of words, from columns the first of which is the hash."""
    shard = _shard(columns[0], shards)
    order = np.lexsort((columns[0], shard))
    shard, columns = shard[order], [c[order] for c in columns]
    for s, a, b in _slices(shard):
        yield kind, s, b - a, pack(*(c[a:b] for c in columns)), None


def _grams_by_file(kind: int, hashes: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, shard: np.ndarray, per: int):
    """A blob for every ``per`` shards, sorted by shard and then by n-gram."""
    part = shard // per
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 65536 else part, kind="stable")
    part, columns, counts = part[order], [c[order] for c in columns], counts[order]
    for p, a, b in _slices(part):
        yield kind, p, b - a, _pack_grams(hashes, [c[a:b] for c in columns], counts[a:b]), None


def _merge(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


# --- files of sorted hash arrays ---------------------------------------------------------------------------


class _File:
    """Arrays by name, one after another, their table and its length at the end. What a file holds depends on its name alone, so a second attempt writes the same."""

    def __init__(self, uri: str):
        self.path, self.uri = local_path(uri), uri
        self.at = f"{self.path}.{uuid.uuid4().hex}" if self.path else uri
        self.out, self.size, self.table = open_shared(self.at, "wb"), 0, {}

    def _put(self, x: np.ndarray) -> list:
        x = np.ascontiguousarray(x)
        data = x.tobytes()
        place = [x.dtype.str, self.size, len(x)]
        self.out.write(data + bytes(-len(data) % 8))
        self.size += len(data) + -len(data) % 8
        return place

    def put(self, name: str, keys: np.ndarray, *values: np.ndarray) -> None:
        """Sorted hashes as a directory over their first bits and the 32 bits behind those, and the numbers that go with them."""
        bits = max(0, min(16, len(keys).bit_length() - 4))
        first = np.searchsorted(keys >> _U(63 - bits) >> _U(1), np.arange((1 << bits) + 1, dtype=_U))
        rest = (keys >> _U(32 - bits)).astype("<u4")
        widths = [np.min_scalar_type(int(v.max())) if len(v) else np.uint8 for v in values]
        self.table[name] = [bits, int(np.diff(first).max(initial=0)), *(self._put(x) for x in (first.astype("<u4"), rest, *(v.astype(t) for v, t in zip(values, widths))))]

    def close(self) -> None:
        table = json.dumps(self.table).encode()
        self.out.write(table + len(table).to_bytes(8, "little"))
        self.out.close()
        if self.path:
            os.replace(self.at, self.path)


class _Files:
    """Files that a worker has mapped; those used longest ago are let go."""

    def __init__(self, home: str):
        self.home, self.open, self.most = home, OrderedDict(), MAPS if local_path(home) else LOADS

    def arrays(self, name: str, array: str):
        """The directory and arrays of a name in a file, or None where there are none."""
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)
            self.open[name] = self._map(f"{self.home}/model/{name}")
        self.open.move_to_end(name)
        return self.open[name].get(array)

    @staticmethod
    def _map(uri: str):
        path = local_path(uri)
        try:
            if path:
                with open(path, "rb") as f:
                    raw = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_CLOSED), np.uint8)
            else:
                with open_shared(uri, "rb") as f:
                    raw = np.frombuffer(f.read(), np.uint8)
        except FileNotFoundError:  # no n-gram was dealt to it
            return {}
        size = int.from_bytes(raw[-8:].tobytes(), "little")
        table = json.loads(raw[-8 - size : -8].tobytes())
        return {name: (bits, longest, [raw[a : a + np.dtype(t).itemsize * n].view(t) for t, a, n in places]) for name, (bits, longest, *places) in table.items()}

    def find(self, name: str, array: str, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each hash is in an array, and its numbers there, zero where it is not."""
        found = self.arrays(name, array)
        if found is None:
            return np.zeros(len(h), bool), []
        bits, longest, (first, rest, *values) = found
        bucket = (h >> _U(63 - bits) >> _U(1)).astype(np.int64)
        want = (h >> _U(32 - bits)).astype(np.uint32)
        if not len(rest):
            return np.zeros(len(h), bool), []
        at, end = first.take(bucket).astype(np.int64), first.take(bucket + 1).astype(np.int64)
        # How many keys of the bucket are less, bit by bit.
        for bit in reversed(range(longest.bit_length())):
            probe = at + (1 << bit)
            less = rest.take(probe - 1, mode="clip") < want
            less &= probe <= end
            np.add(at, 1 << bit, out=at, where=less)
        hit = rest.take(at, mode="clip") == want
        hit &= at < end
        return hit, [np.where(hit, v.take(at, mode="clip"), 0).astype(np.int64) for v in values]


def _put_counts(file: _File, name: str, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> None:
    """N-grams with one count by their hashes alone, the others with their numbers."""
    once = counts == 1
    file.put(f"{name}-once", keys[once])
    file.put(f"{name}-more", keys[~once], counts[~once], *(m[~once] for m in more))


def _ranks(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


# --- counting ----------------------------------------------------------------------------------------------


def _count_words(word_shards: int):
    def rows(batches):
        for hashes, ids, ends in _chunks(batches):
            counts = np.bincount(ids, minlength=len(hashes))
            counts[np.searchsorted(hashes, np.array([BEGIN, NONE], _U))] = 0
            seen = np.flatnonzero(counts)
            yield from _words_by_shard(COUNT, word_shards, hashes[seen], counts[seen])

    return lambda batches: _batched(rows(batches))


def _by_part(batches):
    """(part, its rows) of batches that are sorted by part."""
    part, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] != part and rows:
                yield part, rows
                rows = []
            part = r["part"]
            rows.append(r)
    if rows:
        yield part, rows


def _write_words(home: str):
    """Words with their counts, as the second pass looks them up."""

    def rows(batches):
        for part, blobs in _by_part(batches):
            h, c = _merge(*(np.concatenate(x) for x in zip(*(unpack(r["blob"], 2) for r in blobs))))
            file = _File(f"{home}/model/count-{part}")
            file.put("words", h, c)
            file.close()
            yield COUNT, part, len(h), pack(h, c), [int(c.sum()), len(h)]

    return lambda batches: _batched(rows(batches))


def _hot(files: _Files, hashes: np.ndarray, word_shards: int, most: int) -> np.ndarray:
    """Whether n-grams around each word are dealt by more than that word."""
    hot = hashes == _U(BEGIN)
    shard = _shard(hashes, word_shards)
    for s, one in _split(shard):
        hit, values = files.find(f"count-{s}", "words", hashes[one])
        if values:
            hot[one] |= hit & (values[0] * 4 > most)
    return hot


def _count_grams(home: str, order: int, shards: int, word_shards: int, per: int, most: int):
    def rows(batches):
        files = _Files(home)
        for hashes, ids, ends in _chunks(batches):
            inner = np.ones(len(ids), bool)
            inner[np.r_[0, ends[:-1]]] = False
            inner[np.r_[0, ends[:-1]] + 1] = False
            at = np.flatnonzero(inner)  # places of tokens
            bits = len(hashes).bit_length()
            if order == 2:
                keys, counts = np.unique(ids[at - 1] << bits | ids[at], return_counts=True)
                v, w = keys >> bits, keys & (1 << bits) - 1
                yield from _grams_by_file(PAIRS, hashes, [v, w], counts, _shard(_pair(hashes[v], hashes[w]), shards), per)
            else:
                keys = ids[at - 1] << bits | ids[at - 2]
                if 3 * bits <= 63:
                    keys, counts = np.unique(keys << bits | ids[at], return_counts=True)
                    keys, w = keys >> bits, keys & (1 << bits) - 1
                else:  # a text of very many words: its pairs are numbered first
                    pairs, number = np.unique(keys, return_inverse=True)
                    keys, counts = np.unique(number << bits | ids[at], return_counts=True)
                    keys, w = pairs[keys >> bits], keys & (1 << bits) - 1
                v, u = keys >> bits, keys & (1 << bits) - 1
                hot = _hot(files, hashes, word_shards, most)
                shard = _place(hashes[u], hashes[v], hashes[w], hot[v], shards)
                yield from _grams_by_file(GRAMS, hashes | np.where(hot, _HOT, _U(0)), [v, u, w], counts, shard, per)

    return lambda batches: _batched(rows(batches))


def _deal_again(columns: int, shards: int):
    """The second step of dealing: n-grams of several first parts, by file."""

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append((r["kind"], *_unpack_grams(r["blob"], columns)))
                n += r["n"]
                if n >= FLUSH // 2:
                    yield from _dealt(held, columns, shards)
                    held, n = [], 0
        if held:
            yield from _dealt(held, columns, shards)

    return lambda batches: _batched(rows(batches))


def _dealt(held, columns: int, shards: int):
    hashes = np.unique(np.concatenate([h for _, h, _, _ in held]))
    parts = [np.concatenate([np.searchsorted(hashes, h)[c[k]] for _, h, c, _ in held]) for k in range(columns)]
    counts = np.concatenate([c for *_, c in held]).astype(np.int64)
    order = np.lexsort(parts[::-1])
    parts, counts = [p[order] for p in parts], counts[order]
    plain = hashes & ~_HOT
    if columns == 2:
        shard = _shard(_pair(plain[parts[0]], plain[parts[1]]), shards)
    else:
        v, u, w = parts
        shard = _place(plain[u], plain[v], plain[w], hashes[v] & _HOT != 0, shards)
    yield from _grams_by_file(held[0][0], hashes, parts, counts, shard, FILE)


def _write_grams(home: str, shards: int, word_shards: int):
    """Trigrams of a file, its shards one after another; pairs whose first word is dealt by pair go on to those."""

    def rows(batches):
        for part, blobs in _by_part(batches):
            blobs = [_unpack_grams(r.pop("blob"), 3) for r in blobs]
            file = _File(f"{home}/model/grams-{part}")
            places = [(_place(*((h & ~_HOT)[c[k]] for k in (1, 0, 2)), h[c[0]] & _HOT != 0, shards) % FILE).astype(np.uint8) for h, c, _ in blobs]
            for shard in range(part * FILE, min(shards, (part + 1) * FILE)):
                one = [np.flatnonzero(p == shard % FILE) for p in places]
                v, u, w = (np.concatenate([h[c[k][i]] for (h, c, _), i in zip(blobs, one)]) for k in range(3))
                n = np.concatenate([x[i] for (_, _, x), i in zip(blobs, one)]).astype(np.int64)
                yield from _shard_of_grams(file, shard % FILE, u & ~_HOT, v, w & ~_HOT, n, shards, word_shards)
            file.close()

    return lambda batches: _batched(rows(batches))


def _shard_of_grams(file: _File, slot: int, u, v, w, n, shards: int, word_shards: int):
    hot, v = v & _HOT != 0, v & ~_HOT
    first = u == _U(NONE)
    if first.any():  # what begins texts: its pairs keep their counts
        yield from _pairs_on(v[first], w[first], n[first], shards)
        u, v, w, n, hot = u[~first], v[~first], w[~first], n[~first], hot[~first]
    h = _pair(_pair(u, v), w)
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    one = order[starts]
    h, u, v, w, hot = h[starts], u[one], v[one], w[one], hot[one]
    n = np.add.reduceat(n[order], starts) if len(h) else n
    _put_counts(file, f"{slot}-grams", h, n)
    yield FACTS3, 0, len(h), b"", _ranks(n)
    context, total, *follow = _merge(_pair(u, v), n, *(x.astype(np.int64) for x in (n == 1, n == 2, n > 2)))
    many = total > 1
    file.put(f"{slot}-contexts", context[many], total[many], *(x[many] for x in follow))
    h = _pair(v, w)
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    one, before = order[starts], np.diff(np.r_[starts, len(h)])
    h, v, w, hot = h[starts], v[one], w[one], hot[one]
    if hot.any():
        yield from _pairs_on(v[hot], w[hot], before[hot], shards)
    yield from _pairs_done(file, slot, h[~hot], v[~hot], w[~hot], before[~hot], word_shards)


def _pairs_on(v, w, n, shards: int):
    hashes, at = np.unique(np.concatenate([v, w]), return_inverse=True)
    v, w = at[: len(v)], at[len(v) :]
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    yield from _grams_by_file(PAIRS, hashes, [v, w], n, _shard(_pair(hashes[v], hashes[w]), shards), FILE)


def _pairs_done(file: _File, slot: int, h, v, w, n, word_shards: int):
    """Write finished pairs, sorted by hash, and tell the words what they add to them."""
    _put_counts(file, f"{slot}-pairs", h, n)
    yield FACTS2, 0, len(h), b"", _ranks(n)
    yield from _words_by_shard(CONTEXT, word_shards, *_merge(v, n, *(x.astype(np.int64) for x in (n == 1, n == 2, n > 2))))
    yield from _words_by_shard(CONTINUED, word_shards, *_merge(w, np.ones(len(w), np.int64)))


def _write_pairs(home: str, shards: int, word_shards: int):
    def rows(batches):
        for part, blobs in _by_part(batches):
            blobs = [_unpack_grams(r.pop("blob"), 2) for r in blobs]
            file = _File(f"{home}/model/pairs-{part}")
            places = [(_shard(_pair(h[c[0]], h[c[1]]), shards) % FILE).astype(np.uint8) for h, c, _ in blobs]
            for shard in range(part * FILE, min(shards, (part + 1) * FILE)):
                one = [np.flatnonzero(p == shard % FILE) for p in places]
                v, w = (np.concatenate([h[c[k][i]] for (h, c, _), i in zip(blobs, one)]) for k in range(2))
                n = np.concatenate([x[i] for (_, _, x), i in zip(blobs, one)]).astype(np.int64)
                h = _pair(v, w)
                order = np.argsort(h, kind="stable")
                h = h[order]
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
                first = order[starts]
                n = np.add.reduceat(n[order], starts) if len(h) else n
                yield from _pairs_done(file, shard % FILE, h[starts], v[first], w[first], n, word_shards)
            file.close()

    return lambda batches: _batched(rows(batches))


def _finish_words(home: str):
    """Words with count, predecessors, and as contexts: their total and how many follow once, twice and more often."""

    def rows(batches):
        for part, blobs in _by_part(batches):
            hashes, values = [], []
            for r in blobs:
                h, *x = unpack(r["blob"], _WIDTH[r["kind"]])
                row = np.zeros((6, len(h)), np.int64)
                row[{COUNT: slice(0, 1), CONTINUED: slice(1, 2), CONTEXT: slice(2, 6)}[r["kind"]]] = x
                hashes.append(h)
                values.append(row)
            h, *x = _merge(np.concatenate(hashes), *np.concatenate(values, axis=1))
            file = _File(f"{home}/model/words-{part}")
            file.put("words", h, *x)
            file.close()
            yield FACTS1, part, len(h), b"", [*_ranks(x[1]), int((x[1] > 2).sum())]

    return lambda batches: _batched(rows(batches))


def _discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [0.0, *(min(max(x, 0.05), float(k)) for k, x in enumerate(raw, 1))]


def _to_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Each part's rows together, in a task of their own."""
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> dict:
    """Count the training rows of ``docs`` and write the model; returns its description, of one size whatever the data."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark, home = docs.sparkSession, shared_dir(docs.sparkSession)
    small_batches(spark)
    texts = _training(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    shards = max(1, math.ceil(((size[0] or 0) / TOKEN_BYTES + size[1]) / SHARD))
    files, word_shards = math.ceil(shards / FILE), math.ceil(shards / WORD_SHARDS)
    per = FILE * math.ceil(files / FAN)  # shards of a part in the first step of dealing
    words = _to_parts(texts.mapInArrow(_count_words(word_shards), _BLOBS), word_shards)
    words = stored(words.mapInArrow(_write_words(home), _BLOBS), f"{home}/counts")
    grams = texts.mapInArrow(_count_grams(home, order, shards, word_shards, per, SHARD), _BLOBS)
    columns = 2 if order == 2 else 3
    if per > FILE:
        # A part of the first step is much more than a task holds: its rows are spread, and dealt again to files.
        wide = math.ceil(shards / per)
        spread = math.ceil(files / wide)
        salted = grams.repartitionById(wide * spread, (F.col("part") * spread + F.pmod(F.xxhash64("blob"), F.lit(spread))).cast("int"))
        grams = salted.sortWithinPartitions("part").mapInArrow(_deal_again(columns, shards), _BLOBS)
    told = []
    if order == 3:
        told.append(stored(_to_parts(grams, files).mapInArrow(_write_grams(home, shards, word_shards), _BLOBS), f"{home}/grams"))
        grams = told[0].where(F.col("kind") == PAIRS)
    told.append(stored(_to_parts(grams, files).mapInArrow(_write_pairs(home, shards, word_shards), _BLOBS), f"{home}/pairs"))
    every = words.unionByName(told[0]).unionByName(told[-1]) if len(told) == 2 else words.unionByName(told[0])
    ends = _to_parts(every.where(F.col("kind").isin(COUNT, CONTEXT, CONTINUED)), word_shards)
    finished = stored(ends.mapInArrow(_finish_words(home), _BLOBS), f"{home}/words")
    facts = {}
    sums = [F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0)).alias(f"f{i}") for i in range(5)]
    for r in every.unionByName(finished).where(F.col("facts").isNotNull()).groupBy("kind").agg(F.sum("n").alias("n"), *sums).collect():
        facts[r.kind] = [int(r[f"f{i}"]) for i in range(5)] + [int(r.n)]
    none = [0] * 6
    one, two = facts.get(FACTS1, none), facts.get(FACTS2, none)
    low = _discounts(one[:4])
    return {
        "home": home, "order": order, "shards": shards, "word_shards": word_shards, "hot": SHARD,
        "train_tokens": facts.get(COUNT, none)[0], "vocabulary": facts.get(COUNT, none)[1], "types": two[5],
        "discounts": [[], low, _discounts(two[:4]), _discounts(facts.get(FACTS3, none)[:4])],
        "low_mass": sum(d * k for d, k in zip(low[1:], (one[0], one[1], one[4]))),
    }


# --- scoring -----------------------------------------------------------------------------------------------


def _split(shard: np.ndarray):
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 65536 else shard, kind="stable")
    return ((s, order[a:b]) for s, a, b in _slices(shard[order]))


class Model:
    """The written model as a worker sees it."""

    def __init__(self, about: dict):
        self.about, self.files = about, _Files(about["home"])

    def words(self, h: np.ndarray) -> np.ndarray:
        """Count, predecessors, total as a context, and what follows once, twice and more often; zeros for unseen words."""
        out = np.zeros((6, len(h)), np.int64)
        for s, one in _split(_shard(h, self.about["word_shards"])):
            _, values = self.files.find(f"words-{s}", "words", h[one])
            for k, x in enumerate(values):
                out[k, one] = x
        return out

    def _counts(self, file: str, name: str, h: np.ndarray, shard: np.ndarray, out: np.ndarray, where: np.ndarray) -> None:
        for s, one in _split(shard):
            at, slot = f"{file}-{s // FILE}", s % FILE
            # Where most are first: pairs of a text are frequent, trigrams are not.
            for kind in ("more", "once") if name == "pairs" else ("once", "more"):
                hit, values = self.files.find(at, f"{slot}-{name}-{kind}", h[one])
                out[where[one[hit]]] = values[0][hit] if values else 1
                one = one[~hit]

    def pairs(self, v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The adjusted count of each pair."""
        a, out, h = self.about, np.zeros(len(v), np.int64), _pair(v, w)
        apart = hot | (v == _U(BEGIN)) | (a["order"] == 2)
        by_pair, by_word = np.flatnonzero(apart), np.flatnonzero(~apart)
        self._counts("pairs", "pairs", h[by_pair], _shard(h[by_pair], a["shards"]), out, by_pair)
        self._counts("grams", "pairs", h[by_word], _shard(v[by_word], a["shards"]), out, by_word)
        return out

    def grams(self, u, v, w, hot, pair_seen) -> tuple[np.ndarray, np.ndarray]:
        """The count of each trigram; total, and followers once, twice and more often, of its first two words."""
        shard = _place(u, v, w, hot, self.about["shards"])
        count, context = np.zeros(len(v), np.int64), np.zeros((4, len(v)), np.int64)
        # A pair that is there and not among the contexts with more was seen once, followed by one word.
        context[0], context[1] = pair_seen, pair_seen
        h = _pair(u, v)
        known = np.flatnonzero(pair_seen)
        for s, one in _split(shard[known]):
            one = known[one]
            hit, values = self.files.find(f"grams-{s // FILE}", f"{s % FILE}-contexts", h[one])
            for k, x in enumerate(values):
                context[k, one[hit]] = x[hit]
        self._counts("grams", "grams", _pair(h[known], w[known]), shard[known], count, known)
        return count, context

    def probabilities(self, rows: np.ndarray, hashes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P of the words at the given places of a sequence of word numbers, given what stands before them."""
        a = self.about
        _, low, mid, high = (np.array(d) for d in a["discounts"])
        types, uniform = max(a["types"], 1), 1.0 / (a["vocabulary"] + 1)
        floor = a["low_mass"] / types if a["types"] else 1.0
        single = np.maximum(rows[1] - low[np.minimum(rows[1], 3)], 0) / types + floor * uniform
        v, w = ids[at - 1], ids[at]
        hot = rows[0] * 4 > a["hot"]
        pair = self.pairs(hashes[v], hashes[w], hot[v])
        p = _interpolated(pair, rows[2][v], rows[3:, v], mid, single[w])
        if a["order"] == 2:
            return p
        later = np.flatnonzero(v != 1)  # a first word has a shorter context
        before = np.zeros(len(ids), np.int64)
        before[at] = pair
        i = at[later]
        u, v, w = ids[i - 2], ids[i - 1], ids[i]
        count, context = self.grams(hashes[u], hashes[v], hashes[w], hot[v], before[i - 1] > 0)
        p[later] = _interpolated(count, context[0], context[1:], high, p[later])
        return p


def _interpolated(count, total, follow, discounts, lower):
    seen = total > 0
    direct = np.divide(np.maximum(count - discounts[np.minimum(count, 3)], 0), total, out=np.zeros(len(count)), where=seen)
    back = np.divide(discounts[1:] @ follow, total, out=np.ones(len(count)), where=seen)
    return direct + back * lower


def _groups(batches):
    """Batches joined, up to GROUP bytes of text."""
    held, size = [], 0
    for batch in batches:
        more = batch.column("text").nbytes
        if held and size + more > GROUP:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.Table.from_batches(held)


def _scored(about: dict, batches):
    model = Model(about)
    known, rows = _Words(), np.zeros((6, 0), np.int64)
    n, v = about["train_tokens"], about["vocabulary"]
    for group in _groups(batches):
        if len(known.hashes) > _TASK_WORDS // 2:
            known.forget()
            rows = np.zeros((6, 0), np.int64)
        docs = [known.ids(t) for t in group.column("text").to_pylist()]
        hashes = np.array(known.hashes, _U)
        rows = np.concatenate([rows, model.words(hashes[rows.shape[1] :])], axis=1)
        ids = np.concatenate(docs) if docs else np.empty(0, np.int64)
        ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
        sizes = np.diff(ends, prepend=0) - 2
        inner = np.ones(len(ids), bool)
        inner[ends - sizes - 2] = inner[ends - sizes - 1] = False
        at = np.flatnonzero(inner)
        starts = np.cumsum(sizes) - sizes
        base = np.log10((rows[0] + 1) / (n + v + 1))[ids[at]]
        prob = np.log10(model.probabilities(rows, hashes, ids, at))
        sums = [np.add.reduceat(x, starts) if len(docs) else x for x in (base, prob, (rows[0] > 0)[ids[at]].astype(np.int64))]
        out = pa.table(
            [group.column("doc_id"), group.column("held_out"), pa.array(sizes), pa.array(sums[2]), pa.array(np.full(len(docs), n, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )
        yield from out.combine_chunks().to_batches()


def score(docs: DataFrame, about: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()

    return source.mapInArrow(lambda batches: _scored(about, batches), f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Scores with the perplexity per token of the model and of the base."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumn("base_perplexity", F.pow(F.lit(10.0), -F.col("base_score") / F.col("n_tokens")))

"""An adaptive context-mixing range coder for token ids, many lanes side by side.

A block of ids is cut into lanes of equal length that are coded in lockstep, each by a carry-less
range coder of its own; all lanes learn one model, which begins afresh in every block. The model has
three predictions. Order 2 is the id that followed the two ids before; order 1 is a distribution over
the two ids that followed the id before most, by their counts; order 0 is the adaptive frequency of
every id. The probability of an id is the weighted sum of what the three give it. The weights are
learnt for each state of the two contexts (how often they were met, and how often they failed) by
online expectation: an order's share of the probability of each id that came is added to its weight.

An id is coded in the interval that the mixture's cumulative distribution gives it, in 31 bits of
precision: 11 for weights and 20 within an order. Intervals are integers, and what is learnt from
quotients is rounded to whole numbers first, so every machine decodes what any other has coded.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Ids of a block, and lanes of a full one.
BLOCK, LANES = 1 << 21, 4096
#: Ids that a lane has at least, where the block is smaller.
LEAST = 512
MIX_BITS, ID_BITS = 11, 20
_MIX, _ONE, _ID = 1 << MIX_BITS, 1 << ID_BITS, (1 << ID_BITS) - 1
#: The largest alphabet: every id has a part of an order's precision, and a quarter is left for frequencies.
MOST_IDS = 3 * _ONE // 4
#: Contexts of order 2 that are held; a hash with a check tells them apart, and the latest stays.
_TABLE_BITS = 18
#: Parts of a unit in which an order's share of an id's probability is counted.
_SHARE = 256.0
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_U16, _U31, _U48 = np.uint64(16), np.uint64(MIX_BITS + ID_BITS), np.uint64(48)
#: Flags of a step of an order-1 counter: the two ids change places, the first or the second is replaced.
_SWAP, _FIRST, _SECOND = 1 << 12, 1 << 13, 1 << 14


@functools.cache
def _counters():
    """Tables over an order-1 counter, three numbers below 16 (first, second, failures): its step for each outcome, its class and the first id's part.

    The outcomes are: the first id, the second, another one. Another one takes the second place once that has
    no more than one count.
    """
    n0, n1, miss = (x.ravel() for x in np.meshgrid(*[np.arange(16)] * 3, indexing="ij"))

    def packed(a, b, c, flags=0):
        full = (a > 15) | (b > 15) | (c > 15)
        a, b, c = (np.where(full, (x + 1) >> 1, x) for x in (a, b, c))
        swap = b > a
        return np.where(swap, b, a) << 8 | np.where(swap, a, b) << 4 | c | np.where(swap, _SWAP, 0) | flags

    empty, weak = n0 == 0, n1 <= 1
    other = packed(np.where(empty, 1, n0), np.where(empty, 0, np.where(weak, 1, n1 - 1)), np.where(empty, 0, miss + 1))
    other |= np.where(empty, _FIRST, np.where(weak, _SECOND, 0))
    step = np.concatenate([packed(n0 + 1, n1, miss), packed(n0, n1 + 1, miss), other])
    hits = n0 + n1
    failing = np.minimum(miss * 4 // np.maximum(hits + miss, 1), 3)
    often = np.digitize(hits + miss, [2, 4, 9])
    kind = np.where(empty, 0, often * 8 + failing * 2 + (n1 > 0))
    first = np.where(n1 == 0, _ONE, _ONE * (2 * n0 + 1) // (2 * hits + 2))
    return step & 4095, kind, first.astype(np.int32), *(-((step & f) != 0).astype(np.int32) for f in (_SWAP, _FIRST, _SECOND))


#: The step of an order-2 counter: failure, then success.
_STEP2 = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int32) << ID_BITS


class _Model:
    """What the coder and the decoder know alike before each step."""

    def __init__(self, alphabet: int, lanes: int, inverse: bool = False):
        if alphabet > MOST_IDS:
            raise ValueError("more ids than the coder has room for")
        self.alphabet, self.inverse, self.met = alphabet, inverse, []
        self.step1, self.kind1, self.part1, self.swap1, self.first1, self.second1 = _counters()
        self.slots2 = np.zeros(1 << _TABLE_BITS, np.int32)  # id, counter, check
        self.firsts, self.seconds, self.counter1 = np.zeros(alphabet, np.int32), np.zeros(alphabet, np.int32), np.zeros(alphabet, np.int64)
        self.seen = np.full(256, 4.0)
        self.share2, self.share1 = np.repeat([0.5, 1, 2, 2.5, 3, 3, 3.5, 3.5], 32) * 0.9, np.full(256, 0.4)
        self.share1[::32] = 0.01  # a context that was never met
        self.counts = np.zeros(alphabet, np.int64)
        self.prev1 = np.zeros(lanes, np.int64)
        self.id1, self.id2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.step = self.renewed = 0
        self._frequencies()
        self._weights()

    def _frequencies(self):
        if self.met:
            self.counts += np.bincount(np.concatenate(self.met), minlength=self.alphabet) * 32
            self.met = []
        room = _ONE - self.alphabet
        f = 1 + (self.counts + 1) * room // (int(self.counts.sum()) + self.alphabet)
        cum = np.zeros(self.alphabet + 1, np.int64)
        np.cumsum(f, out=cum[1:])
        f[-1] += _ONE - cum[-1]  # the last id takes what rounding leaves
        self.freq, self.cum = f.astype(np.int32), cum[:-1].astype(np.int32)
        if self.inverse:
            self.id_at = np.repeat(np.arange(self.alphabet, dtype=np.uint16 if self.alphabet <= 1 << 16 else np.int32), f)

    def _weights(self):
        scale = (_MIX - 3) / self.seen
        self.w2 = 1 + (self.share2 * scale).astype(np.int32)
        self.w1 = 1 + (self.share1 * scale).astype(np.int32)
        self.w0 = _MIX - self.w2 - self.w1

    def predict(self):
        mixed = self.id2 * np.int32(0x2545F491)
        mixed ^= self.id1
        mixed *= np.int32(0x1B873593)
        self.check = (mixed & 0xFF0) << 19
        self.at = (mixed >> 12 & ((1 << _TABLE_BITS) - 1)).astype(np.int64)
        slot = self.slots2.take(self.at)
        slot &= -((slot ^ self.check) >> 23 == 0).astype(np.int32) & 0x7FFFFF
        self.c = slot & _ID
        self.n2 = slot >> ID_BITS
        self.a, self.b, self.n1 = self.firsts.take(self.prev1), self.seconds.take(self.prev1), self.counter1.take(self.prev1)
        self.state = self.kind1.take(self.n1)
        self.state += self.n2 << 5
        w1 = self.w1.take(self.state)
        self.mass_a = w1 * self.part1.take(self.n1)
        self.mass_b = (w1 << ID_BITS) - self.mass_a
        self.mass_c = self.w2.take(self.state) << ID_BITS
        self.rest = self.w0.take(self.state)

    def interval(self, x: np.ndarray, at: np.ndarray):
        """Where the interval of each id begins and its size, the parts of it by order kept for the update. ``at`` is x as places."""
        a, b, c, rest = self.a, self.b, self.c, self.rest
        # Masks: all bits where the ids are equal or where the first is less.
        self.is_a, self.is_b, self.is_c = ((a ^ x) - 1) >> 31, ((b ^ x) - 1) >> 31, ((c ^ x) - 1) >> 31
        self.from1 = self.mass_a & self.is_a
        self.from1 += self.mass_b & self.is_b
        self.from2 = self.mass_c & self.is_c
        start = rest * self.cum.take(at)
        start += self.mass_a & (a - x) >> 31
        start += self.mass_b & (b - x) >> 31
        start += self.mass_c & (c - x) >> 31
        size = rest * self.freq.take(at)
        size += self.from1
        size += self.from2
        return start, size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the values lie."""
        a, b, c, rest = self.a, self.b, self.c, self.rest
        ma, mb, mc = self.mass_a, self.mass_b, self.mass_c
        a_b, a_c, b_c = a - b, a - c, b - c
        ab, ac, bc = (((z - 1) & ~z) >> 31 for z in (a_b, a_c, b_c))  # equal
        found, left = np.zeros_like(value), value.copy()
        x = found.copy()
        for z, mass, below, own in (
            (a, ma, (mb & -a_b >> 31) + (mc & -a_c >> 31), ma + (mb & ab) + (mc & ac)),
            (b, mb, (ma & a_b >> 31) + (mc & -b_c >> 31), mb + (ma & ab) + (mc & bc)),
            (c, mc, (ma & a_c >> 31) + (mb & b_c >> 31), mc + (ma & ac) + (mb & bc)),
        ):
            below += rest * self.cum.take(z)
            behind = value - below
            left -= mass & ~(behind >> 31)
            own += rest * self.freq.take(z)
            hit = ~(behind >> 31) & (behind - own) >> 31
            x |= z & hit
            found |= hit
        # Behind the ids that lie below, what remains is order 0's.
        left &= ~found
        others = self.id_at.take((left / rest).astype(np.int64)).astype(np.int32)
        others &= ~found
        return x | others

    def update(self, x: np.ndarray, at: np.ndarray, size: np.ndarray):
        if self.step < 64 or self.step % 4 == 0:
            unit = _SHARE / size
            self.seen += np.bincount(self.state, minlength=256)
            self.share2 += np.bincount(self.state, np.rint(self.from2 * unit), 256) * (1 / _SHARE)
            self.share1 += np.bincount(self.state, np.rint(self.from1 * unit), 256) * (1 / _SHARE)
            self._weights()
        a, b = self.a, self.b
        outcome = self.n1 + (8192 + (self.is_a & -8192) + (self.is_b & ~self.is_a & -4096))
        first = a ^ ((a ^ x) & self.first1.take(outcome))
        second = b ^ ((b ^ x) & self.second1.take(outcome))
        swap = (first ^ second) & self.swap1.take(outcome)
        self.firsts[self.prev1] = first ^ swap
        self.seconds[self.prev1] = second ^ swap
        self.counter1[self.prev1] = self.step1.take(outcome)
        n2 = self.n2
        kept = self.is_c | (1 - n2) >> 31
        slot = x ^ ((x ^ self.c) & kept)
        slot |= _STEP2.take(n2 + (self.is_c & 8))
        slot |= self.check
        self.slots2[self.at] = slot
        self.met.append(at)
        self.prev1, self.id2, self.id1 = at, self.id1, x
        self.step += 1
        if self.step - self.renewed > 3 * self.step >> 4:
            self.renewed = self.step
            self._frequencies()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """The words (16 bits) of all lanes, one lane after another, and the number of words of each."""
    lanes, steps = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(alphabet, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((lanes, 2 * steps + 8), np.uint16)
    sizes = np.zeros(lanes, np.int64)
    for x, at in zip(grid.astype(np.int32), grid):
        model.predict()
        start, size = model.interval(x, at)
        unit = width >> _U31
        low += unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        _shift_out(low, width, out, sizes)
        model.update(x, at, size)
    _flush(low, width, out, sizes)
    return out[np.arange(out.shape[1]) < sizes[:, None]], sizes


def _shift_out(low, width, out, sizes):
    one = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOTTOM))
    while len(one):
        lo, wi = low[one], width[one]
        open_ = (lo ^ (lo + wi)) >= _TOP  # too narrow, though its first word is not settled: cut it there
        wi = np.where(open_, (~lo + np.uint64(1)) & _LOW, wi)
        out[one, sizes[one]] = (lo >> _U48).astype(np.uint16)
        sizes[one] += 1
        lo, wi = lo << _U16, wi << _U16
        low[one], width[one] = lo, wi
        one = one[((lo ^ (lo + wi)) < _TOP) | (wi < _BOTTOM)]


def _flush(low, width, out, sizes):
    """The fewest words that tell a value in each lane's last interval, whatever follows them."""
    done = np.zeros(len(low), bool)
    for k in range(1, 5):
        unit = np.uint64(1) << np.uint64(64 - 16 * k)
        value = (low + unit - np.uint64(1)) // unit * unit
        fits = ~done & (value >= low) & (value - low + unit - np.uint64(1) < width) | (~done if k == 4 else False)
        one = np.flatnonzero(fits)
        for j in range(k):
            out[one, sizes[one]] = (value[one] >> np.uint64(48 - 16 * j)).astype(np.uint16)
            sizes[one] += 1
        done |= fits


def decode_block(words: np.ndarray, sizes: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    lanes, steps = _shape(n)
    model = _Model(alphabet, lanes, inverse=True)
    at = np.cumsum(sizes) - sizes
    words = np.concatenate([words.astype(np.uint64), np.zeros(8, np.uint64)])
    low, width, code = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _U16 | words[at]
        at += 1
    grid = np.empty((steps, lanes), np.int64)
    for t in range(steps):
        model.predict()
        unit = width >> _U31
        x = model.find(((code - low) // unit).astype(np.int32))
        grid[t] = x
        start, size = model.interval(x, grid[t])
        low += unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        one = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOTTOM))
        while len(one):
            lo, wi = low[one], width[one]
            wi = np.where((lo ^ (lo + wi)) >= _TOP, (~lo + np.uint64(1)) & _LOW, wi)
            code[one] = code[one] << _U16 | words[at[one]]
            at[one] += 1
            lo, wi = lo << _U16, wi << _U16
            low[one], width[one] = lo, wi
            one = one[((lo ^ (lo + wi)) < _TOP) | (wi < _BOTTOM)]
        model.update(x, grid[t], size)
    return grid.T.ravel()[:n]


# A block in a file: mark, ids, alphabet, bytes of the deflated sizes, words, crc32 of the ids (32 bits each), crc32 of sizes and words.
MARK = b"CMB2"
HEADER = np.dtype([("mark", "S4"), ("n", "<u4"), ("alphabet", "<u4"), ("table", "<u4"), ("words", "<u4"), ("ids_crc", "<u4"), ("data_crc", "<u4")])


class Corrupt(ValueError):
    """A block whose checksum or shape is wrong."""


def pack_block(ids: np.ndarray, alphabet: int) -> bytes:
    words, sizes = encode_block(ids, alphabet)
    table = zlib.compress(np.diff(sizes, prepend=0).astype("<i4").tobytes(), 6)
    data = table + words.astype("<u2").tobytes()
    head = np.array([(MARK, len(ids), alphabet, len(table), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(data))], HEADER)
    return head.tobytes() + data


def unpack_block(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at a place, and where it ends; every block is decoded by itself."""
    if len(raw) < at + HEADER.itemsize:
        raise Corrupt("header cut short")
    head = np.frombuffer(raw, HEADER, 1, at)[0]
    n, words, table = int(head["n"]), int(head["words"]), int(head["table"])
    at += HEADER.itemsize
    end = at + table + 2 * words
    data = raw[at:end]
    if head["mark"] != MARK or len(data) < end - at or zlib.crc32(data) != head["data_crc"]:
        raise Corrupt("block damaged")
    sizes = np.cumsum(np.frombuffer(zlib.decompress(data[:table]), "<i4").astype(np.int64))
    if len(sizes) != _shape(n)[0] or sizes.sum() != words:
        raise Corrupt("shape of the block")
    ids = decode_block(np.frombuffer(data, "<u2", words, table), sizes, n, int(head["alphabet"]))
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["ids_crc"]:
        raise Corrupt("ids differ from their checksum")
    return ids, end

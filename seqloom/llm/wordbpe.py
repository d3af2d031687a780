"""The word-level BPE of one worker: exact, with caches of words, and tree concatenation of long texts and long words."""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Bytes of a text and code points of a word that are encoded at once; what is longer is a tree of such leaves.
TEXT_LEAF, LEAF = 8192, 4096
#: Bytes or code points on either side of a join that are encoded again at first.
WINDOW = 64
#: Entries of each generation of the caches of pieces and of words, of which two are held: this bounds a worker's memory.
CACHE, WORDS = 200_000, 50_000
#: Bytes of texts that are encoded together; a longer text is encoded by itself.
TOGETHER = 4 << 20

#: Fixed by the vocabulary file: its pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_SPACE = rb" \t\n\r\x0b\f"
_WORDS = re.compile(rb"[^%s]+" % _SPACE)
_GIANT = re.compile(rb"[^%s]{%d,}" % (_SPACE, LEAF + 1))
#: Bytes of printable ASCII, of white space that cuts words and of Latin letters up to U+024F, and what of them is none of these
#: or is a letter whose lower case lies behind U+024F.
_LATIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC2, 0xCA)])
_FAR = [chr(c).encode() for c in range(0xA1, 0x250) if chr(c).lower() > "\u024f"]
_NOT_SIMPLE = re.compile(rb"\xc2[\x80-\xa0]|\xc4\xb0|\xc9[\x90-\xbf]|<\||" + b"|".join(b"%c[%s]" % (a, bytes(x[1] for x in _FAR if x[0] == a)) for a in sorted({x[0] for x in _FAR})))


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is one of the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Values by key in two generations: a full one becomes the old one, from which what is used comes back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self[key] = self.old.get(key) or self.make(key)
        return value


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Encoded:
    """Tokens of a stretch of text: ids and the code points [start, end) that each covers."""

    def __init__(self, ids, starts, ends):
        self.ids, self.starts, self.ends = (np.asarray(x, dtype=np.int64) for x in (ids, starts, ends))

    def slice(self, a: int, b: int | None) -> Encoded:
        return Encoded(self.ids[a:b], self.starts[a:b], self.ends[a:b])

    def __add__(self, other: Encoded) -> Encoded:
        return Encoded(*(np.concatenate(x) for x in ((self.ids, other.ids), (self.starts, other.starts), (self.ends, other.ends))))


class WordBpe:
    """Encodes as the library does, text by text; equal pieces are encoded once.

    Text is cut at ASCII white space, which the vocabulary's normalizer and pre-tokenizer drop and
    no token crosses, so words are independent. Text of plain Latin letters goes through the
    pre-tokenizer's pattern and the library's BPE model piece by piece; any other word goes through
    the whole library. A text of more than TEXT_LEAF bytes is encoded by tree concatenation of leaves cut
    anywhere, and so is, token by token, a word of more than LEAF code points.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.strings = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.plain = self._splits_words()
        # A byte's stand-in in the vocabulary: printable Latin-1 stands for itself, other bytes for 256 and up.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = sorted(set(range(256)) - set(own))
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.pattern = regex.compile(PATTERN)
        # Latin letters that need no Unicode normalisation and have simple lower case.
        self.simple = regex.compile(r"(?:[!-~¡-įı-ɏ])*").fullmatch
        # The same pattern for these letters alone, which the standard library matches faster.
        latin = "".join(map(chr, range(33, 592)))
        letters, numbers = ("".join(regex.findall(c, latin)) for c in (r"\p{L}", r"\p{N}"))
        latin_pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        self.simple_pieces = re.compile(latin_pattern).findall
        # Spaces are pieces of their own here; letters are tried first, as nothing else in the pattern begins with one.
        self.spaced_pieces = re.compile(f"[{letters}]+| |{latin_pattern}").findall
        self.joins = 0  # of texts; words are remembered, so how often theirs are joined tells nothing
        self.tokenize = t.model.tokenize
        self.pieces = _Cache(self._piece, cache)
        self.words = _Cache(self._word, WORDS)

    def _splits_words(self) -> bool:
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": PATTERN}
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )

    def _piece(self, piece: str) -> bytes:
        if piece == " ":  # parts words
            return b""
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return _packed([x.id for x in self.tokenize(mapped)])

    def _word(self, word: bytes) -> bytes:
        """The ids of a word as bytes, four each: words then join without a Python number for each id."""
        body, mark = (word[:-1], word[-1:]) if word[-1] in b".,;:!?" else (word, b"")
        if body.isalpha() and len(word) <= LEAF:  # ASCII letters and a mark: two pieces, told without the pattern
            return self.pieces[body.lower().decode()] + (self.pieces[mark.decode()] if mark else b"")
        text = word.decode()
        if len(text) > LEAF:
            return _packed(self.tree(text).ids.tolist())
        if "<|" not in text and self.simple(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def units(self, text: bytes) -> list[bytes]:
        """The ids of a text's pieces or words, whichever it is made of, one after another."""
        if not text.translate(None, _LATIN) and not _NOT_SIMPLE.search(text):
            return list(map(self.pieces.__getitem__, self.simple_pieces(text.decode().lower())))
        return list(map(self.words.__getitem__, text.split()))

    def encode(self, text: bytes, more: tuple[int, ...] = ()) -> np.ndarray:
        """Ids of a whole text in UTF-8, and ``more`` behind them."""
        if not self.plain:
            return np.array([*self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, *more], np.int32)
        if len(text) <= TEXT_LEAF:
            units = self.units(text)
        elif _GIANT.search(text):
            units = map(self.words.__getitem__, text.split())
        else:
            units = self.text_tree(text)
        return np.frombuffer(b"".join([*units, _packed(more)]), np.int32)

    def encode_all(self, texts: pa.Array, more: tuple[int, ...] = ()) -> list[np.ndarray]:
        """Ids of each of many whole texts (binary, none null), and ``more`` behind each; a word is looked up once, however often they have it."""
        if not self.plain or not len(texts) or pc.max(pc.binary_length(texts)).as_py() > TOGETHER:
            return [self.encode(t, more) for t in texts.to_pylist()]
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
        cuts = np.asarray(lists.offsets)
        words = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        ids, sizes = self._each(words.dictionary.cast(pa.binary()))
        at = np.asarray(words.indices)
        n = sizes[at]
        stops = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - stops[:-1], n) + np.arange(stops[-1])]
        ends = stops[cuts - cuts[0]][1:]
        out = np.insert(out, np.repeat(ends, len(more)), np.tile(np.array(more, np.int32), len(ends)))
        return np.split(out, ends[:-1] + len(more) * np.arange(1, len(ends)))

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, some of them empty, one word after another, and how many each has."""
        together, odd = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py(), {}
        if together.translate(None, _LATIN) or _NOT_SIMPLE.search(together) or pc.max(pc.binary_length(words)).as_py() > LEAF:
            each = words.to_pylist()
            odd = {i: self.words[w] for i, w in enumerate(each) if w.translate(None, _LATIN) or _NOT_SIMPLE.search(w) or len(w) > LEAF}
            together = b" ".join(b"" if i in odd else w for i, w in enumerate(each))
        # A space is a piece without ids, and so parts the words.
        units = list(map(self.pieces.__getitem__, self.spaced_pieces(together.decode().lower())))
        n = np.fromiter(map(len, units), np.int64, len(units)) // 4
        gaps = np.flatnonzero(n == 0)
        if len(gaps) != len(words) - 1:  # a piece of which the vocabulary has nothing
            parts = [np.frombuffer(self.words[w], np.int32) if w else np.empty(0, np.int32) for w in words.to_pylist()]
        else:
            ids = np.frombuffer(b"".join(units), np.int32)
            cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], gaps, [len(n)]])]
            if not odd:
                return ids, np.diff(cuts)
            parts = np.split(ids, cuts[1:-1])
            for i, unit in odd.items():
                parts[i] = np.frombuffer(unit, np.int32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def text_tree(self, text: bytes, leaf: int = TEXT_LEAF) -> list[bytes]:
        """Tree concatenation of a long text: its leaves are encoded by themselves, then neighbours are joined level by level."""
        simple = not text.translate(None, _LATIN) and not _NOT_SIMPLE.search(text)
        cuts = [0]
        while len(text) - cuts[-1] > leaf:
            cut = cuts[-1] + leaf
            while text[cut] & 0xC0 == 0x80:  # within a code point
                cut -= 1
            cuts.append(cut)
        cuts.append(len(text))
        # All stretches of a text are read in one way, so that units can be counted off.
        units = (lambda x: list(map(self.pieces.__getitem__, self.simple_pieces(x.decode().lower())))) if simple else (lambda x: list(map(self.words.__getitem__, x.split())))
        nodes = [(a, b, units(text[a:b])) for a, b in zip(cuts, cuts[1:])]
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes) - 1, 2):
                (lo, cut, left), (_, hi, right) = nodes[i : i + 2]
                up.append((lo, hi, self.text_join(text, lo, cut, hi, left, right, units)))
            nodes = up + nodes[len(nodes) & ~1 :]
        return nodes[0][2]

    def text_join(self, text: bytes, lo: int, cut: int, hi: int, left: list[bytes], right: list[bytes], units) -> list[bytes]:
        """The units of [lo, hi) from those of both halves.

        A window around the cut is encoded again and grown until it has a whole word that the left half
        encodes alike, and one that the right half does: from there on both are the text's own.
        """
        w = WINDOW
        while True:
            a, b = max(lo, cut - w), min(hi, cut + w)
            while a > lo and text[a] & 0xC0 == 0x80:  # within a code point
                a -= 1
            while b < hi and text[b] & 0xC0 == 0x80:
                b += 1
            words = [m.span() for m in _WORDS.finditer(text, a, b)]
            first = next((x for x in words if (x[0] > a or a == lo) and x[1] < cut), None)
            last = next((x for x in reversed(words) if x[0] > cut and (x[1] < b or b == hi)), None)
            start, end = first[0] if first else a, last[1] if last else b
            before, behind = len(left) - len(units(text[start:cut])), len(units(text[cut:end]))
            agreed = [a == lo, b == hi]
            if first:
                one = units(text[start : first[1]])
                agreed[0] = left[before : before + len(one)] == one
            if last:
                one = units(text[last[0] : end])
                agreed[1] = right[behind - len(one) : behind] == one
            if all(agreed):
                self.joins += 1
                return left[: before if first else 0] + units(text[start:end]) + right[behind if last else len(right) :]
            w *= 2

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False): this vocabulary has no decoder, so tokens are joined by spaces."""
        ids = np.asarray(ids).tolist()
        if not self.plain:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.strings.__getitem__, ids))

    def _span(self, text: str, a: int, b: int) -> Encoded:
        e = self.tokenizer.encode(text[a:b], add_special_tokens=False)
        return self._encoded(e, a)

    @staticmethod
    def _encoded(e, a: int) -> Encoded:
        o = np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2)
        return Encoded(e.ids, o[:, 0] + a, o[:, 1] + a)

    def tree(self, text: str, leaf: int = LEAF) -> Encoded:
        """Tree concatenation: leaves are encoded side by side, then neighbours are joined level by level."""
        cuts = [*range(0, len(text), leaf), len(text)]
        leaves = self.tokenizer.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        nodes = [(a, b, self._encoded(e, a)) for a, b, e in zip(cuts, cuts[1:], leaves)]
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes) - 1, 2):
                (a, cut, left), (_, b, right) = nodes[i : i + 2]
                up.append((a, b, self.join(text, a, cut, b, left, right)))
            nodes = up + nodes[len(nodes) & ~1 :]
        return nodes[0][2]

    def join(self, text: str, lo: int, cut: int, hi: int, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of [lo, hi) from those of both halves.

        A window around the cut is encoded again and grown until it shares two tokens in a row with
        the left half and two with the right. Each neighbouring pair of the result then stands in
        one of three encodings, which makes it the encoding of the whole.
        """
        w = WINDOW
        while True:
            a, b = max(lo, cut - w), min(hi, cut + w)
            mid = self._span(text, a, b)
            first = (0, 0) if a == lo else self._agree(text, left, mid, a, cut)
            last = (len(mid.ids), len(right.ids)) if b == hi else self._agree(text, mid, right, cut, b)
            if first and last and (a == lo or b == hi or first[1] <= last[0]):
                return left.slice(0, first[0]) + mid.slice(first[1], last[0]) + right.slice(last[1], None)
            w *= 2

    @staticmethod
    def _agree(text: str, x: Encoded, y: Encoded, a: int, b: int) -> tuple[int, int] | None:
        """Places in x and y from which both have the same two tokens inside (a, b), each starting at a base letter."""
        i, j = np.searchsorted(x.starts, a, "right"), np.searchsorted(y.starts, a, "right")
        while i + 2 < len(x.ids) and j + 2 < len(y.ids) and x.ends[i + 1] < b:
            if x.starts[i] < y.starts[j]:
                i += 1
            elif x.starts[i] > y.starts[j]:
                j += 1
            elif (
                (x.ids[i : i + 2] == y.ids[j : j + 2]).all()
                and (x.starts[i : i + 3] == y.starts[j : j + 3]).all()
                and (x.ends[i : i + 2] == y.ends[j : j + 2]).all()
                and x.starts[i] < x.starts[i + 1] < x.starts[i + 2]
                and all(unicodedata.combining(text[p]) == 0 for p in (x.starts[i], x.starts[i + 1]))
            ):
                return int(i), int(j)
            else:
                i, j = i + 1, j + 1
        return None


@functools.lru_cache(maxsize=2)
def word_bpe(path: str, cache: int = CACHE) -> WordBpe:
    """One encoder for each worker process and file."""
    return WordBpe(path, cache)

"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders; what remains of a text is its template. Windows
of five template tokens of the documents are hash-joined with those of the benchmark. Windows that
lie on one diagonal form an alignment; its slots must bind consistently: within a type, one value of
the item always to one value of the document. So a question is found with other numbers, names or
units put in throughout; two values of the item may get the same new one.

Each text is read in up to three ways, and each window is of one reading. WORDS has every token as it
stands, so that verbatim passages are found whatever they are made of and whatever was edited beside
them. SLOTS has placeholders, and takes a capitalised word that begins a sentence for a word; NAMES
takes it for a name. There a run of names or of numbers without a mark in it is one placeholder.

An item is found in a document if one consistent alignment covers 13 of its tokens, or four fifths
of them where the item is shorter.

Most windows of a corpus are in no benchmark, so each worker first looks them up in a bitmap of
BITMAP_BITS bits, whose size does not depend on either table; only its hits are shuffled, and the join
is exact. Items of the same words are one class, named by its smallest item_id. Of items with one
template those are reported that a document holds with their own values, else the smallest item_id.

Null and empty texts match nothing; neither do items of fewer than five tokens. Rows without an id are
not reported. Rows that repeat an id are one document. Empty tables give an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bitmap, in_bitmap, shared_dir, small_batches, stored, text_of, where_few

WINDOW = 5
#: Tokens of a window with placeholders that must be words.
LITERALS = 3
MIN_TOKENS = 13
MIN_SHARE = 0.8
#: Bits of the lookup bitmap: 4 MB on each worker.
BITMAP_BITS = 25
#: Distinct words whose canonical form a worker remembers.
CACHE = 150_000

# Words for numbers, and units that count as such after a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
UNITS = frozenset(
    "% km m cm mm mile miles foot feet ft inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces l ml litre litres liter liters"
    " second seconds minute minutes hour hours day days week weeks month months year years mph kmh dollar dollars cent cents euro euros degree degrees percent".split()
)
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
WORDS, SLOTS, NAMES = range(3)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[0-9][0-9.,:/]*[a-z%]{0,3}")
_STOP = re.compile(r"[.!?:][\"')\]»”]*$")


_STOPS, _MARKS = b".!?:", b".!?:,;"


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x, 7)


_SLOT = np.array([0, _hash("\x00number"), _hash("\x00name"), _hash("\x00unit"), 0], dtype=np.uint64)
#: Keeps the windows of WORDS apart from the others.
_APART = np.uint64(_hash("\x00words"))
_WEIGHTS = np.array([_hash(f"\x00weight{i}") | 1 for i in range(WINDOW)], dtype=np.uint64)


class Canon:
    """Canonical tokens of texts; each distinct raw token is worked out once."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.index: dict[bytes, int] = {}
        self.size = 0
        self.word = np.empty(1024, np.uint64)
        self.kind = np.empty(1024, np.int8)  # where it does not begin a sentence
        self.unit = np.empty(1024, bool)
        self.stop = np.empty(1024, bool)
        self.mark = np.empty(1024, bool)

    def add(self, raw: bytes) -> int:
        if self.size == len(self.word):
            for name in ("word", "kind", "unit", "stop", "mark"):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        i = self.index[raw] = self.size
        self.size += 1
        body = raw[:-1] if raw[-1] in _MARKS else raw
        self.mark[i] = body is not raw
        if body.isalpha():  # of ASCII letters: most words, told without a pattern
            low, titled = body.lower().decode(), len(body) > 1 and body[0] < 97 and not body.isupper()
            self.stop[i] = raw[-1] in _STOPS
            self.kind[i] = NUMBER if low in NUMBER_WORDS else NAME if titled else LITERAL
        else:
            text = raw.decode("utf-8", "replace")
            bare = self.bare(text)
            low = bare.lower()
            self.mark[i] = not text.endswith(bare) or not bare
            self.stop[i] = bool(_STOP.search(text))
            if not bare:
                self.kind[i] = NOTHING
            elif low in NUMBER_WORDS or low[0].isdigit() and _NUMBER.fullmatch(low) or "-" in low and all(x in NUMBER_WORDS for x in low.split("-")):
                self.kind[i] = NUMBER
            else:
                self.kind[i] = NAME if len(bare) > 1 and bare[0].isupper() and not bare.isupper() else LITERAL
        self.word[i] = _hash(low)
        self.unit[i] = low in UNITS
        return i

    @staticmethod
    def bare(text: str) -> str:
        return text if text == "%" else _EDGES.sub("", text)

    def readings(self, text: bytes) -> list[tuple]:
        """(reading, raw tokens, where each canonical token begins and the last ends, kinds, hashes); NAMES only where it differs."""
        raw = text.split()
        if self.size > CACHE:
            self.forget()
        get, add = self.index.get, self.add
        ids = np.fromiter((add(t) if (i := get(t)) is None else i for t in raw), np.int64, len(raw))
        kinds, first = self.kind[ids], np.ones(len(ids), dtype=bool)
        first[1:] = self.stop[ids[:-1]]
        at = np.flatnonzero(kinds != NOTHING)
        first, ids, kinds = first[at], ids[at], kinds[at]
        word, unit, open_ = self.word[ids], self.unit[ids], ~self.mark[ids[:-1]] if len(ids) else np.empty(0, bool)
        raw = [raw[i] for i in at.tolist()] if len(at) < len(raw) else raw
        n = len(raw)
        out = [(WORDS, raw, np.arange(n + 1), np.zeros(n, np.int8), word ^ _APART)]
        first &= kinds == NAME
        for reading in (SLOTS, NAMES) if first.any() else (SLOTS,):
            own = np.where(first, LITERAL, kinds) if reading == SLOTS else kinds.copy()
            after = np.zeros(n, dtype=bool)
            after[1:] = own[:-1] == NUMBER
            own[after & unit & (own == LITERAL)] = UNIT
            begins = np.ones(n + 1, dtype=bool)
            begins[1:-1] = ~(((own[1:] == NAME) | (own[1:] == NUMBER)) & (own[1:] == own[:-1]) & open_)
            cuts = np.flatnonzero(begins)
            own, named = own[cuts[:-1]], word[cuts[:-1]]
            out.append((reading, raw, cuts, own, np.where(own == LITERAL, named, _SLOT[own])))
        return out


def windows(kinds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of five tokens, and whether enough of them are words; in WORDS all are."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = np.zeros(n, np.uint64)
    words = np.zeros(n, np.int8)
    for k in range(WINDOW):
        x = (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29))) * _WEIGHTS[k]
        out = (out ^ (x >> np.uint64(32)) ^ x) * np.uint64(0x9E3779B97F4A7C15)
        words += kinds[k : k + n] == LITERAL
    return out ^ (out >> np.uint64(31)), words >= LITERALS


def _slots(raw, cuts, kinds, i: int, n: int) -> list[str | None]:
    """The value in each slot of n tokens, None where a word stands."""
    value = lambda j: " ".join(Canon.bare(t.decode("utf-8", "replace")) for t in raw[cuts[j] : cuts[j + 1]]).lower()
    return [None if kinds[j] == LITERAL else f"{kinds[j]}:{value(j)}" for j in range(i, i + n)]


_ROWS = "reading int, h bigint, pos int, slots array<string>"


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, template, total, n, reading, h, pos, slots): the windows of each class of items of the same words.

    total is its tokens, n those of the reading, template names the placeholders and words between them.
    """
    source = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), text_of(text_col).cast("binary").alias("text"))

    def work(batches):
        canon = Canon()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                read = canon.readings(text)
                words, template = (_signed(xxhash.xxh64_intdigest(read[k][4].tobytes(), 7)) for k in (WORDS, SLOTS))
                for reading, raw, cuts, kinds, hashes in read:
                    h, ok = windows(kinds, hashes)
                    out += [(item, words, template, len(raw), len(hashes), reading, _signed(int(h[i])), i, _slots(raw, cuts, kinds, i, WINDOW)) for i in np.flatnonzero(ok).tolist()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_ITEM_ARROW.names), schema=_ITEM_ARROW, preserve_index=False)

    rows = source.mapInArrow(work, f"item bigint, words bigint, template bigint, total int, n int, {_ROWS}")
    lowest = rows.groupBy("words").agg(F.min("item").alias("item"))
    return rows.join(lowest, ["words", "item"]).drop("words").distinct()


_WINDOW_ARROW = [("reading", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string()))]
_ITEM_ARROW = pa.schema([("item", pa.int64()), ("words", pa.int64()), ("template", pa.int64()), ("total", pa.int32()), ("n", pa.int32()), *_WINDOW_ARROW])
_HIT_ARROW = pa.schema([("doc_id", pa.int64()), *_WINDOW_ARROW])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hits(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, reading, h, pos, slots): windows of the documents that may be in the benchmark."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(known, BITMAP_BITS))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))

    def work(batches):
        canon, bits = Canon(), shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for reading, raw, cuts, kinds, hashes in canon.readings(text):
                    h, ok = windows(kinds, hashes)
                    ok &= in_bitmap(bits, h)
                    out += [(doc, reading, _signed(int(h[i])), i, _slots(raw, cuts, kinds, i, WINDOW)) for i in np.flatnonzero(ok).tolist()]
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=_HIT_ARROW.names), schema=_HIT_ARROW, preserve_index=False)

    return source.mapInArrow(work, f"doc_id bigint, {_ROWS}")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, n_slots, changed): each document with each class of items found in it.

    changed tells that a slot holds another value than the item's. Groups are one document with one
    item on one diagonal of two readings, so a passage that much of the corpus holds makes no large
    group, and then one document with the items of one template.
    """
    known = stored(benchmark_windows(items), f"{shared_dir(items.sparkSession)}/windows")
    found = hits(docs, known, id_col, text_col).withColumnsRenamed({"slots": "own", "pos": "at", "reading": "read"})
    pairs = found.join(known, "h").withColumn("bound", F.filter(F.arrays_zip("slots", "own"), lambda z: z["slots"].isNotNull()))
    pairs = pairs.withColumn("diagonal", F.col("at") - F.col("pos"))
    aligned = pairs.groupBy("doc_id", "item", "template", "total", "n", "read", "reading", "diagonal").agg(
        F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("bound"))).alias("bound")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + WINDOW - 1)))))
    one_way = F.size(F.array_distinct(F.transform("bound", lambda b: b["slots"]))) == F.size("bound")
    enough = F.least(F.lit(MIN_TOKENS), F.ceil(F.col("n") * MIN_SHARE))
    good = aligned.withColumn("covered", covered).where(one_way & (F.col("covered") >= enough))
    changed = F.exists("bound", lambda b: b["slots"] != b["own"])
    by_item = good.groupBy("doc_id", "template", "item").agg(
        F.min(changed).alias("changed"), F.max("total").alias("n_tokens"), F.max("covered").alias("n_covered"), F.max(F.size("bound")).alias("n_slots")
    )
    fields = ("changed", "item", "n_tokens", "n_covered", "n_slots")
    held = by_item.groupBy("doc_id", "template").agg(F.collect_list(F.when(~F.col("changed"), F.struct(*fields))).alias("same"), F.min(F.struct(*fields)).alias("low"))
    rows = held.select("doc_id", F.explode(F.when(F.size("same") > 0, F.col("same")).otherwise(F.array("low"))).alias("r"))
    return rows.select("doc_id", F.col("r.item").alias("item_id"), *(F.col(f"r.{k}").cast("long").alias(k) for k in fields[2:]), "r.changed")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents in which no item is found."""
    mine = "__bad"
    while mine in docs.columns:
        mine += "_"
    bad = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias(mine)).distinct()
    return docs.join(where_few(bad), F.col(f"`{id_col}`") == F.col(mine), "left_anti")

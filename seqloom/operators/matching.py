"""Where patterns occur in records: as a predicate, as the set found in each record, and as single hits.

A record is a row with ``rec_no``, ``id``, ``seq`` and, where there are several, ``file``, ``file_no`` and ``mate``. A
null sequence holds no pattern. Occurrences overlap; positions are zero-based bytes.

Three strategies give equal results. Few patterns: ``contains`` in generated code, without Python. More:
an automaton over all of them in an Arrow function, whose cost does not depend on their number. Pattern
tables too large for the driver: windows of each pattern length, joined by value with a shuffle.
"""

from __future__ import annotations

import functools
from collections import Counter
from operator import or_

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.bitmap import bitmap, in_bitmap
from seqloom.functions.sequence import ASCII_FOLD, ascii_lower
from seqloom.operators.patterns import MULTI, PatternList
from seqloom.session import small_batches

#: Up to this many patterns the predicate is a chain of ``contains``.
NATIVE_PATTERNS = 13
HIT = "file string, mate int, rec_no long, record_id string, file_no int, pattern string, position long"
#: Bytes of patterns that are sent to every worker; a larger table is joined.
MOST_PATTERN_BYTES = 64 << 20
#: Bits of the bitmap that windows are looked up in before they are joined: 4 MB on each worker.
BITMAP_BITS = 25


class Automaton:
    """All patterns in one automaton; equal spellings after case folding share a place."""

    def __init__(self, patterns: tuple[str, ...], fold: bool):
        self.fold = fold
        self.tree = ahocorasick.Automaton()
        keys: dict[str, list[str]] = {}
        for p in patterns:
            keys.setdefault(p.translate(ASCII_FOLD) if fold else p, []).append(p)
        for k, same in keys.items():
            self.tree.add_word(k, (len(k), tuple(same)))
        self.tree.make_automaton()

    def _text(self, seq: str) -> str:
        return seq.translate(ASCII_FOLD) if self.fold else seq

    def any(self, seq: str | None) -> bool:
        return bool(seq) and next(self.tree.iter(self._text(seq)), None) is not None

    def found(self, seq: str | None) -> list[str]:
        if not seq:
            return []
        return sorted({p for _, (_, same) in self.tree.iter(self._text(seq)) for p in same}, key=str.encode)

    def hits(self, seq: str | None) -> tuple[list[str], list[int]]:
        """Patterns and byte positions."""
        names, at = [], []
        if seq:
            for end, (n, same) in self.tree.iter(self._text(seq)):
                for p in same:
                    names.append(p)
                    at.append(end - n + 1)
            if at and not seq.isascii():
                points = np.frombuffer(seq.encode("utf-32-le"), "<u4")
                sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                at = (np.cumsum(sizes) - sizes)[at].tolist()
        return names, at


@functools.lru_cache(maxsize=4)
def automaton(patterns: tuple[str, ...], fold: bool) -> Automaton:
    return Automaton(patterns, fold)


def _shared(df: DataFrame, q: PatternList):
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast((q.patterns, q.case_insensitive))


def any_match(df: DataFrame, q: PatternList, seq: str = "seq") -> Column:
    """Whether any pattern occurs in the sequence; never null."""
    text = F.coalesce(F.col(seq), F.lit(""))
    if len(q.patterns) <= NATIVE_PATTERNS:
        if q.case_insensitive:
            folded = ascii_lower(text)
            return functools.reduce(or_, (F.contains(folded, F.lit(p.translate(ASCII_FOLD))) for p in q.patterns))
        return functools.reduce(or_, (F.contains(text, F.lit(p)) for p in q.patterns))
    shared = _shared(df, q)

    @F.pandas_udf("boolean")
    def has(s: pd.Series) -> pd.Series:
        a = automaton(*shared.value)
        return s.map(a.any)

    return has(text)


def found_set(df: DataFrame, q: PatternList, seq: str = "seq") -> Column:
    """The distinct patterns that occur in the sequence, in byte order."""
    text = F.coalesce(F.col(seq), F.lit(""))
    if len(q.patterns) <= NATIVE_PATTERNS:
        folded = ascii_lower(text) if q.case_insensitive else text
        each = [F.when(F.contains(folded, F.lit(p.translate(ASCII_FOLD) if q.case_insensitive else p)), F.lit(p)) for p in q.patterns]
        return F.array_compact(F.array(*each))
    shared = _shared(df, q)

    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        return s.map(automaton(*shared.value).found)

    return found(text)


def records_of(df: DataFrame) -> DataFrame:
    """The columns that matching needs, with a file and mate where the table has none."""
    have = set(df.columns)
    return df.select(
        (F.col("file") if "file" in have else F.lit("")).alias("file"),
        (F.col("mate") if "mate" in have else F.lit(1)).cast("int").alias("mate"),
        F.col("rec_no").cast("long").alias("rec_no"),
        F.col("id").cast("string").alias("record_id"),
        (F.col("file_no") if "file_no" in have else F.lit(0)).cast("int").alias("file_no"),
        "seq",
    )


_ARROW = pa.schema([("file", pa.string()), ("mate", pa.int32()), ("rec_no", pa.int64()), ("record_id", pa.string()), ("file_no", pa.int32()), ("pattern", pa.string()), ("position", pa.int64())])
#: Hits of an Arrow batch that is sent on.
_BATCH = 50_000


def hits(df: DataFrame, q: PatternList) -> DataFrame:
    """One row for each occurrence of each pattern; records without one do not leave the worker."""
    shared = _shared(df, q)

    def work(batches):
        a = automaton(*shared.value)
        for batch in batches:
            rows, patterns, positions = [], [], []
            for i, seq in enumerate(batch.column("seq").to_pylist()):
                names, at = a.hits(seq)
                rows += [i] * len(at)
                patterns += names
                positions += at
                if len(rows) >= _BATCH:
                    yield _hit_batch(batch, rows, patterns, positions)
                    rows, patterns, positions = [], [], []
            if rows:
                yield _hit_batch(batch, rows, patterns, positions)

    return records_of(df).mapInArrow(work, HIT)


def _hit_batch(batch, rows, patterns, positions):
    of = batch.select(["file", "mate", "rec_no", "record_id", "file_no"]).take(pa.array(rows, pa.int32()))
    return pa.RecordBatch.from_arrays([*of.columns, pa.array(patterns, pa.string()), pa.array(positions, pa.int64())], schema=_ARROW)


def _hashes(windows: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, windows), np.uint64, len(windows))


def hits_by_join(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """:func:`hits` for a table of patterns of any size: windows of each pattern length meet the patterns in a shuffled join.

    Only the distinct lengths come to the driver, and a bitmap of the patterns' hashes, of fixed size, which
    keeps most windows that are no pattern in the workers. A frequent window meets a pattern once, and AQE
    splits its partition.
    """
    small_batches(df.sparkSession)
    patterns = patterns.where("pattern <> ''").select("pattern").distinct()

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column("pattern").to_pylist()).view(np.int64))], names=["h"])

    bits = df.sparkSession.sparkContext.broadcast(bitmap(patterns.mapInArrow(hashed, "h long"), BITMAP_BITS))
    sizes = sorted(r.n for r in patterns.where("pattern <> ''").select(F.length("pattern").alias("n")).distinct().collect())

    def work(batches):
        for batch in batches:
            rows, windows, at = [], [], []
            for i, seq in enumerate(batch.column("seq").to_pylist()):
                seq = seq or ""
                points = np.frombuffer(seq.encode("utf-32-le"), "<u4")
                starts = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)) if len(points) else points
                starts = np.concatenate([[0], starts]).astype(np.int64)
                for k in sizes:
                    n = max(len(seq) - k + 1, 0)
                    for a in range(0, n, _BATCH):
                        b = min(a + _BATCH, n)
                        some = [seq[j : j + k] for j in range(a, b)]
                        known = np.flatnonzero(in_bitmap(bits.value, _hashes(some)))
                        rows += [i] * len(known)
                        windows += [some[j] for j in known.tolist()]
                        at += starts[known + a].tolist()
                        if len(rows) >= _BATCH:
                            yield _hit_batch(batch, rows, windows, at)
                            rows, windows, at = [], [], []
            if rows:
                yield _hit_batch(batch, rows, windows, at)

    return records_of(df).mapInArrow(work, HIT).join(patterns, "pattern").select(*_ARROW.names)


def tallies(df: DataFrame, q: PatternList) -> DataFrame:
    """(chars, found): for each record its bytes, and an array of the patterns in it with their occurrences; nothing else leaves the worker."""
    shared = _shared(df, q)

    def work(batches):
        a = automaton(*shared.value)
        for batch in batches:
            sizes, names, counts = [0], [], []
            for seq in batch.column("seq").to_pylist():
                one = Counter(a.hits(seq)[0]) if seq else {}
                names += one
                counts += one.values()
                sizes.append(len(names))
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["pattern", "n"])
            yield pa.RecordBatch.from_arrays([batch.column("chars"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], names=["chars", "found"])

    return df.select(F.coalesce(F.octet_length("seq"), F.lit(0)).cast("long").alias("chars"), "seq").mapInArrow(work, "chars long, found array<struct<pattern:string,n:long>>")


def hits_of_table(df: DataFrame, patterns: DataFrame, most: int = MOST_PATTERN_BYTES) -> DataFrame:
    """:func:`hits` for a table of patterns: sent to the workers where its size allows, else joined. One pass over the table tells."""
    distinct = patterns.where("pattern <> ''").select("pattern").distinct()
    if (distinct.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) > most:
        return hits_by_join(df, distinct)
    found = sorted((r.pattern for r in distinct.collect()), key=str.encode)
    return hits(df, PatternList(tuple(found), MULTI)) if found else hits_by_join(df, distinct)


def in_report_order(found: DataFrame, q: PatternList) -> DataFrame:
    """Hits with ``hit_no`` columns that sort them as reports list them.

    Single-pattern search: by record, pattern, mate, position. Multi-pattern search: by record, mate,
    end of the match, and longest first.
    """
    if q.counting == "record":
        return found.orderBy("file_no", "rec_no", "pattern", "mate", "position")
    end = F.col("position") + F.octet_length("pattern")
    return found.orderBy("file_no", "rec_no", "mate", end, F.octet_length("pattern").desc(), "pattern")

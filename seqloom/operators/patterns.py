"""The query list: reading, case, strand, order and the choice of a search."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import canonical, reverse_complement, reverse_complement_text

#: From this many patterns on, or beyond this many bytes, the multi-pattern search is chosen.
MANY_PATTERNS, LONG_PATTERN = 14, 64
OCCURRENCE, RECORD = "occurrence", "record"
MULTI, SINGLE = "Aho-Corasick", "BNDMq"


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class PatternList:
    """Distinct, non-empty patterns in byte order, and how they are searched and counted.

    counting is "occurrence" (each occurrence counts) for the multi-pattern search and "record" (each
    record counts once for a pattern) for single-pattern search: the two have always counted differently.
    """

    patterns: tuple[str, ...]
    algorithm: str
    case_insensitive: bool = False

    @property
    def counting(self) -> str:
        return OCCURRENCE if self.algorithm == MULTI else RECORD

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p,) for p in self.patterns], "pattern string")


def parse_pattern_text(text: str) -> list[str]:
    """Patterns of a plain list or FASTA: a line each; comment and header lines are told before lines are trimmed."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    out = [x.strip() for x in lines if x and x[0] not in "#>"]
    if not out:
        raise PatternError("the pattern file has no patterns")
    return out


def read_pattern_file(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return parse_pattern_text(f.read())


def prepare(
    sequences: Iterable[str] | None = None, file: str | None = None, *, reverse_complement: bool = False, canonical: bool = False, lowercase: bool = False, uppercase: bool = False,
) -> list[str]:
    """The query list in its fixed order of steps: case, strand, non-empty, order, distinct."""
    if file is None and sequences is None:
        raise PatternError("give patterns or a pattern file")
    found = read_pattern_file(file) if file is not None else list(sequences)
    if lowercase:
        found = [p.lower() for p in found]
    elif uppercase:
        found = [p.upper() for p in found]
    if (reverse_complement or canonical) and not all(p.isascii() for p in found):
        raise PatternError("strand options need ASCII patterns")
    if reverse_complement:
        found += [reverse_complement_text(p) for p in found]
    if canonical:
        found = [min(p, reverse_complement_text(p)) for p in found]
    found = sorted({p for p in found if p}, key=str.encode)
    if not found:
        raise PatternError("no patterns are left to search for")
    return found


def prepare_frame(patterns: DataFrame, *, both_strands: bool = False, one_strand: bool = False, lowercase: bool = False, uppercase: bool = False) -> DataFrame:
    """:func:`prepare` over a table of patterns, for lists that do not fit the driver."""
    p = F.lower("pattern") if lowercase else F.upper("pattern") if uppercase else F.col("pattern")
    out = patterns.select(p.alias("pattern"))
    if both_strands:
        out = out.unionByName(out.select(reverse_complement(F.col("pattern")).alias("pattern")))
    if one_strand:
        out = out.select(canonical(F.col("pattern")).alias("pattern"))
    return out.where("pattern <> ''").distinct()


def byte_length(pattern: str) -> int:
    return len(pattern.encode())


def tune_q(pattern: str) -> int:
    """The window of the single-pattern search by pattern length; patterns of 65 bytes and more have none."""
    n = byte_length(pattern)
    for most, q in ((1, 1), (3, 2), (8, 3), (30, 4), (55, 5), (64, 6)):
        if n <= most:
            return q
    raise PatternError("the single-pattern search takes patterns of up to 64 bytes")


def recommends_multi(patterns: list[str]) -> bool:
    if not patterns:
        raise PatternError("no patterns")
    return len(patterns) >= MANY_PATTERNS or max(map(byte_length, patterns)) > LONG_PATTERN


def plan(patterns: list[str], *, q_size: int | None = None, force_multi: bool = False, case_insensitive: bool = False) -> PatternList:
    """Choose the search, which also fixes how hits are counted; case folding needs the multi-pattern one."""
    multi = case_insensitive or force_multi or (q_size is None and recommends_multi(patterns))
    if not multi:
        for p in patterns:
            if byte_length(p) > LONG_PATTERN:
                raise PatternError("the single-pattern search takes patterns of up to 64 bytes")
            if q_size is not None and not 1 <= q_size <= byte_length(p):
                raise PatternError("q must be at least 1 and no longer than a pattern")
    return PatternList(tuple(patterns), MULTI if multi else SINGLE, case_insensitive)

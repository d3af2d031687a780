"""Column functions for sequences: strand, case and byte lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nucleotide codes and their complements; other characters are their own.
CODES = "ACGTRYKMBVDHSWNU"
COMPLEMENTS = "TGCAYRMKVBHDSWNA"
_FROM = CODES + CODES.lower()
_TO = COMPLEMENTS + COMPLEMENTS.lower()
_TABLE = str.maketrans(_FROM, _TO)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_FOLD = str.maketrans(_UPPER, _UPPER.lower())


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, _FROM, _TO))


def canonical(c: Column) -> Column:
    """The lesser, in byte order, of a sequence and its reverse complement."""
    return F.least(c, reverse_complement(c))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only; :func:`pyspark.sql.functions.lower` would fold all of Unicode."""
    return F.translate(c, _UPPER, _UPPER.lower())


def reverse_complement_text(s: str) -> str:
    return s.translate(_TABLE)[::-1]

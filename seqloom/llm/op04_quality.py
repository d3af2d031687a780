"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit for
each rule. A policy is a versioned mask over those bits, so a new policy, or the effect of leaving a
rule out, needs no second look at the texts.

A null text counts as empty: it has no words and fails MIN_WORDS. Repeated rows get a row each, an
empty table an empty ledger. Only the named columns are read, so others may have any name; carried
columns called measures or fail_bits are returned as measures_ and fail_bits_. A very long text is measured
whole, in time proportional to its length but for a sort of its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqloom.llm.common import small_batches, text_of

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_exclaims", "n_letters", "n_capitals", "longest_word",
)

#: Name, then the condition on the measurements under which a document fails. All in integers.
RULES: tuple[tuple[str, str], ...] = (
    ("min_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("exclaims", "5 * n_exclaims > n_words"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("few_letters", "100 * n_letters < 40 * word_chars"),
    ("giant_word", "longest_word > 1000"),
    ("max_words", "n_words > 100000"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it applies. A document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("min_words", "repeat_words"))
#: The production policy: neither length of a text nor of its longest word is a fault.
V1 = Policy("v1", ("min_words", "repeat_words", "symbols", "exclaims", "capitals", "dup_lines", "short_words", "long_words", "few_letters"))

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text in UTF-8. Words are runs without ASCII white space."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    solid = text.translate(None, _SPACE)
    chars = solid.decode()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    if chars.isascii():
        letters = len(solid) - len(solid.translate(None, _LETTERS))
        capitals = len(solid) - len(solid.translate(None, _CAPITALS))
        longest = max(map(len, words))
    else:
        letters = sum(map(str.isalpha, chars))
        capitals = sum(map(str.isupper, chars))
        longest = max(map(len, text.decode().translate(_TO_SPACE).split(" ")))
    return (
        n, len(chars), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(words),
        len(lines), text.count(b"!"), letters, capitals, longest,
    )


_TO_SPACE = {c: " " for c in _SPACE}
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def _repeated(words: list[bytes]) -> int:
    """Words inside a three-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # three factors of v would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def ledger(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, a struct ``measures`` and ``fail_bits``, one row per document.

    One pass without a shuffle. The rules are SQL over the measurements, so a rule can be added
    without touching the measuring code.
    """
    small_batches(df.sparkSession)
    own = [c + "_" * (c in ("measures", "fail_bits")) for c in carry]
    source = df.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, own))).alias("row"), text_of(text_col).cast("binary").alias("text"))
    schema = StructType([source.schema["row"], StructField("measures", StructType([StructField(m, LongType()) for m in MEASURES]))])

    def work(batches):
        for batch in batches:
            found = np.array([measure(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(MEASURES))], names=list(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), struct], names=["row", "measures"])

    measured = source.mapInArrow(work, schema)
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        for m in sorted(MEASURES, key=len, reverse=True):
            rule = rule.replace(m, f"measures.`{m}`") if f"`{m}`" not in rule else rule
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.select("row.*", "measures", bits.alias("fail_bits"))


def kept(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    """Whether a document passes a policy: one bitwise operation on its ledger row."""
    col = F.col(bits) if isinstance(bits, str) else bits
    return col.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that remain without it.

    One aggregation with partial sums over the ledger's bits; the texts are not read again.
    """
    mask = F.lit(policy.mask).cast("long")
    own = F.col("fail_bits").bitwiseAND(mask)
    sums = [F.count(F.lit(1)).alias("n_docs"), F.sum((own == 0).cast("long")).alias("n_kept")]
    for r in policy.rules:
        bit = F.lit(BIT[r]).cast("long")
        sums += [F.sum((own.bitwiseAND(bit) != 0).cast("long")).alias(f"f_{r}"), F.sum((own == bit).cast("long")).alias(f"o_{r}")]
    one = rows.agg(*sums)
    parts = [F.struct(F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{r}", F.lit(0)).alias("n_failed_only"), F.coalesce(F.col("n_kept") + F.col(f"o_{r}"), F.lit(0)).alias("n_kept_without")) for r in policy.rules]
    return one.select(F.inline(F.array(*parts)))


def verdicts(rows: DataFrame, policy: Policy = V1) -> DataFrame:
    """The ledger with its measurements as columns, base_failed and kept under a policy."""
    return rows.select(
        "doc_id", *(F.col(f"measures.{m}").alias(m) for m in MEASURES), "fail_bits",
        (~kept(BASE)).alias("base_failed"), (kept(BASE) & kept(policy)).alias("kept"),
    )

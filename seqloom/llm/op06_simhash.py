"""SimHash near-duplicates through a segment-popcount embedding and a grid range-join.

A fingerprint of 64 bits is cut into 32 segments of two bits. The vector of their bit counts, each 0
to 2, embeds it so that the Manhattan distance of two vectors is at most the Hamming distance of the
fingerprints. Three differing bits therefore move at most three of six groups of segments, and two
linked fingerprints share the cell of at least three whole groups: one of 20 grids. Pairs that meet
in a cell are first held against the Manhattan distance, then verified on the fingerprints.

Equal fingerprints are one point of the grid, however many documents carry them. Cells that hold
very many points are cut further by three of six parts of their other groups, which is exact for the
same reason.

A null or empty text has fingerprint zero, linked like any other. Rows without an id get their
fingerprint and no component. Rows that repeat an id are one document and share its component. An
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, shared_dir, small_batches, stored, text_of
from seqloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Points of a cell above which it is cut further.
CROWDED = 64

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8, as a signed 64-bit integer; words are runs without ASCII white space."""
    words = text.lower().split()  # of bytes: only A-Z change
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    n, out = len(hashes), 0
    for k in range(8):
        counts = np.bincount(columns[:, k], minlength=256) @ _BITS if n > 64 else _BITS[columns[:, k]].sum(axis=0)
        for j in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * k + j)
    return out - (1 << 64) if out >> 63 else out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, fp long), one row per row; one pass without a shuffle."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))

    def work(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return source.mapInArrow(work, "doc_id bigint, fp bigint")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments in unary (0: 00, 1: 01, 2: 11), so that the Hamming distance of two is their Manhattan distance."""
    low = F.lit(0x5555555555555555).cast("long")
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _masks(bits: list[int], parts: int) -> list[int]:
    """The bits in as many parts of whole segments, as signed masks."""
    cuts = np.array_split(np.array(bits).reshape(-1, 2), parts)
    return [_signed(sum(1 << int(b) for b in part.ravel())) for part in cuts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_GROUPS = _masks(list(range(64)), 6)
#: A grid for each choice of three groups: the mask of the coordinates that its cells fix.
GRIDS = [_signed(sum(m % (1 << 64) for m in c)) for c in combinations(_GROUPS, 3)]


def _rest(grid: int) -> list[int]:
    """Masks that cut what a grid leaves open: three of six parts each."""
    bits = [b for b in range(64) if not (grid % (1 << 64)) >> b & 1]
    return [_signed(sum(m % (1 << 64) for m in c)) for c in combinations(_masks(bits, 6), 3)]


def _first_shared(differ: Column, grids: list[int], at: Column) -> Column:
    """Whether ``at`` numbers the first of the grids in which two points share a cell: so a pair is met once."""
    out = F.lit(True)
    for i, g in enumerate(grids):
        out = out & ((at <= i) | (differ.bitwiseAND(F.lit(g).cast("long")) != 0))
    return out


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) for every pair of points (node, fp) whose fingerprints differ in 1 to max_bits bits, met once.

    max_bits is at most 3, the number that the grids are laid out for.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grids hold for up to three differing bits")
    cells = F.array(*(F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(g).cast("long")).alias("cell")) for i, g in enumerate(GRIDS)))
    placed = points.withColumn("e", embedding(F.col("fp"))).select("node", "fp", "e", F.explode(cells).alias("c")).select("node", "fp", "e", "c.*")
    crowded = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("grid", "cell", F.lit(True).alias("crowded"))
    placed = placed.join(crowded, ["grid", "cell"], "left")
    # Sparse cells have one part, of all; crowded ones have a part for each choice of three of six.
    rests = F.array(*(F.array(*(F.lit(m).cast("long") for m in _rest(g))) for g in GRIDS))
    parts = F.when(F.col("crowded"), F.transform(F.get(rests, F.col("grid")), lambda m, i: F.struct(i.alias("part"), F.col("e").bitwiseAND(m).alias("sub"))))
    one = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub")))
    placed = placed.withColumn("p", F.explode(F.coalesce(parts, one))).select("node", "fp", "e", "grid", "cell", F.col("p.part").alias("part"), F.col("p.sub").alias("sub"))
    a, b = placed.alias("a"), placed.alias("b")
    differ = F.col("a.e").bitwiseXOR(F.col("b.e"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("grid", "cell", "part", "sub")]
    near = (
        (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(differ) <= max_bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
        & _first_shared(differ, GRIDS, F.col("a.grid"))
    )
    on = same[0] & same[1] & same[2] & same[3] & near
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): documents that a chain of links joins share the smallest doc_id among them."""
    spark = df.sparkSession
    prints = stored(fingerprints(df, id_col, text_col, shingle), f"{shared_dir(spark)}/fingerprints")
    points = checkpoint(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    members = connected_components(links(points, max_bits))
    named = points.join(members, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(df: DataFrame, **kw) -> DataFrame:
    """The ids that stay when one document of each group does."""
    return near_duplicates(df, **kw).where("doc_id = component_id").select("doc_id").distinct()


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

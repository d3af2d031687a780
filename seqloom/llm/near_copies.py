"""Near copies by their sets of five-word shingles: every pair with a Jaccard similarity of 0.8 or more.

The search is exact. Two sets that similar share one of the first n - ceil(0.8 n) + 1 shingles of each
in any one order of all shingles (the prefix). The order taken puts rare shingles first, by a table of
2^SKETCH_BITS counters of fixed size, so that common lines are in few prefixes. Documents that share a
shingle of their prefixes are a cell, and each candidate pair is held against both whole sets.

Most shingles of prefixes are in one set only. Which are in two is told by sorted arrays of their hashes,
a few bytes each; a bitmap of fixed size then keeps the others in the tasks, so that neither texts nor
prefixes are shuffled. Where the bitmap is full, more rows are shuffled and the result is the same.

Equal sets are one point, however many documents have them. Each point is first compared with its leaders:
those that a cheaper search proposes (``hints``) and the smallest of all its cells. Then the points of
cells that are not one component by that are compared with each cell's smallest, and only cells that
still are not are compared pair by pair.

Of the shingles that two sets share, the first in the order taken leaves no fewer behind it in either than they
must share, so cells tell pairs apart by its places. Sets differ in no fewer hashes than their marks in bits, the
parities of how many hashes begin alike: the join of the last step tells pairs apart by that before it makes a row.
Before whole sets move, a pair is held against how many of each set's hashes fall into each of some n / 2
bins: two sets share no more than the sum of the lesser numbers, which tells most unlike pairs apart.

Words are runs without ASCII white space, A-Z in lower case; a text under five words is one shingle.
Null and empty texts have the empty set, equal to each other. Rows without an id have no component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bitmap, checkpoint, in_bitmap, shared_dir, small_batches, stored, text_of, where_few
from seqloom.llm.components import connected_components
from seqloom.llm.op07_lm import pack, unpack

SHINGLE = 5
#: The least similarity as a fraction, so that all comparisons are of integers.
NUMERATOR, DENOMINATOR = 4, 5
SKETCH_BITS = 22
#: Parts in which tasks send their counters.
PARTS = 64
#: Distinct words whose hash a worker remembers.
CACHE = 100_000
#: Bits of the bitmaps of shared shingles and of documents to verify.
SHARED_BITS, USED_BITS = 27, 25
#: Bits of a hash that tell whether a shingle is shared.
SENT_BITS = 40
#: Numbers of 64 bits that a set's marks are.
MARKS = 8
#: Prefix shingles that a task sorts before it sends them on, and that a task merges; bytes of text for each.
FLUSH, SHARD, PER_SHINGLE = 1_000_000, 2_000_000, 30

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingles:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        """The distinct hashes of a text's shingles, in order."""
        words = text.lower().split()  # of bytes: only A-Z change
        if not words:
            return np.empty(0, _U)
        if len(self.known) > CACHE:
            self.known.clear()
        self.known.update((w, xxhash.xxh64_intdigest(w, 5)) for w in set(words).difference(self.known))
        h = np.fromiter(map(self.known.__getitem__, words), _U, len(words))
        n = max(len(h) - SHINGLE + 1, 1)
        out = np.zeros(n, _U)
        for k in range(min(SHINGLE, len(h))):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def prefix(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The shingles of which a set shares one with every set that is similar enough, rare ones first."""
    n = len(shingles)
    if not n:
        return shingles
    need = -(-n * NUMERATOR // DENOMINATOR)
    rare = np.argsort(sketch[shingles >> _U(64 - SKETCH_BITS)], kind="stable")
    return shingles[rare[: n - need + 1]]


def bins(shingles: np.ndarray) -> bytes | None:
    """How many hashes fall into each of 2^k equal ranges, about two in one; None if one has more than a byte holds."""
    k = max(len(shingles).bit_length() - 2, 0)
    counts = np.bincount((shingles >> _U(63 - k) >> _U(1)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def at_most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of the hashes that two sets share, from their bins."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.uint32) for c in (a, b))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(axis=1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(x, y).sum())


def marks(shingles: np.ndarray) -> np.ndarray:
    """For each beginning of hashes whether an odd number of them has it; two sets differ in as many hashes as their marks in bits, or more."""
    odd = np.bincount((shingles >> _U(65 - (64 * MARKS).bit_length())).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketch(source: DataFrame) -> np.ndarray:
    """How often shingles occur in documents, by the first bits of their hash, on a logarithmic scale."""

    def count(batches):
        grams, counts = Shingles(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, grams.of(text) >> _U(64 - SKETCH_BITS), 1)
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            for i, x in enumerate(np.split(counts, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(x.tobytes())], pa.binary())], names=["part", "blob"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // PARTS, np.int64)
        for b in rows["blob"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint32)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "blob": [np.round(4 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    out = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint8)
    schema = "part int, blob binary"
    for r in source.select("text").mapInArrow(count, schema).groupBy("part").applyInPandas(add, schema).collect():
        out[r.part] = np.frombuffer(r.blob, np.uint8)
    return out.ravel()


def _sets(source: DataFrame, sketch=None, wanted=None) -> DataFrame:
    """(doc_id, sig, n, shingles, bins, marks): the set of each row, or its prefix, bins and marks where a sketch is given; sig names the whole set.

    Where a bitmap of wanted documents is given, others are passed over.
    """

    def work(batches):
        grams = Shingles()
        for batch in batches:
            if wanted is not None:
                batch = batch.take(pa.array(np.flatnonzero(in_bitmap(wanted.value, _mix(np.asarray(batch.column("doc_id")).view(_U))))))
            sets = [grams.of(t) for t in batch.column("text").to_pylist()]
            sigs = np.array([xxhash.xxh64_intdigest(s.tobytes(), 3) for s in sets], _U).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            counts, odd = pa.nulls(len(sets), pa.binary()), pa.nulls(len(sets), pa.list_(pa.int64()))
            if sketch is not None:
                counts = pa.array([bins(s) for s in sets], pa.binary())
                odd = pa.array([marks(s) for s in sets], pa.list_(pa.int64()))
                sets = [prefix(s, sketch.value) for s in sets]
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigs), pa.array(sizes), lists, counts, odd], names=["doc_id", "sig", "n", "shingles", "bins", "marks"])

    return source.mapInArrow(work, "doc_id bigint, sig bigint, n bigint, shingles array<bigint>, bins binary, marks array<bigint>")


def _shared(prints: DataFrame, parts: int, home: str) -> DataFrame:
    """(h): the first SENT_BITS bits of shingles that are in the prefixes of two different sets or more, the rest of them zero.

    Of two shingles that begin alike some may be told as shared that are not, never the other way round.
    """

    def deal(batches):
        held, n = [], 0
        for batch in batches:
            for sig, shingles in zip(batch.column("sig").to_pylist(), batch.column("shingles")):
                s = np.asarray(shingles.values).view(_U) >> _U(64 - SENT_BITS)
                held.append((s, np.full(len(s), sig & 0xFFFFFFFF, _U)))
                n += len(s)
                if n >= FLUSH:
                    yield from blobs(held)
                    held, n = [], 0
        if n:
            yield from blobs(held)

    def blobs(held):
        s, sig = (np.concatenate(x) for x in zip(*held))
        part = (_mix(s) % _U(parts)).astype(np.int64)
        order = np.lexsort((s, part))
        s, sig, part = s[order], sig[order], part[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        rows = [(int(part[a]), pack(s[a:b], sig[a:b])) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

    def merge(batches):
        part, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part and held:
                    yield twice(held)
                    held = []
                part = r["part"]
                held.append(unpack(r["blob"], 2))
        if held:
            yield twice(held)

    def twice(held):
        s, sig = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(s, kind="stable")
        s, sig = s[order], sig[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        two = np.minimum.reduceat(sig, starts) != np.maximum.reduceat(sig, starts)
        return pa.RecordBatch.from_arrays([pa.array((s[starts[two]] << _U(64 - SENT_BITS)).view(np.int64))], names=["h"])

    dealt = prints.select("sig", "shingles").mapInArrow(deal, "part int, blob binary")
    return stored(dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(merge, "h bigint"), home)


def _kept(prints: DataFrame, bits) -> DataFrame:
    """(doc_id, sig, n, shingles, places): prefixes cut to the shingles in a bitmap, with the places that these had, where any are left."""

    def work(batches):
        for batch in batches:
            lists = batch.column("shingles")
            flat = np.asarray(lists.values).view(_U)
            keep = in_bitmap(bits.value, flat)
            starts = np.asarray(lists.offsets)
            places = np.arange(starts[0], starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
            ends = np.concatenate([[0], np.cumsum(keep)])[starts]
            some = np.flatnonzero(np.diff(ends))
            if len(some):
                rows = pa.array(some)
                left = keep[starts[0] : starts[-1]]
                cuts = [pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(x)) for x in (flat[starts[0] : starts[-1]][left].view(np.int64), places[left].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "sig", "n")), *(c.take(rows) for c in cuts)], names=["doc_id", "sig", "n", "shingles", "places"])

    return prints.select("doc_id", "sig", "n", "shingles").mapInArrow(work, "doc_id bigint, sig bigint, n bigint, shingles array<bigint>, places array<bigint>")


def _sets_of(source: DataFrame, used: DataFrame) -> DataFrame:
    """(doc_id, sig, n, shingles) of the whole sets of at least the used documents; texts stay where they are."""
    bits = source.sparkSession.sparkContext.broadcast(bitmap(used.select(F.col("doc_id").alias("h")), USED_BITS, _mix))
    return _sets(source, wanted=bits)


def _likely(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): pairs whose sizes and bins do not tell them apart."""
    pairs = checkpoint(pairs)
    met = where_few(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    points = checkpoint(points.select("node", "n", "bins").join(met, "node", "left_semi"))
    sides = [points.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab"]

    def work(batches):
        for batch in batches:
            x, y, n = batch.column("bins_a").to_pylist(), batch.column("bins_b").to_pylist(), np.asarray(batch.column("n"))
            keep = [i for i in range(len(n)) if x[i] is None or y[i] is None or at_most_shared(x[i], y[i]) * (NUMERATOR + DENOMINATOR) >= n[i] * NUMERATOR]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], names=["a", "b"])

    both = pairs.join(sides[0], "a").join(sides[1], "b").where(_sizes(F.col("na"), F.col("nb")))
    return both.select("a", "b", "bins_a", "bins_b", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(work, "a bigint, b bigint")


def _verified(pairs: DataFrame, points: DataFrame, source: DataFrame, home: str) -> DataFrame:
    """(a, b): the nodes of those pairs (a, b) that are similar enough."""
    pairs = checkpoint(_likely(pairs.select("a", "b").distinct(), points))
    used = checkpoint(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = stored(_sets_of(source, used).join(used, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "shingles"), home)
    both = pairs.join(sets.toDF("a", "na", "x"), "a").join(sets.toDF("b", "nb", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return checkpoint(both.where(common * (NUMERATOR + DENOMINATOR) >= (F.col("na") + F.col("nb")) * NUMERATOR).select("a", "b"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hints: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): documents that a chain of similar or given pairs joins share the smallest doc_id among them.

    hints has pairs of documents (a, b) that are worth a look first; they change the work, not the result. given has
    pairs that another search has joined: they hold whatever their sets, and what they join is not compared again.
    """
    spark = df.sparkSession
    small_batches(spark)
    home = shared_dir(spark)
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = spark.sparkContext.broadcast(_sketch(source))
    prints = stored(_sets(source, sketch), f"{home}/prefixes")
    points = stored(prints.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("marks").alias("marks")), f"{home}/points")
    shared = _shared(prints, 1 + size // (PER_SHINGLE * SHARD), f"{home}/shared")
    bits = spark.sparkContext.broadcast(bitmap(shared, SHARED_BITS))
    own = _kept(prints, bits).withColumnRenamed("doc_id", "node").join(points.select("sig", "node"), ["sig", "node"], "left_semi").dropDuplicates(["sig"])
    rows = own.select("node", "n", F.explode(F.arrays_zip("shingles", "places")).alias("x"))
    rows = stored(rows.select("node", "n", F.col("x.shingles").alias("s"), F.col("x.places").alias("i")), f"{home}/rows")
    first = F.min(F.struct("node", "n", "i"))
    cells = rows.groupBy("s").agg(first.alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    cells = stored(rows.join(cells, "s"), f"{home}/cells")
    under = cells.where((F.col("node") != F.col("low.node")) & _first_shared("", "low."))
    led = under.groupBy("node").agg(F.min("low.node").alias("a")).select("a", F.col("node").alias("b"))
    named = prints.select("doc_id", "sig").join(points.select("sig", "node"), "sig").select("doc_id", "node")

    def of_points(pairs):
        both = pairs.join(named.toDF("a", "na"), "a").join(named.toDF("b", "nb"), "b").where("na <> nb")
        return both.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()

    if hints is not None:
        led = led.union(of_points(hints))
    if given is not None:
        given = checkpoint(of_points(given))
        at = where_few(connected_components(given))
        sides = [at.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
        led = led.join(sides[0], "a", "left").join(sides[1], "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
    links = _verified(led, points, source, f"{home}/led")
    links = links if given is None else checkpoint(links.union(given))
    mixed = _mixed(cells, links, f"{home}/mixed")
    # The points of a cell with its smallest, one point of each component that the cell holds.
    one = mixed.where((F.col("node") != F.col("low.node")) & _first_shared("", "low.") & (F.col("c") != F.col("low_c")))
    again = one.select(F.col("low.node").alias("a"), F.col("node").alias("b"))
    links = checkpoint(links.union(_verified(again, points, source, f"{home}/again")))
    placed = _mixed(mixed.drop("c", "low_c"), links, f"{home}/rest").select("s", "node", "n", "i", "c")
    placed = placed.join(points.select("node", *(F.get("marks", F.lit(k)).alias(f"m{k}") for k in range(MARKS))), "node")
    a, b = placed.alias("a"), placed.alias("b")
    differ = sum((F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(1, MARKS)), F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))))
    like = differ * (NUMERATOR + DENOMINATOR) <= (F.col("a.n") + F.col("b.n")) * (DENOMINATOR - NUMERATOR)
    near = (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.c") != F.col("b.c")) & _first_shared("a.", "b.") & like
    rest = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    members = connected_components(links.union(_verified(rest, points, source, f"{home}/pairs")))
    named = points.select("sig", "node").join(members, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", "sig").join(named, "sig").select("doc_id", "component_id")


def _mixed(cells: DataFrame, links: DataFrame, home: str) -> DataFrame:
    """The rows of cells that hold points of several components, with the component of each and of the cell's smallest."""
    parts = where_few(connected_components(links))
    placed = cells.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    cell = placed.groupBy("s").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.max(F.when(F.col("node") == F.col("low.node"), F.col("c"))).alias("low_c"))
    return stored(placed.join(cell.where("x <> y").select("s", "low_c"), "s"), home)


def _sizes(n, m):
    return (n * DENOMINATOR >= m * NUMERATOR) & (m * DENOMINATOR >= n * NUMERATOR)


def _first_shared(a: str, b: str):
    """Whether a shingle at the places i of two sets may be the first that they share, if they are similar enough.

    Each has to have as many from there on as both must share; no pair of which one has less than 0.8 of the other's size does.
    """
    n, m, i, j = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}i"), F.col(f"{b}i")
    least = (n + m) * NUMERATOR
    return _sizes(n, m) & ((n - i) * (NUMERATOR + DENOMINATOR) >= least) & ((m - j) * (NUMERATOR + DENOMINATOR) >= least)

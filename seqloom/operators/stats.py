"""Counts and summaries over hits, and the analyses usually made of them."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import windows
from seqloom.operators import matching
from seqloom.operators.patterns import OCCURRENCE, PatternList
from seqloom.session import small_batches

#: What tells one record from all others.
RECORD_KEY = ("file_no", "file", "mate", "rec_no")
#: Windows of an Arrow batch that is sent on.
SLICES = 50_000
#: Records whose windows take turns, alike in length among those of ALIKE characters.
ABREAST, ALIKE = 16, 1 << 25
#: Distinct windows that a worker counts before it sends them on.
HELD = 500_000
#: Windows fall into 2^BUCKET_BITS buckets by hash, whose totals are sent in BUCKET_PARTS parts.
BUCKET_BITS, BUCKET_PARTS = 18, 16
#: For each of the n windows that are asked for, so many buckets are counted first, for up to MOST_FIRST windows.
FULLEST, MOST_FIRST = 16, 10_000


def pattern_counts(hits: DataFrame, patterns: DataFrame, counting: str = OCCURRENCE) -> DataFrame:
    """(pattern, count), zeros included: occurrences, or records (each mate for itself) that hold the pattern."""
    if counting == OCCURRENCE:
        found = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))
    else:
        # One row for each record and pattern first, which partial aggregation makes on the map side.
        found = hits.select("pattern", *RECORD_KEY).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))
    return patterns.join(found, "pattern", "left").select("pattern", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def tally(records: DataFrame, query: PatternList) -> DataFrame:
    """(pattern, occurrences, records, records_searched, chars, matches, records_hit), a row for each pattern found and one without: one search, one scan.

    What concerns records is counted where their first pattern, or none, is.
    """
    rows = matching.tallies(records, query).select("chars", F.size("found").alias("k"), F.expr("aggregate(found, 0L, (s, x) -> s + x.n)").alias("matches"), F.posexplode_outer("found").alias("at", "x"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    return rows.groupBy(F.col("x.pattern").alias("pattern")).agg(
        F.coalesce(F.sum("x.n"), F.lit(0)).alias("occurrences"), F.count("at").alias("records"), F.count(F.when(first, 1)).alias("records_searched"),
        F.coalesce(F.sum(F.when(first, F.col("chars"))), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(first, F.col("matches"))), F.lit(0)).alias("matches"),
        F.count(F.when(first & (F.col("k") > 0), 1)).alias("records_hit"),
    )


def summary_of(tallied: DataFrame, patterns_searched: int) -> DataFrame:
    """One row of a :func:`tally`: patterns searched and found with the percentage, records, characters (bytes), matches and distinct records hit."""
    def total(name):
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    one = tallied.agg(
        F.lit(patterns_searched).cast("long").alias("patterns_searched"), F.count("pattern").alias("patterns_found"), total("records_searched").alias("records_searched"),
        total("chars").alias("characters_searched"), total("matches").alias("matches"), total("records_hit").alias("records_hit"),
    )
    return one.withColumn("found_percent", F.format_string("%.2f", F.col("patterns_found") / F.lit(patterns_searched) * 100.0))


def search_summary(records: DataFrame, hits: DataFrame, counts: DataFrame) -> DataFrame:
    """:func:`summary_of` from tables of records, hits and counts that are there already."""
    of_records = records.agg(F.count(F.lit(1)).alias("records_searched"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).cast("long").alias("characters_searched"))
    by_record = hits.groupBy(*RECORD_KEY).agg(F.count(F.lit(1)).alias("n"))
    of_hits = by_record.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"), F.count(F.lit(1)).alias("records_hit"))
    of_patterns = counts.agg(F.count(F.lit(1)).alias("patterns_searched"), F.coalesce(F.sum((F.col("count") > 0).cast("long")), F.lit(0)).alias("patterns_found"))
    percent = F.format_string("%.2f", F.col("patterns_found") / F.col("patterns_searched") * 100.0)
    return of_patterns.crossJoin(of_records).crossJoin(of_hits).withColumn("found_percent", percent)  # one row each


def paired_summary(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: hits and distinct records hit in the files of each mate, and extracted records, mates counted each."""
    by_record = hits.groupBy(*RECORD_KEY).agg(F.count(F.lit(1)).alias("n"))

    def of(mate: int, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mate") == mate, what)), F.lit(0)).cast("long")

    one = F.lit(1)
    sums = by_record.agg(of(1, F.col("n")).alias("hits_1"), of(2, F.col("n")).alias("hits_2"), of(1, one).alias("records_hit_1"), of(2, one).alias("records_hit_2"))
    return sums.crossJoin(kept.agg(F.count(F.lit(1)).alias("extracted")))  # one row each


def ranking(counts: DataFrame) -> DataFrame:
    """Patterns by falling count."""
    return counts.orderBy(F.desc("count"), "pattern")


def rate(hit: Column, total: Column, digits: int = 3) -> Column:
    """Hit records of a hundred, null for none."""
    return F.round(100.0 * hit / F.when(total != 0, total), digits)


def density(hits: DataFrame) -> DataFrame:
    """Hits for each record hit, by mate."""
    by_record = hits.groupBy(*RECORD_KEY).agg(F.count(F.lit(1)).alias("n"))
    return by_record.groupBy("mate").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("records_hit")).withColumn("density", F.round(F.col("hits") / F.col("records_hit"), 2))


def matched_fasta(counts: DataFrame) -> DataFrame:
    """(n, header, pattern) of the patterns found, numbered by falling count; a short list by nature."""
    found = counts.where("count > 0")
    n = F.row_number().over(Window.orderBy(F.desc("count"), "pattern"))
    return found.withColumn("n", n).select("n", F.format_string(">kmer_%d count=%d", "n", "count").alias("header"), "pattern")


def multi_hits(hits: DataFrame) -> DataFrame:
    """Records that hold one pattern more than once, with the sorted positions."""
    same = hits.groupBy("pattern", *RECORD_KEY, "record_id").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list("position")).alias("positions"))
    return same.where("hits > 1")


def multi_hit_summary(hits: DataFrame) -> DataFrame:
    """By pattern: records that hold it more than once, their hits, and the most in one record."""
    per = hits.groupBy("pattern", *RECORD_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.groupBy("pattern").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("hits"), F.max("n").alias("most"))


def matches_per_record(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*RECORD_KEY, "record_id").agg(F.count(F.lit(1)).alias("matches"))


def position_histogram(hits: DataFrame, width: int = 100) -> DataFrame:
    return hits.groupBy(F.floor(F.col("position") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("hits")).select((F.col("bin") * width).alias("bin_start"), "hits")


def enumerate_kmers(records: DataFrame, k: int) -> DataFrame:
    """(rec_no, position in characters, kmer): every window of k characters.

    The rows are as many as characters, so what matters is how small they are written. ABREAST records of like length
    take turns, from the last position to the first: positions come in runs, and all of a window but its first
    character stands in the row that the record had before.
    """

    def work(batches):
        nos, at, kmers, held = [], [], [], 0
        for rows in _gathered(batches, k):
            for few, places, some in _abreast(rows, k):
                nos.append(few)
                at.append(places)
                kmers.append(some)
                held += len(some)
                if held >= SLICES:
                    yield _enumerated(nos, at, kmers)
                    nos, at, kmers, held = [], [], [], 0
        if held:
            yield _enumerated(nos, at, kmers)

    small_batches(records.sparkSession)
    return records.select(F.col("rec_no").cast("long").alias("rec_no"), "seq").mapInArrow(work, "rec_no long, position long, kmer string")


def _enumerated(nos, at, kmers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nos)), pa.array(np.concatenate(at)), pa.concat_arrays(kmers)], names=["rec_no", "position", "kmer"])


def _gathered(batches, k: int):
    """Lists of (record number, sequence) of ALIKE characters in all, without sequences that have no window."""
    rows, size = [], 0
    for batch in batches:
        for a in range(0, len(batch), windows.ROWS):
            some = batch.slice(a, windows.ROWS)
            some = [(no, s) for no, s in zip(some.column("rec_no").to_pylist(), some.column("seq").to_pylist()) if s and len(s) >= k]
            rows += some
            size += sum(len(s) for _, s in some)
            if size >= ALIKE:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _abreast(rows: list[tuple[int, str]], k: int):
    """(record numbers, positions, windows), SLICES windows at most at a time."""
    rows.sort(key=lambda x: (len(x[1]), x[1]))  # copies side by side
    for a in range(0, len(rows), ABREAST):
        group = rows[a : a + ABREAST]
        text, sizes = "".join(s for _, s in group), np.array([len(s) for _, s in group])
        nos, begins, last = np.array([no for no, _ in group], np.int64), np.cumsum(sizes) - sizes, sizes - k
        data, ends = windows.utf8(text)
        for top in range(int(last.max()), -1, -(SLICES // ABREAST)):
            places = np.arange(top, max(top - SLICES // ABREAST, -1), -1)
            turn, of = np.nonzero(places[:, None] <= last)
            yield nos[of], places[turn], windows.slices(data, ends, begins[of] + places[turn], k)


def _bucket(text: str, k: int) -> np.ndarray:
    return (windows.hashes(windows.code_points(text), k) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)


def bucket_totals(records: DataFrame, k: int) -> np.ndarray:
    """Windows of k characters in each of 2^BUCKET_BITS buckets by hash: no window is more frequent than its bucket. Tasks send their totals in parts, tasks add them."""
    small_batches(records.sparkSession)

    def fill(batches):
        own = np.zeros(1 << BUCKET_BITS, np.int64)
        for text, whole in windows.chunks((b.column("seq") for b in batches), k):
            own += np.bincount(_bucket(text, k)[whole], minlength=len(own))
        if own.any():
            parts = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(own, BUCKET_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BUCKET_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "totals"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        every = (np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64) for b in rows["totals"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "totals": [sum(every).tobytes()]})

    out = np.zeros((BUCKET_PARTS, (1 << BUCKET_BITS) // BUCKET_PARTS), np.int64)
    for r in records.select("seq").mapInArrow(fill, "part int, totals binary").groupBy("part").applyInPandas(merge, "part int, totals binary").collect():
        out[r.part] = np.frombuffer(r.totals, np.int64)
    return out.ravel()


def count_kmers(records: DataFrame, k: int, buckets: np.ndarray | None = None) -> DataFrame:
    """(kmer, count): windows of k characters, or those in the buckets that are true; counted in the workers first, so that few rows are shuffled."""
    small_batches(records.sparkSession)

    def work(batches):
        held = windows.WindowCounts(k, HELD)
        for text, whole in windows.chunks((b.column("seq") for b in batches), k):
            for some in held.add(text, whole if buckets is None else whole & buckets[_bucket(text, k)]):
                yield _counted(*some)
        for some in held.rest():
            yield _counted(*some)

    return records.select("seq").mapInArrow(work, "kmer string, count long").groupBy("kmer").agg(F.sum("count").alias("count"))


def _counted(kmers, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kmers, pa.string()), pa.array(counts, pa.int64())], names=["kmer", "count"])


def top_kmers(records: DataFrame, k: int, n: int) -> DataFrame:
    """The n most frequent windows of k characters.

    Only windows of the fullest buckets are counted, and it is checked that no other can be among the first n; else
    those of each bucket that can hold one are. What is shuffled does not grow with the distinct windows. Runs when called.
    """

    def first(counts: DataFrame) -> DataFrame:
        return counts.orderBy(F.desc("count"), "kmer").limit(n)

    if not 0 < n <= MOST_FIRST:
        return first(count_kmers(records, k))
    totals = bucket_totals(records, k)
    chosen = totals >= max(1, np.sort(totals)[-min(FULLEST * n, len(totals))])
    rows = first(count_kmers(records, k, chosen)).collect()
    least = rows[-1]["count"] if len(rows) == n else 1
    if least <= totals[~chosen].max(initial=0):
        return first(count_kmers(records, k, totals >= least))
    return first(records.sparkSession.createDataFrame(rows, "kmer string, count long"))


def sample_kmers(records: DataFrame, k: int, n: int, seed: int = 42) -> DataFrame:
    """n distinct windows of k characters, the same for a seed: those with the least digests, of which each worker sends its own n at most."""

    prefix = f"{seed}:".encode()

    def work(batches):
        least: dict[str, str] = {}  # digests by window
        most = None
        for text, whole in windows.chunks((b.column("seq") for b in batches), k):
            for w in _with_least_digests(text, windows.md5_leads(text, whole, k, prefix), k, n, most).difference(least):
                digest = md5(prefix + w.encode()).hexdigest()
                if most is None or digest <= most:
                    least[w] = digest
            if len(least) > (4 * n + 1000 if most else n):
                least = dict(sorted(least.items(), key=lambda x: (x[1], x[0]))[:n])
                most = max(least.values())
        rows = sorted(least.items(), key=lambda x: (x[1], x[0]))[:n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.string())], names=["kmer", "digest"])

    small_batches(records.sparkSession)
    kmers = records.select("seq").mapInArrow(work, "kmer string, digest string").distinct()
    return kmers.orderBy("digest", "kmer").limit(n).select("kmer")


def _with_least_digests(text: str, leads, k: int, n: int, most: str | None) -> set[str]:
    """Windows whose digests may be up to ``most``, or without it among the n least of the text; few others, as only the first 32 bits are known."""
    if most is None:
        leads = list(leads)
        distinct = np.unique(np.concatenate([x for _, x in leads]))  # of as many windows at least
        cut = distinct[min(n, len(distinct) - 1)]
    else:
        cut = np.uint32(int(most[:8], 16))
    return {text[i : i + k] for at, x in leads for i in at[x <= cut].tolist()}

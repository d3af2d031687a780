"""Keep or drop records, single or paired, by the patterns that they hold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import matching, stats
from seqloom.operators.patterns import PatternList


class PairError(ValueError):
    pass


@dataclass
class Result:
    """What a search gives, each part a plan that runs only where it is used."""

    records: DataFrame
    kept: DataFrame
    query: PatternList
    paired: bool = False

    @cached_property
    def hits(self) -> DataFrame:
        return matching.hits(self.records, self.query)

    @cached_property
    def pattern_counts(self) -> DataFrame:
        return stats.pattern_counts(self.hits, self.query.frame(self.records.sparkSession), self.query.counting)

    @cached_property
    def summary(self) -> DataFrame:
        return stats.summary_of(stats.tally(self.records, self.query), len(self.query.patterns))

    @cached_property
    def paired_summary(self) -> DataFrame:
        return stats.paired_summary(self.hits, self.kept)


def extract(records: DataFrame, query: PatternList, *, invert: bool = False) -> Result:
    """Records that hold a pattern, or with ``invert`` those that hold none: a filter in the scan's stage, without a shuffle."""
    found = matching.any_match(records, query)
    return Result(records, records.where(~found if invert else found), query)


def zip_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both mates as one table, after a check that the n-th files of both have as many records; one pass over both."""
    both = first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2)))
    if "file_no" not in both.columns:
        both = both.withColumn("file_no", F.lit(0))
    n = [F.count(F.when(F.col("mate") == m, 1)).alias(f"n{m}") for m in (1, 2)]
    for r in both.groupBy("file_no").agg(*n).where("n1 <> n2").orderBy("file_no").take(1):
        raise PairError(f"the two files have different numbers of records: {r.n1} and {r.n2} (pair of files {r.file_no + 1})")
    return both


def extract_pairs(records: DataFrame, query: PatternList, *, invert: bool = False) -> Result:
    """Both mates of every pair in which either holds a pattern, or with ``invert`` of those where neither does.

    records has both mates, paired by ``rec_no`` within their pair of files, ``file_no``, and within a
    ``pair_group`` of the caller's own.
    """
    keys = [c for c in ("pair_group", "file_no", "rec_no") if c in records.columns]
    hit = records.where(matching.any_match(records, query)).select(*keys).distinct()
    return Result(records, records.join(hit, keys, "left_anti" if invert else "left_semi"), query, paired=True)

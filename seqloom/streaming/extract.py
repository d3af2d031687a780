"""The matching operators on unbounded tables: they keep no state, so a stream needs no watermark for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import matching
from seqloom.operators.patterns import PatternList


def extract_stream(records: DataFrame, query: PatternList, *, invert: bool = False) -> DataFrame:
    """A stream of records with a ``seq`` column, filtered as :func:`seqloom.operators.extract.extract` does."""
    found = matching.any_match(records, query)
    return records.where(~found if invert else found)


def hits_stream(records: DataFrame, query: PatternList) -> DataFrame:
    return matching.hits(records, query)


def windowed_counts(records: DataFrame, query: PatternList, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Records that hold each pattern, by event-time window; windows close once the watermark has passed them."""
    found = records.withWatermark(time, late).withColumn("pattern", F.explode(matching.found_set(records, query)))
    return found.groupBy(F.window(time, window).alias("window"), "pattern").agg(F.count(F.lit(1)).alias("records"))

"""Label alignments with the patterns that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import matching
from seqloom.operators.extract import Result
from seqloom.operators.patterns import PatternList

ALL, MATCHING, NOT_MATCHING = "all", "matching", "not_matching"


class TagError(ValueError):
    pass


def check_tag(tag: str) -> str:
    if len(tag.encode()) != 2:
        raise TagError("a tag has exactly two characters")
    return tag


def merged(found: Column, existing: Column) -> Column:
    """The patterns found and those of an existing tag, sorted, distinct and joined by commas."""
    old = F.when(F.coalesce(existing, F.lit("")) != "", F.split(existing, ",")).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(found, old))), ",")


def tag(records: DataFrame, query: PatternList, *, tag: str = "km", mode: str = ALL) -> Result:
    """Alignments with the tag set; ``mode`` keeps all, only matching or only other ones, by new matches alone.

    The tag goes last among a record's tags and replaces one of its name, whose value it takes in; an
    existing tag that is no string is an error. No shuffle.
    """
    check_tag(tag)
    if mode not in (ALL, MATCHING, NOT_MATCHING):
        raise TagError(f"no such mode: {mode}")
    rows = records.withColumn("__found", matching.found_set(records, query))
    if mode != ALL:
        rows = rows.where((F.size("__found") > 0) if mode == MATCHING else (F.size("__found") == 0))
    old = F.get(F.filter("tags", lambda t: t["tag"] == tag), 0)
    wrong = F.raise_error(F.concat(F.lit(f"tag {tag} is not a string in record "), F.coalesce("qname", F.lit("*"))))
    value = F.when(old.isNotNull() & (old["type"] != "Z"), wrong.cast("string")).otherwise(merged(F.col("__found"), old["value"]))
    others = F.filter("tags", lambda t: t["tag"] != tag)
    own = F.struct(F.lit(tag).alias("tag"), F.lit("Z").alias("type"), value.alias("value"))
    kept = rows.withColumn("tags", F.concat(others, F.array(own))).drop("__found")
    return Result(records, kept, query)

"""A corpus from quality rules to token ids, in five stages, each an operator of ``seqloom.llm``.

Every stage gets what the one before it kept, as a table of documents, and all but the last return
the columns of documents. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import op01_lines, op02_bpe, op03_decontaminate, op04_quality, op06_simhash
from seqloom.llm.common import shared_dir, stored, table, where_few
from seqloom.llm.near_copies import SHINGLE, near_copies


def named_plainly(stage):
    """The stage over columns of plain names, which then get their own back: extra columns may have any name."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"extra{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run_stage


@named_plainly
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null text is rejected: it has no words."""
    rows = op04_quality.ledger(docs, carry=tuple(docs.columns))
    return rows.where(op04_quality.kept(op04_quality.BASE) & op04_quality.kept(op04_quality.V1)).select(*docs.columns)


@named_plainly
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents of which no word is left; n_chars follows."""
    out = op01_lines.dedup(docs).where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^ \t\r\n\x0b\f]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@named_plainly
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of near fingerprints or similar sets join, the one with the smallest doc_id stays.

    The groups of near fingerprints of five-word shingles decide what they join. As three bits are few for a similarity
    of 0.8, an exact search then adds the pairs of such sets that they have left apart. Rows without an id stay.
    """
    groups = op06_simhash.near_duplicates(docs, shingle=SHINGLE).where("doc_id <> component_id")
    found = near_copies(docs, given=groups.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(where_few(gone), F.col("doc_id") == F.col("__gone"), "left_anti").select(*docs.columns)


@named_plainly
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return op03_decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, decoded again, as digests."""
    return op02_bpe.digests(op02_bpe.encode_decode(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{home}/{name}")
    return docs


#: SQL has neither the shingles nor the tokenizer of these stages; the tests hold run() against a plain program of all five.
ORACLE_SQL = None

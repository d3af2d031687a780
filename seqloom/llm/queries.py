"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import op01_lines, op02_bpe, op03_decontaminate, op04_quality, op05_ids, op06_simhash, op07_lm, op08_warc, op09_html, op10_pii
from seqloom.llm.common import table
from seqloom.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_bpe.digests(op02_bpe.encode_decode(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_quality.verdicts(op04_quality.ledger(table(spark, sf_dir, "documents")))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_ids.round_trip(table(spark, sf_dir, "documents"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_simhash.digests(op06_simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op07_lm.score(docs, op07_lm.train(docs))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_warc.round_trip(table(spark, sf_dir, "pages"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_html.main_text(table(spark, sf_dir, "pages"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pii.digests(op10_pii.find(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_bpe_round_trip, op3_decontamination, op4_quality_rules, op5_token_id_files, op6_simhash_groups, op7_lm_scores, op8_warc_round_trip, op9_html_main_text, op10_pii_spans)}

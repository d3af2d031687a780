"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and once for its time, into Spark's noop sink, so that whole results
are made and none is collected. The single-pattern and many-pattern searches over single records and
pairs mirror the published baselines (1 and 100 patterns).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ["extract_any", "extract_invert", "hits", "counts_occurrence", "counts_record", "summary", "hits_overlapping", "paired_extract", "tag_all", "kmer_top"]


def searches(spark: SparkSession, sf_dir: str) -> dict:
    """1 and 100 patterns of 31 characters, single and paired."""
    from seqloom.operators import patterns as pats
    from seqloom.operators.extract import extract, extract_pairs
    from seqloom.plans.registry import _mates, _pattern_frame, _records

    every = sorted(r.pattern for r in _pattern_frame(spark, sf_dir).collect())
    few, ascii_only = every[:100], [p for p in every if p.isascii()][:100]
    if len(ascii_only) < 100:
        raise SystemExit("fewer than 100 patterns")

    def single(n):
        return lambda s, d: extract(_records(s, d), pats.plan(pats.prepare(few[:n]))).kept

    def paired(n):
        return lambda s, d: extract_pairs(_mates(s, d), pats.plan(pats.prepare(ascii_only[:n], reverse_complement=True))).kept

    return {"search_1x31": single(1), "search_100x31": single(100), "paired_1x31": paired(1), "paired_100x31": paired(100)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from seqloom.plans.registry import QUERIES

    todo = searches(spark, sf_dir) | {n: QUERIES[n] for n in HEADLINE}
    times = {}
    for name, query in todo.items():
        for _ in range(2):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    records = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1))).first()[0]
    rate = {n: round(records / times[n]) for n in ("search_1x31", "search_100x31")}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir, "cpus": cpus, "records_per_sec": rate}))
    spark.stop()


if __name__ == "__main__":
    main()

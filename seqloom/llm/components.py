"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import FEW_ROWS, checkpoint, shuffles_go, small_batches


def connected_components(edges: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long); component is its smallest node.

    Where a count finds at most ``few`` edges, one task joins them all, as each step below is some eight
    stages of every shuffle partition, however little is in them.

    Each step is a minimum per node with partial aggregation and a join, which AQE splits at nodes
    of many edges. Steps are written to the shared folder; the driver sees only a count and a
    checksum of each. The number of steps grows with the logarithm of the longest chain.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = checkpoint(links)
    seen = _sign(links)
    if 0 < seen[0] <= few:
        small_batches(links.sparkSession)
        return checkpoint(links.coalesce(1).mapInArrow(_joined, "node bigint, component bigint"))
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _sign(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _joined(batches):
    """The components of all edges (u, v) by union-find; the root of a tree is its smallest node."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(map(root, up)), pa.int64())], names=["node", "component"])


def _sign(links: DataFrame) -> tuple[int, int]:
    with shuffles_go(links.sparkSession):
        n, x = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return n, x

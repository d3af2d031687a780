"""Tables, the shared folder and the checks that the operators have in common."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.bitmap import bitmap, in_bitmap  # noqa: F401
from seqloom.session import ARROW_BYTES, small_batches  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a temporary folder of this machine takes its place; then the
    session must be local.
    """
    return f"{_checkpoint_root(spark)}/seqloom-{uuid.uuid4().hex}"


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


@contextmanager
def shuffles_go(spark: SparkSession):
    """Within it, what an action has shuffled is deleted when the action ends.

    Else it stays until the driver happens to collect its garbage, and stages of many small steps fill the disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor loses nothing."""
    _checkpoint_root(df.sparkSession)
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, which is planned with that setting


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it again; compressed, unlike a checkpoint."""
    with shuffles_go(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of some numbers each that are sent to every executor; larger tables are shuffled.
FEW_ROWS = 300_000


def where_few(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """A table of a few numeric columns, written once, and marked for broadcast if a count of its rows (or of what they hold) allows it."""
    rows = checkpoint(rows)
    with shuffles_go(rows.sparkSession):
        n = rows.agg(F.sum(size) if size is not None else F.count(F.lit(1))).first()[0]
    return F.broadcast(rows) if (n or 0) <= FEW_ROWS else rows


def local_path(uri: str) -> str | None:
    """The path of a file: URI, or None for another store."""
    p = urlparse(uri)
    return unquote(p.path) if p.scheme in ("", "file") else None


def open_shared(uri: str, mode: str):
    """A file of the shared folder, for reading or writing bytes from a worker."""
    if (path := local_path(uri)) is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_file(path)


def text_of(name: str) -> Column:
    """A text column as string, a null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` has it inside a lambda over many elements."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)

"""What a session needs for Python workers: this package, and batches that fit in memory."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch sent to a Python worker. Texts may be long, so a batch stays small.
ARROW_ROWS = 256
#: Bytes of an Arrow batch: where texts are long, it has fewer rows.
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let the workers import this package wherever the driver found it; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seqloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "seqloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, folders, names in os.walk(home):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(home)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Prepare a session for Python workers: they get this package, and batches of long texts that fit in memory."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

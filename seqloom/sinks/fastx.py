"""Records back to FASTA and FASTQ, in input order and as they stood in the input."""

from __future__ import annotations

import sys
from itertools import zip_longest

from pyspark.sql import DataFrame

from seqloom.sources.files import add_suffix, uncompressed_type, with_extension


def places(df: DataFrame) -> list[str]:
    """The columns that put records in input order."""
    return [c for c in ("file_no", "file", "rec_no") if c in df.columns and (c != "file" or "file_no" not in df.columns)]


def _raw(df: DataFrame, mate: int | None = None):
    """The records' text in order, a partition of the sorted table at a time on the driver."""
    rows = df if mate is None else df.where(f"mate = {mate}")
    return (r.raw for r in rows.orderBy(*places(rows)).select("raw").toLocalIterator(prefetchPartitions=True))


def output_path(out: str, source: str) -> str:
    """The output's path with the extension of the input's format; output is not compressed."""
    return with_extension(out, uncompressed_type(source))


def write(kept: DataFrame, out: str, source: str) -> str:
    path = output_path(out, source)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(_raw(kept))
    return path


def write_pairs(kept: DataFrame, out: str, source: str) -> tuple[str, str]:
    """Two files; both have the extension of the first input's format."""
    path = output_path(out, source)
    paths = add_suffix(path, "_1"), add_suffix(path, "_2")
    for mate, p in enumerate(paths, 1):
        with open(p, "w", encoding="utf-8", newline="") as f:
            f.writelines(_raw(kept, mate))
    return paths


def write_stdout(kept: DataFrame, paired: bool = False, to=None) -> None:
    """Records on standard output; of pairs, mates in turn."""
    to = to or sys.stdout
    if not paired:
        to.writelines(_raw(kept))
    else:
        for a, b in zip_longest(_raw(kept, 1), _raw(kept, 2), fillvalue=""):
            to.write(a + b)


def write_parts(kept: DataFrame, folder: str, paired: bool = False) -> None:
    """Folders of ordered part files that the tasks write, for outputs beyond one machine; of pairs, one for each mate.

    Parts of both mates are cut at the same places only by chance; one after another they pair up.
    """
    for mate in (1, 2) if paired else (None,):
        rows = kept if mate is None else kept.where(f"mate = {mate}")
        to = folder if mate is None else f"{folder}_{mate}"
        rows.orderBy(*places(rows)).selectExpr("rtrim('\n', raw) AS raw").write.mode("errorifexists").text(to)

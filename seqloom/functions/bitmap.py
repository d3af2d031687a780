"""Bitmaps of fixed size over hashes: what is not in one is in no row of the table that it was made from."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Parts in which tasks send their bitmaps.
BITMAP_PARTS = 64


def bitmap(values: DataFrame, bits: int, mix=None) -> np.ndarray:
    """A bitmap of 2^bits bits with those set that the first bits of the column ``h`` name, spread by ``mix`` if it is given.

    Each task fills its own, parts of them are merged by tasks, and the driver gets BITMAP_PARTS parts: its
    size depends on ``bits`` alone.
    """
    size = (1 << (bits - 3)) // BITMAP_PARTS

    def fill(batches):
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            h = np.asarray(batch.column("h")).view(np.uint64)
            x = (mix(h) if mix else h) >> np.uint64(64 - bits)
            np.bitwise_or.at(own, x >> np.uint64(3), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        if own.any():
            for i, x in enumerate(np.split(own, BITMAP_PARTS)):
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes())], pa.binary())], names=["part", "bits"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint8)
        for b in rows["bits"]:
            total |= np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [total.tobytes()]})

    out = np.zeros((BITMAP_PARTS, size), np.uint8)
    merged = values.select("h").mapInArrow(fill, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary")
    for r in merged.collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the first bits of each hash are set in a :func:`bitmap`."""
    x = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

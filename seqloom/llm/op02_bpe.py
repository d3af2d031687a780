"""BPE encoding and decoding with tree concatenation of long text.

A text of more than a leaf is cut into leaves anywhere, also within words; they are encoded by themselves,
and neighbours are joined level by level by encoding growing windows around each cut again, until both
sides agree. The leaves of one text are encoded in one task, side by side with those of other texts.

Nulls and empty texts encode to no ids and decode to the empty text. Repeated rows are encoded each
by itself; an empty table gives an empty result; columns besides the two that are named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, text_of
from seqloom.llm.wordbpe import tokenizer_path, word_bpe

TOKENIZER = "word_bpe_49k.json"


def encode_decode(df: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string, n_joins): each whole text encoded, its ids decoded again, and the joins of its tree.

    One pass without a shuffle. A worker holds one Arrow batch, its encoder and its bounded caches.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    key = source.schema["doc_id"].dataType.simpleString()

    def work(batches):
        bpe = word_bpe(tokenizer_path(tokenizer))
        for batch in batches:
            ids, decoded, sizes, joins = [], [], [0], [bpe.joins]
            for text in batch.column("text").to_pylist():
                one = bpe.encode(text)
                joins.append(bpe.joins)
                ids.append(one)
                decoded.append(bpe.decode(one))
                sizes.append(len(one))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string()), pa.array(np.diff(joins))], names=["doc_id", "ids", "decoded", "n_joins"])

    return source.mapInArrow(work, f"doc_id {key}, ids array<int>, decoded string, n_joins long")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what :func:`encode_decode` returns."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "n_joins",
    )

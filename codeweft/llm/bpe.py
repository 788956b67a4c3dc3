"""BPE encoding and decoding with batched merge rounds.

Each slice of texts is split into pieces, each distinct piece is encoded once:
the symbols of all pieces lie in one flat array, and in every round each piece
merges its lowest-ranked pair, found by binary search over sorted pair keys.

Defined results: null counts as empty; an empty text has no ids and decodes to
an empty text; special tokens inside a text get their own id, as in the
library. Rows stay as they are, repeated or not, and keep their ``doc_id``.
Extra columns are ignored. Ids are packed as little-endian unsigned 32-bit
integers, so that a row of a very long text stays small; ``unpack`` gives an
array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from codeweft.llm import _bpe
from codeweft.llm._words import buffers, slices
from codeweft.runtime import ship


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row; ``vocabulary`` is the path of a
    byte-level tokenizer file, which every executor has at that place."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(vocabulary)
        for batch in slices(batches):
            ids, ends = bpe.encode(*buffers(batch.column("text")))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends)), packed.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with the decoded ``text`` of its ``ids`` (null: empty)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(vocabulary)
        for batch in slices(batches, "ids"):
            packed = batch.column("ids").fill_null(b"").cast(pa.large_binary())
            ends = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + len(packed) + 1]
            data = packed.buffers()[2]
            ids = np.frombuffer(data, dtype="<u4", count=(ends[-1] - ends[0]) // 4, offset=int(ends[0])).astype(np.int64) if data is not None and ends[-1] > ends[0] else np.empty(0, dtype=np.int64)
            texts = pa.array(bpe.decode(ids, (ends - ends[0]) // 4), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    schema = StructType([*encoded.schema.fields]).add("text", StringType())
    return encoded.mapInArrow(run, schema)


def unpack(ids: Column) -> Column:
    """Packed ids as ``array<bigint>``."""
    text = F.hex(ids)
    return F.transform(F.regexp_extract_all(text, F.lit("(..)(..)(..)(..)"), F.lit(0)), lambda x: F.conv(F.concat(x.substr(7, 2), x.substr(5, 2), x.substr(3, 2), x.substr(1, 2)), 16, 10).cast("bigint"))

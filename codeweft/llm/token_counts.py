"""Token counts by dynamic programming over prefixes.

For every piece of a text the number of tokens of each of its prefixes is
worked out: exactly one token can end the encoding of a prefix, and what is
left is the encoding of a shorter prefix. Counts of pieces add up to the text;
the table of a text answers how many tokens any prefix has, or how much of a
text fits a budget, without encoding again.

Defined results: null counts as empty, with no tokens; special tokens inside a
text count as one; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import _bpe
from codeweft.llm._words import buffers, slices
from codeweft.runtime import ship


def _input(docs: DataFrame) -> tuple[DataFrame, str]:
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), docs.schema["doc_id"].dataType.simpleString()


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row."""
    rows, kind = _input(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(vocabulary)
        for batch in slices(batches):
            data, offs = buffers(batch.column("text"))
            pieces, codes, ends = bpe.code(data, offs)
            total = np.concatenate([[0], np.cumsum(bpe.totals(pieces)[codes])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(np.diff(total[ends]))], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text, counts``: ``counts[k]`` is the number of tokens of the
    first k characters, k from 0 to the length of the text."""
    rows, kind = _input(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(vocabulary)
        for batch in slices(batches, most=1 << 20):
            counts = [bpe.text_counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "text", "counts"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, counts array<bigint>")


def truncate(table: DataFrame, budget: int) -> DataFrame:
    """``doc_id, n_chars, n_tokens, text``: the longest prefix of each text
    of ``prefix_table`` that has ``budget`` tokens at most. (Counts may fall
    from one character to the next, so the last that fits is taken.)"""
    fits = F.filter(F.transform("counts", lambda n, k: F.struct(k.alias("k"), n.alias("n"))), lambda x: x["n"] <= budget)
    last = F.element_at(fits, -1)
    return table.select("doc_id", last["k"].alias("n_chars"), last["n"].alias("n_tokens"), F.expr("text").substr(F.lit(1), last["k"]).alias("text"))

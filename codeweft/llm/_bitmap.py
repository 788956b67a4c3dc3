"""A Bloom filter over 64-bit hashes that is sent to the tasks whole.

It has ``PER_MEMBER`` bits for each member, between ``LEAST`` and ``MOST`` of
them, so what is sent has a fixed bound. Beyond that bound it lets more other
hashes pass, which costs shuffled rows; a join or count behind it always
decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm._store import passing_shuffles
from codeweft.llm._words import mix, release

PER_MEMBER = 10
#: Powers of two: bits of the smallest and the largest filter (32 MB).
LEAST, MOST = 20, 28
#: Places of a member, at most.
PLACES = 4
#: The filter is built in so many parts (a power of two), each by one task at
#: a time; all places of a member are in one part.
_PARTS = 8


@dataclass(frozen=True)
class Bitmap:
    held: np.ndarray
    bits: int
    places: int


def _parts(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes.astype(np.uint64, copy=False)) >> np.uint64(64 - _PARTS)).astype(np.int64)


def _places(hashes: np.ndarray, low: int, places: int) -> Iterator[np.ndarray]:
    """Places inside the part, of ``2 ** low`` bits."""
    h = mix(hashes.astype(np.uint64, copy=False))
    step = mix(h) | np.uint64(1)
    for _ in range(places):
        h += step
        yield (h >> np.uint64(64 - low)).astype(np.int64)


def build(hashes: DataFrame, column: str) -> Bitmap:
    """The filter of all values of ``column``."""
    with passing_shuffles(hashes.sparkSession):
        return _build(hashes, column)


def _build(hashes: DataFrame, column: str) -> Bitmap:
    n = max(hashes.count(), 1)
    bits = int(min(MOST, max(LEAST, np.ceil(np.log2(PER_MEMBER * n)))))
    places = int(min(PLACES, max(1, round(0.69 * (1 << bits) / n))))
    low = bits - _PARTS

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.unique(np.asarray(batch.column(column).drop_null()))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(_parts(own.view(np.uint64)))], names=["hash", "part"])
        release()

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << low, dtype=bool)
        for slot in _places(rows["hash"].to_numpy().view(np.uint64), low, places):
            held[slot] = True
        packed = np.packbits(held).tobytes()
        del held, rows
        release()
        return pd.DataFrame({"part": [key[0]], "held": [packed]})

    rows = hashes.select(column).mapInArrow(dealt, "hash bigint, part bigint")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in rows.groupBy("part").applyInPandas(part, "part bigint, held binary").collect():  # 2 ** bits bits at most
        out[row.part << (low - 3) : (row.part + 1) << (low - 3)] = np.frombuffer(row.held, dtype=np.uint8)
    return Bitmap(out, bits, places)


def test(bitmap: Bitmap, hashes: np.ndarray) -> np.ndarray:
    low = bitmap.bits - _PARTS
    begin = _parts(hashes) << low
    found = np.ones(len(hashes), dtype=bool)
    for slot in _places(hashes, low, bitmap.places):
        slot += begin
        found &= (bitmap.held[slot >> 3] >> (7 - (slot & 7).astype(np.uint8))) & 1 == 1
    return found

"""Vectorised word splitting over Arrow text batches.

Both word rules in use split on ASCII bytes only, so they can run on UTF-8
bytes: every byte of a non-ASCII character is a word byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at once; bounds a worker's memory.
SLICE_BYTES = 4 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Which bytes belong to words, and what each byte is folded to."""

    word: np.ndarray
    fold: np.ndarray


def _fold_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 32
    return fold


def _alnum() -> np.ndarray:
    word = np.zeros(256, dtype=bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return word


def _spaced() -> np.ndarray:
    word = np.ones(256, dtype=bool)
    word[0x09:0x0E] = word[0x20] = False
    return word


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_LOWER = Rule(_alnum(), _fold_ascii())
#: ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
SPACED_LOWER = Rule(_spaced(), _fold_ascii())
#: ``[^\x20\x09-\x0D]+`` of the unchanged text.
SPACED = Rule(_spaced(), np.arange(256, dtype=np.uint8))


@dataclass
class Words:
    """Words of some documents: ``data[offs[i]:offs[i+1]]`` is word i, and
    words ``docs[d]`` to ``docs[d+1]`` are those of document d."""

    data: np.ndarray
    offs: np.ndarray
    docs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def arrow(self) -> pa.LargeBinaryArray:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(np.ascontiguousarray(self.offs, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(self.data))])

    def hashes(self, multiplier: int = int(_MULT)) -> np.ndarray:
        """A 64-bit hash of each word's bytes; another for another odd
        ``multiplier``."""
        if not len(self):
            return np.empty(0, dtype=np.uint64)
        lens = np.diff(self.offs)
        power = np.ones(int(lens.max()), dtype=np.uint64)
        power[1:] = np.uint64(multiplier)
        power = np.multiply.accumulate(power)
        at = np.arange(len(self.data), dtype=np.int32)
        at -= np.repeat(self.offs[:-1].astype(np.int32), lens)
        terms = power[at]
        terms *= self.data.astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(terms, self.offs[:-1]) + lens.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of every k consecutive word hashes, over
    document borders too; the caller drops those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _MULT
        out += h[j : n + j]
    return mix(out)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls count as empty."""
    text = (text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_binary()).fill_null(b"")
    if not len(text):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = text.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data, offs - offs[0]


def split(data: np.ndarray, offs: np.ndarray, rule: Rule) -> Words:
    """Words of the documents ``data[offs[d]:offs[d+1]]``."""
    if not len(data):
        return Words(data, np.zeros(1, dtype=np.int64), np.zeros(len(offs), dtype=np.int64))
    inside = rule.word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int64)
    kept = rule.fold[data[inside]]
    return Words(kept, np.append(before[begin] - 1, len(kept)), np.searchsorted(begin, offs))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at
    least; nothing is cut inside a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back: a worker that waits for its next task counts
    for its executor as well."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

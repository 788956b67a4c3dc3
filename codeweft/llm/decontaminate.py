"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns documents into immutable segments: each holds its
documents' ids and lengths and, for every term, the sorted list of positions
in the segment. Segments are cut by bytes of text, so neither a frequent term
nor a hot source makes a large one, and nothing is shuffled. A phrase is found
in a segment by taking the postings of its rarest term (by frequency in the
whole corpus), subtracting the term's offset, and intersecting with the
offset-adjusted postings of the other terms, next rarest first.

The test items are a stated query set. They are sent to the tasks in blocks of
at most ``BLOCK_BYTES`` bytes of text, as many blocks as it takes, and the hits
of all blocks are put together.

With ``slop`` the same pass over the postings finds proximity matches too: an
item is near a document if all terms of one of its windows occur in any order
within ``slop`` words of an occurrence of the window's rarest term (of equally
frequent ones the first in the window). A term that a window has twice may be
met by one occurrence. So reworded, reordered and interrupted copies are told.

Defined results: words are those of ``_words.ALNUM_LOWER``; null and empty
texts have none and are never hit; items without words match nothing; an item
shorter than the window is one window; several items with one id count once;
repeated documents each get their own row; a null ``item_id`` is left out.
Extra columns are ignored. Without documents the result is empty, without
items no document is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm._store import materialise
from codeweft.llm._words import ALNUM_LOWER, buffers, slices, split
from codeweft.runtime import ship

#: Consecutive words of an item that make a match.
WINDOW = 10
#: Words to either side of a window's rarest term that proximity looks at.
SLOP = 15
#: Bytes of item text that go to the tasks at once.
BLOCK_BYTES = 8 << 20

INDEX = "segment string, doc_ids array<bigint>, n_words array<int>, terms array<binary>, counts array<int>, postings binary"
_INDEX = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the positional index of ``docs``, with the postings of
    every term. One gap between documents keeps a phrase inside its document.
    A segment is named by its partition and its number there, so it has one
    name however often it is made."""
    ship(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches)):
            words = split(*buffers(batch.column("text")), ALNUM_LOWER)
            coded = words.arrow().dictionary_encode()
            terms, codes = coded.dictionary.cast(pa.binary()), np.asarray(coded.indices)
            n_words = np.diff(words.docs)
            place = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(n_words)), n_words)
            order = np.sort((codes.astype(np.int64) << 32) | place)
            counts = np.bincount(order >> 32, minlength=len(terms))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([n_words.astype(np.int32)], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                    pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([np.diff((order & 0xFFFFFFFF).astype("<u4"), prepend=np.uint32(0)).tobytes()], pa.binary()),
                ],
                schema=_INDEX,
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(segments, INDEX)


class Items:
    """A block of test items: its terms and its windows, each window a row of
    term numbers (-1 beyond the end of a short one)."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        words = split(*buffers(pa.array(texts, pa.string())), ALNUM_LOWER)
        coded = words.arrow().dictionary_encode()
        self.terms = coded.dictionary.cast(pa.binary())
        codes = np.asarray(coded.indices)
        rows: dict[tuple[int, ...], set[str]] = {}
        for i, a, b in zip(ids, words.docs, words.docs[1:]):
            for at in range(a, max(a + 1, b - window + 1) if b > a else a):
                rows.setdefault(tuple(codes[at : min(at + window, b)].tolist()), set()).add(i)
        self.lens = np.array([len(r) for r in rows], dtype=np.int64)
        self.windows = np.full((len(rows), window), -1, dtype=np.int64)
        for k, r in enumerate(rows):
            self.windows[k, : len(r)] = r
        self.items = [sorted(x) for x in rows.values()]
        self.order = np.zeros_like(self.windows)

    def rank(self, frequency: np.ndarray) -> None:
        """Order each window's offsets from its rarest term on."""
        weight = np.where(self.windows >= 0, frequency[self.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(weight, axis=1, kind="stable")


class Segment:
    """Postings of one index row for the terms of a block of items."""

    def __init__(self, batch: pa.RecordBatch, terms: pa.Array):
        own = batch.column("terms").flatten().cast(pa.binary())
        counts = np.asarray(batch.column("counts").flatten(), dtype=np.int64)
        self.name = batch.column("segment")[0].as_py()
        self.doc_ids = batch.column("doc_ids").flatten()
        self.n_words = np.asarray(batch.column("n_words").flatten(), dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        places = np.cumsum(np.frombuffer(batch.column("postings")[0].as_buffer(), dtype="<u4"), dtype=np.uint32).astype(np.int64)
        at = pc.index_in(terms, value_set=own).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(own) else np.full(len(terms), -1)
        ends = np.cumsum(counts)
        self.count = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
        first = np.where(at >= 0, (ends - counts)[at] if len(counts) else 0, 0)
        local = np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.place = places[np.repeat(first, self.count) + local]
        self.first = np.cumsum(self.count) - self.count
        #: term and position in one sorted key
        self.keys = (np.repeat(np.arange(len(terms)), self.count) << 32) | self.place

    def candidates(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms occur, and the places of their rarest."""
        there = np.where(items.windows >= 0, self.count[items.windows] > 0, True).all(axis=1)
        windows = np.flatnonzero(there)
        rare = items.windows[windows, items.order[windows, 0]]
        n = self.count[rare]
        at = np.repeat(self.first[rare], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(windows, n), self.place[at]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 32) | place
        at = np.searchsorted(self.keys, key)
        return (place >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def phrases(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and starting places of exact occurrences."""
        window, place = self.candidates(items)
        start = place - items.order[window, 0]
        for step in range(1, items.windows.shape[1]):
            if not len(window):
                break
            offset = items.order[window, step]
            term = items.windows[window, offset]
            ok = (term < 0) | self.has(np.maximum(term, 0), start + offset)
            window, start = window[ok], start[ok]
        return window, start

    def near(self, items: Items, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and places of the rarest term such that each other
        term of the window occurs within ``slop`` words in the document."""
        window, place = self.candidates(items)
        for step in range(1, items.windows.shape[1]):
            if not len(window):
                break
            doc = np.searchsorted(self.begin, place, side="right") - 1
            term = items.windows[window, items.order[window, step]]
            low, high = np.maximum(place - slop, self.begin[doc]), np.minimum(place + slop, self.begin[doc + 1] - 2)
            safe = np.maximum(term, 0)
            at = np.searchsorted(self.keys, (safe << 32) | low)
            ok = (term < 0) | (self.keys[np.minimum(at, len(self.keys) - 1)] <= ((safe << 32) | high)) & (at < len(self.keys))
            window, place = window[ok], place[ok]
        return window, place


def item_blocks(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items, ``block_bytes`` of text at most at once (one item at least)."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    ids, texts, held = [], [], 0
    for row in rows.toLocalIterator():
        if ids and held + len(row.text) > block_bytes:
            yield Items(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text)
    yield Items(ids, texts, window)


def frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How often each of ``terms`` occurs in the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for own, counts in zip(batch.column("terms"), batch.column("counts")):
                at = pc.index_in(terms, value_set=own.values.cast(pa.binary())) if len(own.values) else pa.nulls(len(terms), pa.int32())
                found = at.is_valid().to_numpy(zero_copy_only=False)
                total[found] += np.asarray(counts.values, dtype=np.int64)[at.drop_null().to_numpy(zero_copy_only=False)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[term] = n
    return out


HITS = "segment string, ordinal int, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"


def _matches(index: DataFrame, items: Items, slop: int | None = None) -> DataFrame:
    """A row for each document of the index: spans of words inside any exact
    occurrence (both ends inclusive, disjoint, in order), the items hit, and
    with ``slop`` the items near."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "segment", 1):
            segment = Segment(batch, items.terms)
            window, start = segment.phrases(items) if len(segment.keys) else (np.empty(0, np.int64),) * 2
            doc = np.searchsorted(segment.begin, start, side="right") - 1
            spans: dict[int, list[list[int]]] = {}
            found: dict[int, set[str]] = {}
            for k in np.lexsort((start, doc)).tolist():
                d, w = int(doc[k]), int(window[k])
                a = int(start[k] - segment.begin[d])
                b = a + int(items.lens[w]) - 1
                own = spans.setdefault(d, [])
                if own and a <= own[-1][1] + 1:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
                found.setdefault(d, set()).update(items.items[w])
            around: dict[int, set[str]] = {}
            if slop is not None and len(segment.keys):
                window, place = segment.near(items, slop)
                doc = np.searchsorted(segment.begin, place, side="right") - 1
                for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                    around.setdefault(d, set()).update(items.items[w])
            n = len(segment.n_words)
            pair = pa.struct([("first", pa.int32()), ("last", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment.name] * n, pa.string()),
                    pa.array(range(n), pa.int32()),
                    segment.doc_ids,
                    pa.array(segment.n_words),
                    pa.array([[{"first": a, "last": b} for a, b in spans.get(d, ())] for d in range(n)], pa.list_(pair)),
                    *[pa.array([sorted(told.get(d, ())) for d in range(n)], pa.list_(pa.string())) for told in (found, around)],
                ],
                names=["segment", "ordinal", "doc_id", "n_words", "spans", "items", "near"],
            )

    return index.mapInArrow(match, f"{HITS}, near array<string>")


def phrase_match(index: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int | None = None) -> DataFrame:
    """``doc_id, n_words, spans, items`` for each document of the index, and
    with ``slop`` the items ``near`` it. The
    hits of each block but a single one are written, so the driver holds one
    block at a time."""
    blocks = item_blocks(items, window, block_bytes)
    block, more = next(blocks), next(blocks, None)
    all_hits, lists = None, ["items"] if slop is None else ["items", "near"]
    while block is not None:
        block.rank(frequencies(index, block.terms))
        part = _matches(index, block, slop)
        if all_hits is None and more is None:
            return part.select("doc_id", "n_words", "spans", *lists)
        part = materialise(part, "hits")
        all_hits = part if all_hits is None else all_hits.unionByName(part)
        block, more = more, next(blocks, None)
    merged = F.expr(
        """aggregate(array_sort(flatten(collect_list(spans))), cast(array() AS array<struct<first:int,last:int>>),
           (acc, s) -> CASE WHEN size(acc) > 0 AND s.first <= element_at(acc, -1).last + 1
                       THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, s.last))))
                       ELSE concat(acc, array(s)) END)"""
    )
    return all_hits.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged.alias("spans"), *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]).drop("segment", "ordinal")


def proximity_match(index: DataFrame, items: DataFrame, slop: int, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, place``: occurrences of a window's rarest term with
    all its other terms within ``slop`` words, in any order."""
    out = None
    for block in item_blocks(items, window, block_bytes):
        block.rank(frequencies(index, block.terms))

        def match(batches: Iterator[pa.RecordBatch], items: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "segment", 1):
                segment = Segment(batch, items.terms)
                window, place = segment.near(items, slop) if len(segment.keys) else (np.empty(0, np.int64),) * 2
                doc = np.searchsorted(segment.begin, place, side="right") - 1
                rows = sorted({(int(d), i, int(p - segment.begin[d])) for w, p, d in zip(window, place, doc) for i in items.items[w]})
                yield pa.RecordBatch.from_arrays([segment.doc_ids.take(pa.array([d for d, _, _ in rows], pa.int64())), pa.array([i for _, i, _ in rows], pa.string()), pa.array([p for _, _, p in rows], pa.int32())], names=["doc_id", "item_id", "place"])

        part = index.mapInArrow(match, "doc_id bigint, item_id string, place int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int | None = None) -> DataFrame:
    """``doc_id, n_words, spans, items`` for each row of ``docs``, and with
    ``slop`` the items ``near`` it."""
    return phrase_match(materialise(build_index(docs), "postings"), items, window, block_bytes, slop)

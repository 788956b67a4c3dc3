"""Set-similarity join of documents on word shingles, by PartEnum signatures.

Sizes are cut into bands such that two sets that are similar enough fall into
one instance (a band and the sizes that a partner of its sets can have). In an
instance two similar sets differ in at most k shingles. The domain of shingles
is cut into groups of parts by hash; with enough groups one of them differs in
at most ``misses`` parts, so the two sets agree on the others, and share the
signature of that subset. A set with more unshared signatures than such a
difference allows has no partner and goes before any pair is made.

Sets are compared once per distinct set (its class), so copies cost nothing. A
signature shared by several classes first gives the pairs of its smallest
class with the others; pairs of classes that are still in different components
follow. Every pair is verified exactly, and no pair that could join two
components is left out, so components and membership are whole.

Defined results: null texts, empty texts and texts without words have no
shingles, are their own component and link with nothing; a text with fewer
words than a shingle has one, all its words; rows of one ``doc_id`` are one
class or several, linked as documents are; ``doc_id`` must not be null (such
rows are left out). Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import _bitmap
from codeweft.llm._graph import linked
from codeweft.llm._store import discard, materialise
from codeweft.llm._words import SPACED_LOWER, buffers, grams, mix, release, slices, split
from codeweft.runtime import ship

WIDTH = 5
#: Bytes of text whose signatures a task works out at once.
SLICE = 1 << 19
#: Bits of a set's odd sketch.
SKETCH = 1024
#: Similarity from which two documents link, as a fraction.
SIMILAR = (80, 100)

@dataclass(frozen=True)
class Scheme:
    """How an instance is cut. A group has ``misses + subset`` parts, and a
    signature for each choice of ``subset`` of them. ``slack`` times as many
    groups as the pigeonhole needs are made; the more, the more of them two
    similar sets agree on, which tells sets without any partner early."""

    misses: int = 1
    subset: int = 2
    slack: float = 1.0


#: For similarities of 0.9 and more a signature of two sub-parts covers enough
#: shingles; below, extra parts are needed to tell sets without a partner.
FEW, MANY = Scheme(1, 2, 1.0), Scheme(1, 1, 1.5)
#: Sets that may have a partner are cut once more, into many parts of one unit:
#: about as many as there are shingles, for either range of similarities.
FINE_FEW, FINE_MANY = Scheme(0, 1, 6.0), Scheme(0, 1, 2.5)


def scheme_for(similar: tuple[int, int]) -> Scheme:
    return FEW if 10 * similar[0] >= 9 * similar[1] else MANY


def fine_for(similar: tuple[int, int]) -> Scheme:
    return FINE_FEW if 10 * similar[0] >= 9 * similar[1] else FINE_MANY


class Bands:
    """Band starts and, for each instance, its largest size, its number of
    groups and of how many units (parts if a subset is one part, else groups)
    two similar sets may disagree."""

    def __init__(self, similar: tuple[int, int], largest: int, scheme: Scheme):
        num, den = similar
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * den * den // (num * num) + 1)
        self.starts = np.array(starts)
        self.high = (np.append(self.starts[1:], starts[-1] * 4) - 1) * den // num
        self.k = 2 * self.high * (den - num) // (den + num)
        self.groups = np.ceil(scheme.slack * (self.k // (scheme.misses + 1) + 1)).astype(np.int64)
        self.differ = self.k if scheme.subset == 1 else self.k // (scheme.misses + 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the borders."""
    words = split(data, offs, SPACED_LOWER)
    h = words.hashes()
    n = np.diff(words.docs)
    every = grams(h, width)
    parts = []
    for a, size in zip(words.docs[:-1].tolist(), n.tolist()):
        if size >= width:
            parts.append(np.sort(every[a : a + size - width + 1]))
        elif size:
            parts.append(grams(h[a : a + size], size))
        else:
            parts.append(h[:0])
    flat = np.concatenate(parts) if parts else h[:0]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(parts)))]).astype(np.int64)


@dataclass
class Signatures:
    """Signatures of some sets: for each its set, instance and unit, and how
    many units of that instance may differ."""

    value: np.ndarray
    owner: np.ndarray
    band: np.ndarray
    unit: np.ndarray
    differ: np.ndarray


def signatures(flat: np.ndarray, ends: np.ndarray, similar: tuple[int, int], scheme: Scheme) -> Signatures:
    size = np.diff(ends)
    bands = Bands(similar, int(size.max(initial=1)), scheme)
    own = np.searchsorted(bands.starts, size, side="right") - 1
    mixed = mix(flat)
    parts = scheme.misses + scheme.subset
    out: list[tuple[np.ndarray, ...]] = []
    for back in range(3):
        band = own - back
        some = np.flatnonzero((size > 0) & (band >= 0) & (size <= bands.high[np.maximum(band, 0)]) & (bands.k[np.maximum(band, 0)] > 0))
        if not len(some):
            continue
        groups = bands.groups[band[some]]
        base = np.cumsum(groups) - groups
        members = np.repeat(ends[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        cell = (flat[members] % np.repeat(groups * parts, size[some]).astype(np.uint64)).astype(np.int64) + np.repeat(base * parts, size[some])
        held = np.zeros(groups.sum() * parts, dtype=np.uint64)
        np.add.at(held, cell, mixed[members])
        held = held.reshape(-1, parts)
        group = np.arange(len(held)) - np.repeat(base, groups)
        tag = mix((np.repeat(band[some], groups).astype(np.uint64) << np.uint64(40)) + group.astype(np.uint64))
        for k, chosen in enumerate(combinations(range(parts), scheme.subset)):
            value = tag + np.uint64(k + 1)
            for part in chosen:
                value = mix(value ^ held[:, part])
            unit = group * parts + k if scheme.subset == 1 else group
            out.append((value, np.repeat(some, groups), np.repeat(band[some], groups), unit, np.repeat(bands.differ[band[some]], groups)))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return Signatures(none.astype(np.uint64), none, none, none, none)
    value, owner, band, unit, differ = (np.concatenate(x) for x in zip(*out))
    return Signatures(value, owner, band, unit, differ)


def alive(found: Signatures, maybe: np.ndarray, scheme: Scheme, similar: tuple[int, int], size: np.ndarray) -> np.ndarray:
    """Which of the signatures marked ``maybe`` belong to a set that can have
    a partner in the instance: one with no more unshared units than may differ."""
    place = (found.owner << 8) | found.band
    unit = (place << 32) | found.unit
    names, at = np.unique(unit, return_inverse=True)
    shared = np.zeros(len(names), dtype=bool)
    shared[at[maybe]] = True
    sets, where = np.unique(names >> 32, return_inverse=True)
    dead = np.bincount(where, weights=~shared, minlength=len(sets))
    limit = np.zeros(len(sets), dtype=np.int64)
    limit[where[at]] = found.differ
    fine = dead <= limit
    return maybe & fine[where[at]]


def _arrays(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def _input(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _classes(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    n = np.diff(ends).astype(np.uint64)
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    cls, check = (mix((t[ends[1:]] - t[ends[:-1]]) ^ n).view(np.int64) for t in total)
    return cls, check


def described(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, cls, check``: size and class of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            flat, ends = shingle_sets(*buffers(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends)), *map(pa.array, _classes(flat, ends))], names=["doc_id", "n", "cls", "check"])

    return _input(docs).mapInArrow(run, "doc_id bigint, n bigint, cls bigint, check bigint")


def _survivors(docs: DataFrame, width: int, similar: tuple[int, int], scheme: Scheme) -> DataFrame:
    """``cls`` of the sets that share enough signatures with other sets to
    have a partner."""

    def run(bitmap: _bitmap.Bitmap | None):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=SLICE):
                flat, ends = shingle_sets(*buffers(batch.column("text")), width)
                cls, _ = _classes(flat, ends)
                # copies in a slice are taken once
                first = np.zeros(len(cls), dtype=bool)
                first[np.unique(cls, return_index=True)[1]] = True
                found = signatures(flat, ends, similar, scheme)
                keep = first[found.owner]
                if bitmap is None:
                    yield pa.RecordBatch.from_arrays([pa.array(found.value[keep].view(np.int64)), pa.array(cls[found.owner[keep]])], names=["sig", "cls"])
                    continue
                keep &= alive(found, _bitmap.test(bitmap, found.value), scheme, similar, np.diff(ends))
                yield _rows(found, keep, cls, np.diff(ends))

        return rows

    every = _input(docs).mapInArrow(run(None), "sig bigint, cls bigint")
    several = materialise(every.groupBy("sig").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("sig"), "several")
    rows = _input(docs).mapInArrow(run(_bitmap.build(several, "sig")), ROWS).join(several, "sig", "left_semi")
    if scheme.subset > 1:
        found = materialise(rows.select("cls").distinct(), "survivors")
    else:
        shared = materialise(rows.distinct(), "shared")
        ranked, often = _ranked(shared, scheme)
        found = materialise(ranked.select("cls").distinct(), "survivors")
        discard(shared, often)
    discard(several)
    return found


ROWS = "sig bigint, cls bigint, n bigint, band bigint, unit bigint, differ bigint"


def _rows(found: Signatures, keep: np.ndarray, cls: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    owner = found.owner[keep]
    return pa.RecordBatch.from_arrays([pa.array(found.value[keep].view(np.int64)), pa.array(cls[owner]), pa.array(size[owner]), pa.array(found.band[keep]), pa.array(found.unit[keep]), pa.array(found.differ[keep])], names=["sig", "cls", "n", "band", "unit", "differ"])


def _buckets(held: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``sig, cls, n, lead``: of the fine signatures of each set only the
    rarest that are needed for similar sets to have one in common. ``lead`` is
    smallest for the set that shares most."""
    scheme = fine_for(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                sets = part.column("members")
                flat = np.asarray(sets.flatten()).view(np.uint64)
                ends = np.asarray(sets.offsets).astype(np.int64)
                ends = ends - ends[0]
                found = signatures(flat, ends, similar, scheme)
                yield _rows(found, np.ones(len(found.value), dtype=bool), np.asarray(part.column("cls")), np.diff(ends))
        release()

    rows = held.select("cls", "members").mapInArrow(run, ROWS)
    ranked, often = _ranked(rows, scheme)
    fine = materialise(ranked.drop("place", "lead"), "fine")
    discard(often)
    ranked, often = _ranked(fine, scheme)
    rare = materialise(ranked.where("place <= differ + 1").select("sig", "cls", "n", "lead"), "rare")
    discard(fine, often)
    return rare


def _ranked(rows: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """The rows of sets that still share enough units, with the place of each
    unit among all of its set, rarest first, and the table of counts that they
    are read with. Of p units similar sets agree on p - differ, so the
    differ + 1 rarest of one meet those of the other."""
    parts = F.ceil(F.lit(scheme.slack) * (F.floor(F.col("differ") / (scheme.misses + 1)) + 1)) * (scheme.misses + scheme.subset)
    often = materialise(rows.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1"), "often")
    own = Window.partitionBy("cls", "band")
    counted = rows.join(often, "sig").withColumn("units", F.count("*").over(own)).where(F.col("units") >= parts - F.col("differ"))
    counted = counted.withColumn("lead", parts - F.col("units"))
    return counted.withColumn("place", F.row_number().over(own.orderBy("often", "sig")) + F.col("lead")).drop("often", "units"), often


def _verified(pairs: DataFrame, members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    num, den = similar
    a, b = members.select(F.col("cls").alias("u"), F.col("members").alias("mu")), members.select(F.col("cls").alias("v"), F.col("members").alias("mv"))
    both = F.size(F.array_intersect("mu", "mv"))
    found = pairs.join(a, "u").join(b, "v").withColumn("both", both)
    return found.where(den * F.col("both") >= num * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def odd_sketches(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each set ``SKETCH`` bits, each the parity of the shingles that fall
    on it: two sets differ in no fewer shingles than their sketches in bits."""
    n = len(ends) - 1
    at = mix(flat ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH)
    cell = at.astype(np.int64) + np.repeat(np.arange(n), np.diff(ends)) * SKETCH
    bits = (np.bincount(cell, minlength=n * SKETCH) & 1).astype(np.uint8)
    words = np.packbits(bits).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(words))


def _within(similar: tuple[int, int]) -> Callable[[str, str], Column]:
    """Whether the sketches of two sets allow them to be similar."""
    num, den = similar

    def test(a: str, b: str) -> Column:
        differ = sum((F.bit_count(F.get(f"{a}odd", F.lit(k)).bitwiseXOR(F.get(f"{b}odd", F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
        return (den + num) * differ <= (den - num) * (F.col(f"{a}n") + F.col(f"{b}n"))

    return test


def links(docs: DataFrame, sets: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame | None:
    """``vertex, component`` over classes that link with another class, or
    None if no two classes have enough in common."""
    # one document of each class that may have a partner, and its set
    concerned = _survivors(docs, width, similar, scheme_for(similar))
    chosen = materialise(sets.join(concerned, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("chosen")).where("chosen IS NOT NULL"), "chosen")
    discard(concerned)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            flat, ends = shingle_sets(*buffers(batch.column("text")), width)
            # rows of one doc_id may have other texts, whose sets are of other classes
            own = pa.array(_classes(flat, ends)[0] == np.asarray(batch.column("cls")))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), _arrays(flat, ends), odd_sketches(flat, ends)], names=["cls", "members", "odd"]).filter(own)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("chosen"), F.col("text").cast("string").alias("text")).join(chosen, "chosen").select("cls", "text")
    held = materialise(texts.mapInArrow(members, "cls bigint, members array<bigint>, odd array<bigint>").dropDuplicates(["cls"]), "members")
    discard(chosen)
    rare = _buckets(held, similar)
    labels = linked(rare, similar, lambda pairs: _verified(pairs, held, similar), sketch=lambda rows: rows.join(held.select("cls", "odd"), "cls"), close=_within(similar))
    discard(rare, held)
    return labels


def jaccard_components(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for each document:
    ``class_id`` is the smallest doc_id with the same set, ``component_id``
    the smallest that links lead to."""
    sets = materialise(described(docs, width), "sets")
    labels = links(docs, sets, width, similar)
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls", "check").agg(F.min("doc_id").alias("class_id"))
    if labels is not None:
        roots = materialise(classes.join(labels.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls")), "roots")
        lowest = materialise(roots.groupBy("root").agg(F.min("class_id").alias("component_id")), "lowest")
        classes = materialise(roots.join(lowest, "root").select("cls", "check", "class_id", "component_id"), "classes")
        discard(labels, roots, lowest)
    else:
        classes = materialise(classes.withColumn("component_id", F.col("class_id")), "classes")
    out = sets.join(classes, ["cls", "check"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

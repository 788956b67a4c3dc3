"""Vector code compression: product codes found by partial-distance search.

Components become integers, a vector is cut into equal consecutive parts, and
each part is replaced by the index of its nearest codebook entry (squared
Euclidean distance, ties to the lower index). The search takes a part's
dimensions in descending variance of the codebook. After each stretch of
dimensions it completes the distance of the entry that is ahead, and a mask
drops every entry whose accumulated distance strictly exceeds the best
complete one so far, so most entries never see most dimensions. All sums are
integers: results don't depend on batches, partitions or retries.

A round of the fit is one pass over the vectors: a task sends the sums of each
entry that it met (``parts * entries`` rows at most), Spark adds them up, and
the driver holds the codebooks alone, whose size doesn't follow the data.

Defined results: rows whose vector is null or holds null, NaN or infinite
components aren't returned. The number of dimensions is that of the first kept
vector by id (then by components) that can be cut; kept vectors of another
number of dimensions, or with a component beyond ``largest()`` (distances
might not fit a long), are returned with null ``code`` and ``error`` and fit
nothing. Rows that share an id are separate vectors, all of them encoded; null
ids come last when the codebooks start. Fewer vectors than entries start
smaller codebooks. An empty table gives an empty result. Other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from codeweft.llm._store import materialise
from codeweft.runtime import ship

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors that are compared with a codebook at once, which bounds memory.
BLOCK = 1024
#: Dimensions between two looks at which entries are still in the race.
STRETCH = 4


@dataclass
class Codebooks:
    """``books[p]``: entries of part ``p`` by rows, as integers."""

    books: list[np.ndarray]
    dim: int
    scale: int

    @property
    def sha256(self) -> str:
        values = (str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(",".join(values).encode()).hexdigest()


def largest(dim: int) -> int:
    """Integers up to this size give distances over ``dim`` dimensions that fit
    a long."""
    return int(np.sqrt(2.0**61 / max(dim, 1)) / 2)


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions by descending variance over the entries, then by place."""
    wide = book.astype(np.float64)
    return np.argsort(-wide.var(axis=0), kind="stable")


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row."""
    order = search_order(book)
    reach = max(int(np.abs(block).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * reach * reach * book.shape[1] < 2**31 else np.int64
    # One row for each dimension, in the order of the search.
    x, c = (np.ascontiguousarray(m[:, order].T.astype(kind)) for m in (block, book))
    n, every = block.shape[0], np.arange(block.shape[0])
    best = np.full(n, np.iinfo(kind).max, kind)

    def complete(leader: np.ndarray) -> None:
        apart = x - c[:, leader]
        np.minimum(best, np.einsum("ij,ij->j", apart, apart), out=best)

    # The first stretch meets every entry; from then on only those that are left.
    gone = np.zeros((n, book.shape[0]), kind)
    for j in range(min(STRETCH, len(order))):
        apart = x[j][:, None] - c[j][None, :]
        gone += apart * apart
    complete(gone.argmin(axis=1))
    rows, entries = np.nonzero(gone <= best[:, None])
    gone = gone[rows, entries]
    for begin in range(STRETCH, len(order), STRETCH):
        for j in range(begin, min(begin + STRETCH, len(order))):
            apart = x[j][rows] - c[j][entries]
            gone += apart * apart
        # The entry that is ahead in each row; a row always has its best one.
        first = np.searchsorted(rows, every)
        ahead = np.minimum.reduceat(gone, first)
        lead = np.flatnonzero(gone == ahead[rows])
        lead = lead[np.searchsorted(rows[lead], every)]
        complete(entries[lead])
        left = gone <= best[rows]
        rows, entries, gone = rows[left], entries[left], gone[left]
    # Whole distances now; of equal ones the lowest index comes first.
    ahead = np.minimum.reduceat(gone, np.searchsorted(rows, every))
    lead = np.flatnonzero(gone == ahead[rows])
    lead = lead[np.searchsorted(rows[lead], every)]
    return entries[lead], gone[lead].astype(np.int64)


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def _codes(vectors: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its integers, entries, distances), block by block."""
    width = vectors.shape[1] // len(books)
    for at in range(0, len(vectors), BLOCK):
        for p, book in enumerate(books):
            block = vectors[at : at + BLOCK, p * width : (p + 1) * width]
            yield p, block, *nearest(block, book)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _fits(vector: Column, dim: int, scale: int) -> Column:
    return (F.size(vector) == dim) & F.forall(vector, lambda x: F.abs(x * scale) <= largest(dim))


def _vectors(table: DataFrame, vector: str) -> DataFrame:
    """``table`` with kept vectors only, as doubles."""
    as_double = F.col(vector).cast("array<double>")
    return table.where(_finite(as_double)).withColumn(vector, as_double)


def start_codebooks(table: DataFrame, ident: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of the first kept vectors by id; None where no kept vector
    can be cut into parts. ``entries`` rows come to the driver."""
    order = [F.asc_nulls_last(ident), F.asc(vector)]
    kept = _vectors(table.select(ident, vector), vector).where((F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = kept.orderBy(*order).select(F.size(vector)).first()
    if first is None:
        return None
    dim = first[0]
    seeds = kept.where(_fits(F.col(vector), dim, scale)).orderBy(*order).limit(entries).select(vector).collect()
    if not seeds:
        return None
    whole = np.floor(np.array([r[0] for r in seeds], np.float64) * scale).astype(np.int64)
    return Codebooks(np.split(whole, parts, axis=1), dim, scale)


def refine(table: DataFrame, vector: str, now: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, and an entry becomes
    the floor of its parts' mean; entries without parts stay."""
    books, dim, scale = now.books, now.dim, now.scale
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for p, block, found, _ in _codes(_integers(batch.column(0), dim, scale), books):
                order = np.argsort(found, kind="stable")
                used, first = np.unique(found[order], return_index=True)
                sums[p][used] += np.add.reduceat(block[order], first, axis=0)
                counts[p] += np.bincount(found, minlength=len(books[p]))
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            values = pa.array(sums[p][used].ravel())
            offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), pa.ListArray.from_arrays(offsets, values)], ["part", "entry", "n", "sums"])

    fit = table.select(vector).transform(_vectors, vector).where(_fits(F.col(vector), dim, scale))
    met = fit.mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(width)]).alias("sums"))
    books = [b.copy() for b in books]
    for r in total.collect():  # at most parts * entries rows
        books[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return Codebooks(books, dim, scale)


def fit_codebooks(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all kept vectors."""
    ship(table.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: entries must be 1 to 256")
    now = start_codebooks(table, ident, vector, parts, entries, scale)
    for _ in range(rounds if now else 0):
        now = refine(table, vector, now)
    return now


def encode_vectors(table: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """Kept rows of ``table`` with ``code`` (two hex digits for each part) and
    ``error`` (squared distances summed) in place of columns of these names."""
    ship(table.sparkSession)
    kept = _vectors(table.drop("code", "error"), vector)
    if books is None:
        return kept.withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("bigint")})
    entries, dim, scale = books.books, books.dim, books.scale
    place = kept.columns.index(vector)
    schema = StructType([*kept.schema.fields]).add("code", StringType()).add("error", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column(batch.num_columns - 1)
            vectors = _integers(batch.column(place).filter(fits), dim, scale)
            codes = np.zeros((len(vectors), len(entries)), np.uint8)
            error = np.zeros(len(vectors), np.int64)
            at = 0
            for p, block, found, apart in _codes(vectors, entries):
                codes[at : at + len(block), p] = found
                error[at : at + len(block)] += apart
                at += len(block) if p == len(entries) - 1 else 0
            text = codes.tobytes().hex()
            step = 2 * len(entries)
            written = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            coded = fits.to_numpy(zero_copy_only=False)
            # A place without a vector takes a null.
            source = pa.array(np.cumsum(coded) - 1, mask=~coded)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], written.take(source), pa.array(error).take(source)], names=schema.names)

    return kept.withColumn("__fits", _fits(F.col(vector), dim, scale)).mapInArrow(run, schema)


def vector_codes(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``ident``, ``label``, ``code``, ``error``, ``label_error`` and
    ``codebooks_sha256`` of each kept vector. ``label_error`` adds ``error``
    over rows of equal labels, nulls together; it is null where the sum
    doesn't fit a long."""
    books = fit_codebooks(table, ident, vector, rounds)
    coded = materialise(encode_vectors(table.select(ident, label, vector), books, vector).select(ident, label, "code", "error"), "codes")
    totals = coded.groupBy(F.col(label).alias("__label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(materialise(totals, "label_errors"), F.col(label).eqNullSafe(F.col("__label")))
    return joined.select(ident, label, "code", "error", "label_error", F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256"))

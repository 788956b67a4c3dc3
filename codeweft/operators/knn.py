"""Nearest vectors for many queries at once, and an exact index for few.

``nearest`` compares a query set with all vectors in blocks: queries are packed
into matrices of bounded size, every task takes matrix products of its vectors
with each of them, and keeps the best ``k`` of each query so far. What moves is
``k`` rows for each query and task.

``build`` stores vectors by cell: each vector lies with its nearest centroid,
and a cell knows how far its farthest vector is from it. A query takes the
cells in order of the least distance that any of their vectors can have (the
triangle inequality) and reads only those that may still hold one of the ``k``
nearest. The result is exact; ``share`` tells how much was read. Distances are
between directions, whose order is that of the cosine; vectors without a
direction have the cosine 0 to all and lie in a cell of their own that is
always read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeweft.operators.vector import cosine
from codeweft.runtime import settled, ship, shared_folder

#: Queries of a matrix, vectors that meet a matrix at once, matrices of a task.
QUERIES, VECTORS, MATRICES = 1024, 2048, 8
#: Vectors that centroids are drawn from, at most.
SAMPLE = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _directions(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a direction stay 0."""
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by descending score, then id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, by: Sequence[str] = (), keep_self: bool = False) -> DataFrame:
    """``query_id, *by, rank, id, score`` of the ``k`` vectors with the highest
    cosine for each query: ``vectors(id, vector, *by)`` with numbers or strings
    as ids, ``queries(query_id bigint, vector)``; ties go to the lower id. With
    ``by`` (strings), the best of each group. A query's own row (``id =
    query_id``) counts only with ``keep_self``. Rows with a null id or vector
    don't take part; all have one length."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["id"].dataType.simpleString()
    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = settled(asked.mapInArrow(_pack_queries, "query_ids array<bigint>, matrix binary"))
    chunks = max(1, -(-blocks.count() // MATRICES))
    blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("query_ids"), F.lit(chunks)))
    rows = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"), *by)
    packed = rows.mapInArrow(_pack_vectors(len(by)), f"ids array<{kind}>, vectors binary, groups array<string>")
    # A grid: some vectors meet some queries, and neither side is ever whole in
    # one task.
    packed = settled(packed)
    cells = max(1, -(-packed.count() // MATRICES))
    placed = packed.withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    copies = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))))
    shape = "query_id bigint, " + "".join(f"{c} string, " for c in by) + f"id {kind}, score double"
    found = placed.groupBy("cell", "chunk").cogroup(copies.groupBy("cell", "chunk")).applyInArrow(_compare(k, list(by), keep_self, kind), shape)
    best = found.groupBy("query_id", *by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    return best.select("query_id", *by, F.posexplode("best").alias("rank", "b")).select("query_id", *by, (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, QUERIES):
            part = batch.slice(begin, QUERIES)
            yield pa.RecordBatch.from_pydict({"query_ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "matrix": pa.array([_directions(_matrix(part.column(1))).tobytes()], pa.binary())})


def _pack_vectors(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                part = batch.slice(begin, VECTORS)
                named = ["\u0001".join(x or "" for x in row) for row in zip(*(part.column(2 + g).to_pylist() for g in range(groups)))]
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), "vectors": pa.array([_directions(_matrix(part.column(1))).tobytes()], pa.binary()), "groups": pa.array([named], pa.list_(pa.string()))})

    return run


def _compare(k: int, by: list[str], keep_self: bool, kind: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], **{c: [] for c in by}, "id": [], "score": []}
        for query_ids, raw in zip(right.column("query_ids").to_pylist(), right.column("matrix").to_pylist()):
            asked = np.frombuffer(raw, np.float64).reshape(len(query_ids), -1)
            held: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
            for some_ids, some, groups in zip(left.column("ids").to_pylist(), left.column("vectors").to_pylist(), left.column("groups").to_pylist()):
                ids = np.array(some_ids)
                scores = asked @ np.frombuffer(some, np.float64).reshape(len(ids), -1).T
                names = np.array(groups if by else [""] * len(ids))
                for name in np.unique(names):
                    mine = names == name
                    for q, query in enumerate(query_ids):
                        keep = mine if keep_self else mine & (ids != query)
                        a, b = ids[keep], scores[q][keep]
                        if (q, name) in held:
                            a, b = np.concatenate([held[q, name][0], a]), np.concatenate([held[q, name][1], b])
                        held[q, name] = _best(a, b, k)
            for (q, name), (ids, scores) in held.items():
                out["query_id"] += [query_ids[q]] * len(ids)
                for c, value in zip(by, str(name).split("\u0001")):
                    out[c] += [value] * len(ids)
                out["id"] += ids.tolist()
                out["score"] += scores.tolist()
        own = {"query_id": pa.int64(), "id": pa.string() if kind == "string" else {"int": pa.int32()}.get(kind, pa.int64()), "score": pa.float64()}
        return pa.table({c: pa.array(v, own.get(c, pa.string())) for c, v in out.items()})

    return run


@dataclass(frozen=True)
class Cells:
    """A stored index: ``centroids`` (of length 1), ``radius`` (the distance of
    the farthest vector of each cell, NaN for an empty one) and rows of each."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    schema: StructType

    def read(self, cells: Sequence[int]) -> DataFrame:
        """The vectors of these cells and those without a direction; other files
        aren't opened."""
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("cell").isin(-1, *[int(c) for c in cells]))


def build(vectors: DataFrame, cells: int = 64, path: str | None = None, rounds: int = 3) -> Cells:
    """Store ``vectors(id, vector, ...)`` by cell. Centroids are fit on at most
    ``SAMPLE`` vectors, by a hash of the id; every vector is stored."""
    spark = vectors.sparkSession
    ship(spark)
    path = path or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-settled/{uuid.uuid4().hex}"
    rows = vectors.where("vector IS NOT NULL").withColumn("vector", F.col("vector").cast("array<double>"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    points = _directions(np.array([r[0] for r in sample], np.float64)) if sample else np.zeros((0, 1))
    points = points[np.linalg.norm(points, axis=1) > 0]
    begin = np.unique(points, axis=0)
    centroids = begin[np.linspace(0, len(begin) - 1, min(cells, len(begin))).astype(int)] if len(begin) else points
    for _ in range(rounds if len(points) else 0):
        own = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        fresh = _directions(sums)
        centroids = np.where(np.linalg.norm(fresh, axis=1, keepdims=True) > 0, fresh, centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _directions(_matrix(batch.column(at)))
            if len(centroids):
                near = own @ centroids.T
                cell, far = near.argmax(axis=1), np.linalg.norm(own - centroids[near.argmax(axis=1)], axis=1)
            else:
                cell, far = np.zeros(len(own), int), np.zeros(len(own))
            none = np.linalg.norm(own, axis=1) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(none, -1, cell).astype(np.int32)), pa.array(np.where(none, 0.0, far))], names=[*batch.schema.names, "cell", "far"])

    at = rows.columns.index("vector")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, far double"
    # A large cell is dealt out over several tasks and files.
    placed = rows.mapInArrow(place, shape).repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8)))
    placed.write.partitionBy("cell").parquet(path)
    told = {r.cell: r for r in spark.read.schema(placed.schema).parquet(path).groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # one row a cell
    return Cells(spark, path, centroids, np.array([told[c].far if c in told else np.nan for c in range(len(centroids))]), np.array([told[c].n if c in told else 0 for c in range(len(centroids))], int), placed.schema)


def search(index: Cells, query: Sequence[float], k: int = 10) -> tuple[DataFrame, float]:
    """(``id, score`` of the ``k`` vectors with the highest cosine, ties to the
    lower id; the share of the stored vectors that was read for it)."""
    asked = _directions(np.array([query], np.float64))[0]
    whole = max(1, int(index.rows.sum()))
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    top = lambda cells: index.read(cells).select("id", score.alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)
    full = np.flatnonzero(index.rows)
    if not asked.any() or not len(full):
        return top(full), 1.0
    least = np.maximum(0.0, np.linalg.norm(index.centroids - asked, axis=1) - index.radius)
    order = full[np.argsort(least[full], kind="stable")]
    # As many cells as hold k vectors give a distance that the k nearest keep to.
    enough = int(np.searchsorted(np.cumsum(index.rows[order]), k)) + 1
    first = top(order[:enough]).collect()
    bound = np.sqrt(max(0.0, 2 - 2 * first[-1].score)) if len(first) == k else np.inf
    needed = order[least[order] <= bound + 1e-9]
    return top(needed), float(index.rows[np.union1d(needed, order[:enough])].sum() / whole)

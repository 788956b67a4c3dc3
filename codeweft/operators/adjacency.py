"""Edges stored for traversal.

Each edge is written twice, once under either end, partitioned by ``rel_type``
and bucketed and sorted by the end it stands under. A hop joins the frontier
with that table on the bucketed columns: the table is scanned once, never
shuffled, and of the types asked for only. A frontier may belong to many
searches at once (``by``): all of them share the scan.

A node with very many edges (a hub) is cut into slices by a hash of the other
end, so no bucket and no task has more than some ``SLICE`` rows of one node; the
few hubs are kept as a list that tells a frontier how many slices there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.traverse import check_depth, with_names
from codeweft.runtime import settled, shared_folder
from codeweft.schema import Graph

SLICE = 100_000
_ROW = "label string, id string, slice int, outward boolean, to_label string, to_id string, repo_id string, rel_type string"
_EDGE = ["repo_id", "src_label", "src_id", "rel_type", "dst_label", "dst_id"]


@dataclass(frozen=True)
class Adjacency:
    """``table`` (bucketed, ``label, id, slice, outward, to_label, to_id, repo_id,
    rel_type``) and ``hubs`` (``label, id, slices``)."""

    name: str
    path: str
    buckets: int
    spark: SparkSession

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def hubs(self) -> DataFrame:
        return self.spark.read.schema("label string, id string, slices int").parquet(f"{self.path}/hubs")

    def drop(self) -> None:
        """Take the name back; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def at(self, frontier: DataFrame, by: Sequence[str] = (), types: Sequence[str] | None = None, outward: bool | None = None) -> DataFrame:
        """The edges at the nodes ``frontier(label, id, *by)``: rows of ``table``
        with ``by``. One scan, of the types and the direction asked for."""
        rows = self.table
        if types is not None:
            rows = rows.where(F.col("rel_type").isin(*types))
        if outward is not None:
            rows = rows.where(F.col("outward") == outward)
        sliced = frontier.select("label", "id", *by).join(self.hubs, ["label", "id"], "left")
        sliced = sliced.select("label", "id", *by, F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
        return rows.join(sliced, ["label", "id", "slice"])


def _either(edges: DataFrame) -> DataFrame:
    """Each edge under both ends."""
    out = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id"), F.lit(True).alias("outward"), F.col("dst_label").alias("to_label"), F.col("dst_id").alias("to_id"), "repo_id", "rel_type")
    back = edges.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id"), F.lit(False).alias("outward"), F.col("src_label").alias("to_label"), F.col("src_id").alias("to_id"), "repo_id", "rel_type")
    return out.unionByName(back)


def store(edges: DataFrame, path: str | None = None, buckets: int | None = None, most: int = SLICE) -> Adjacency:
    """Write ``edges`` (as in ``Graph``) for traversal. ``path`` keeps the files
    (``reopen`` finds them again), else they lie in the shared folder."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-settled/{uuid.uuid4().hex}"
    both = _either(settled(edges.select(*_EDGE)))
    counted = both.groupBy("label", "id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    counted.select("label", "id", F.ceil(F.col("n") / most).cast("int").alias("slices")).write.parquet(f"{path}/hubs")
    adjacency = Adjacency(f"adjacency_{uuid.uuid4().hex}", path, buckets, spark)
    marked = both.join(adjacency.hubs, ["label", "id"], "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("outward", "to_label", "to_id", "rel_type"), F.col("slices")).cast("int"), F.lit(0)))
    rows = marked.select("label", "id", "slice", "outward", "to_label", "to_id", "repo_id", "rel_type").repartition(buckets, "label", "id", "slice")
    rows.write.partitionBy("rel_type").bucketBy(buckets, "label", "id", "slice").sortBy("label", "id", "slice").format("parquet").option("path", f"{path}/edges").saveAsTable(adjacency.name)
    return adjacency


def reopen(spark: SparkSession, path: str, buckets: int) -> Adjacency:
    """What ``store`` wrote to ``path`` with so many buckets."""
    adjacency = Adjacency(f"adjacency_{uuid.uuid4().hex}", path, buckets, spark)
    spark.sql(f"CREATE TABLE {adjacency.name} ({_ROW}) USING parquet PARTITIONED BY (rel_type) CLUSTERED BY (label, id, slice) SORTED BY (label, id, slice) INTO {buckets} BUCKETS LOCATION '{path}/edges'")
    spark.catalog.recoverPartitions(adjacency.name)
    return adjacency


def _directed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    end = lambda own, other, name: F.when(F.col("outward"), F.col(own)).otherwise(F.col(other)).alias(name)
    return rows.select(*by, "repo_id", end("label", "to_label", "src_label"), end("id", "to_id", "src_id"), "rel_type", end("to_label", "label", "dst_label"), end("to_id", "id", "dst_id"))


def neighbourhood(adjacency: Adjacency, seeds: DataFrame, hops: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Distinct edges within ``hops`` of ``seeds(label, id, *by)``, of each ``by``
    by itself: those at nodes less than ``hops`` away. One scan a hop."""
    check_depth(hops)
    keys = [*by, "label", "id"]
    frontier = visited = settled(seeds.select(*keys).distinct())
    found = None
    for hop in range(hops):
        touched = adjacency.at(frontier, by)
        if hop < hops - 1:
            touched = settled(touched)  # read for the result and for the next frontier
            reached = touched.select(*by, F.col("to_label").alias("label"), F.col("to_id").alias("id")).distinct()
            frontier = settled(reached.join(visited, keys, "left_anti"))
            visited = visited.unionByName(frontier)
        edges = _directed(touched, by)
        found = edges if found is None else found.unionByName(edges)
    return found.distinct()


def subgraph(adjacency: Adjacency, graph: Graph, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``traverse.subgraph`` on stored edges."""
    return with_names(graph, neighbourhood(adjacency, seeds, hops))


def callers(adjacency: Adjacency, target: DataFrame, hops: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """``traverse.callers`` on stored edges, of each ``by``: one scan of the calls
    a hop."""
    check_depth(hops)
    keys = [*by, "label", "id"]
    at, found = settled(target.select(*keys).distinct()), None
    for _ in range(hops):
        at = settled(adjacency.at(at, by, ["CALLS"], outward=False).select(*by, F.col("to_label").alias("label"), F.col("to_id").alias("id")).distinct())
        found = at if found is None else found.unionByName(at)
    return found.distinct().where("label = 'Function'")


def impact(adjacency: Adjacency, target: DataFrame, hops: int = 3) -> DataFrame:
    """``traverse.impact`` on stored edges: the branches that leave the target
    come from one scan."""
    one = settled(target.select("label", "id", "name", "file").limit(1))
    leaves = adjacency.at(one, types=["CALLS", "RAISES", "READS"], outward=True)
    branch = F.when((F.col("rel_type") == "CALLS") & (F.col("to_label") == "Function"), "callees").when((F.col("rel_type") == "RAISES") & (F.col("to_label") == "Exception"), "exceptions").when((F.col("rel_type") == "READS") & (F.col("to_label") == "Config"), "configs")
    found = leaves.select(branch.alias("branch"), F.col("to_id").alias("of")).where("branch IS NOT NULL")
    found = found.unionByName(callers(adjacency, one, hops).select(F.lit("callers").alias("branch"), F.col("id").alias("of")))
    names = ("callers", "callees", "exceptions", "configs")
    lists = found.groupBy().pivot("branch", list(names)).agg(F.array_sort(F.collect_set("of")))
    none = F.array().cast("array<string>")
    return one.join(lists, how="left").select("label", "id", "name", "file", *[F.coalesce(c, none).alias(c) for c in names])

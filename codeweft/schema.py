"""The property graph's tables, labels and edge types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, MapType, StringType, StructField, StructType

LABELS = ("Module", "Class", "Function", "Exception", "Config")
EDGE_TYPES = ("CONTAINS", "IMPORTS", "CALLS", "INHERITS", "RAISES", "READS", "HAS_METHOD", "DEFINES_TYPE", "USES_TYPE")

NODES = StructType(
    [
        StructField("repo_id", StringType()),
        StructField("label", StringType()),
        StructField("id", StringType()),
        StructField("name", StringType()),
        StructField("file", StringType()),
        StructField("line", IntegerType()),
        StructField("docstring", StringType()),
        StructField("source_code", StringType()),
        StructField("embedding", ArrayType(FloatType())),
        StructField("file_hash", StringType()),
    ]
)
RAW_EDGES = StructType(
    [
        StructField("repo_id", StringType()),
        StructField("source", StringType()),
        StructField("target", StringType()),
        StructField("type", StringType()),
        StructField("props", MapType(StringType(), StringType())),
        StructField("file", StringType()),
    ]
)


@dataclass(frozen=True)
class Graph:
    """``nodes`` as in NODES; ``edges`` with ``repo_id, src_label, src_id,
    rel_type, dst_label, dst_id``. ``parts``: in how many parts what is about
    as large as the edges is joined or put together; Spark's own number, which
    doesn't follow the graph, if none is given."""

    nodes: DataFrame
    edges: DataFrame
    parts: int | None = None

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows if self.parts is None else rows.repartition(self.parts, *keys)

    def within(self, repo_id: str, lenient: bool = False) -> Graph:
        """The part of one repository (prunes partitions by ``repo_id``). With
        ``lenient`` an empty id stands for all, and what belongs to no
        repository belongs to each."""
        if lenient and not repo_id:
            return self
        mine = [F.col("repo_id").eqNullSafe(repo_id) | F.col("repo_id").isNull() if lenient else F.col("repo_id") == repo_id for _ in range(2)]
        return Graph(self.nodes.where(mine[0]), self.edges.where(mine[1]), self.parts)


def problems(nodes: DataFrame) -> DataFrame:
    """``repo_id, label, id, n`` of keys that break the schema: unknown labels
    and repeated keys."""
    counted = nodes.groupBy("repo_id", "label", "id").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") > 1) | ~F.col("label").isin(*LABELS))

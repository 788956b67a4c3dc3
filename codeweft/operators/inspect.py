"""Counts, previews, presets and canned graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import settled
from codeweft.schema import Graph

PRESET_LIMIT = 10


def count_by_label(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("label").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "label")


def count_by_type(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("rel_type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "rel_type")


def repo_stats(graph: Graph, repo_id: str, fall_back: bool = False) -> DataFrame:
    """``node_count, edge_count, file_count`` of a repository. An unknown one
    has none; ``fall_back`` counts everything instead."""
    own = graph.within(repo_id)
    if fall_back and own.nodes.isEmpty():
        own = graph
    nodes = own.nodes.agg(F.count("*").alias("node_count"), F.count_distinct("file").alias("file_count"))
    ends = own.nodes.select("label", "id")
    end = lambda e: ends.select(F.col("label").alias(f"{e}_label"), F.col("id").alias(f"{e}_id"))
    inside = own.dealt(own.edges, "src_label", "src_id").join(end("src"), ["src_label", "src_id"], "left_semi").distinct()
    # counted before they are shuffled by their target: many edges lead to some
    at = inside.groupBy("dst_label", "dst_id").agg(F.count("*").alias("n"))
    edges = at.join(end("dst"), ["dst_label", "dst_id"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"))
    return nodes.join(F.broadcast(edges)).select("node_count", "edge_count", "file_count")  # one row each


def _end(end: str) -> Column:
    return F.struct(F.col(f"{end}_label").alias("label"), F.col(f"{end}_id").alias("id"))


def both_ends(edges: DataFrame) -> DataFrame:
    """``label, id``, a row for each end of each edge; edges are made once for
    both."""
    return edges.select(F.explode(F.array(_end("src"), _end("dst"))).alias("at")).select("at.*")


def degrees(edges: DataFrame, loops_once: bool = False) -> DataFrame:
    same = (F.col("src_label") == F.col("dst_label")) & (F.col("src_id") == F.col("dst_id"))
    ends = both_ends(edges)
    if loops_once:
        once = F.when(same, F.array(_end("src"))).otherwise(F.array(_end("src"), _end("dst")))
        ends = edges.where(same.isNotNull()).select(F.explode(once).alias("at")).select("at.*")
    return ends.groupBy("label", "id").agg(F.count("*").alias("degree"))


def preview_nodes(graph: Graph, limit: int = 60, highlighted: list[str] = ()) -> DataFrame:
    """The first nodes by id with their true degree and whether they are
    highlighted by id or name."""
    first = settled(graph.nodes.select("label", "id", "name").orderBy("id", "label").limit(limit))
    marks = F.array(*map(F.lit, highlighted)).cast("array<string>")
    flagged = F.array_contains(marks, F.col("id")) | F.array_contains(marks, F.coalesce("name", F.lit("")))
    ends = both_ends(graph.edges).join(F.broadcast(first), ["label", "id"], "left_semi")  # ``limit`` rows
    degree = ends.groupBy("label", "id").agg(F.count("*").alias("degree"))
    return first.join(degree, ["label", "id"], "left").select("id", "name", "label", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), flagged.alias("highlighted"))


def preview_edges(graph: Graph, limit: int = 60) -> DataFrame:
    """All edges at those nodes, once each, in stored direction."""
    first = graph.nodes.select("label", "id").orderBy("id", "label").limit(limit)
    edges = graph.edges
    at = lambda end: (edges[f"{end}_label"] == first["label"]) & (edges[f"{end}_id"] == first["id"])
    return edges.join(first, at("src"), "left_semi").unionByName(edges.join(first, at("dst"), "left_semi")).select(F.col("src_id").alias("source"), F.col("dst_id").alias("target"), F.col("rel_type").alias("type")).distinct()


def _without(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    ids = edges.select(F.col(f"{end}_label").alias("label"), F.col(f"{end}_id").alias("id"))
    return nodes.join(ids, ["label", "id"], "left_anti")


def no_docstring(graph: Graph, limit: int | None = PRESET_LIMIT) -> DataFrame:
    rows = graph.nodes.where(F.col("label").isin("Function", "Class") & (F.col("docstring").isNull() | (F.col("docstring") == ""))).select("id", "name", "file").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def high_method_count(graph: Graph, limit: int | None = PRESET_LIMIT) -> DataFrame:
    methods = graph.edges.where("rel_type = 'HAS_METHOD' AND src_label = 'Class'").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n"))
    rows = graph.nodes.where("label = 'Class'").select("id", "name").join(methods, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("methods")).orderBy(F.desc("methods"), "id")
    return rows if limit is None else rows.limit(limit)


def unused_function(graph: Graph, limit: int | None = PRESET_LIMIT) -> DataFrame:
    rows = _without(graph.nodes.where("label = 'Function'"), graph.edges.where("rel_type = 'CALLS'"), "dst").select("id", "name", "file").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def high_coupling(graph: Graph, limit: int | None = PRESET_LIMIT) -> DataFrame:
    """Functions and classes by in- plus out-degree (a loop counts twice)."""
    rows = degrees(graph.edges).where(F.col("label").isin("Function", "Class")).select("id", "label", "degree").orderBy(F.desc("degree"), "id")
    return rows if limit is None else rows.limit(limit)


def no_test_coverage(graph: Graph, limit: int | None = PRESET_LIMIT) -> DataFrame:
    """Functions that no function of a file named after tests calls."""
    testers = graph.nodes.where(F.lower("file").contains("test")).select(F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    tested = graph.edges.where("rel_type = 'CALLS'").join(testers, ["src_label", "src_id"], "left_semi")
    rows = _without(graph.nodes.where("label = 'Function'"), tested, "dst").where(~F.lower("file").contains("test")).select("id", "name", "file").orderBy("id")
    return rows if limit is None else rows.limit(limit)


PRESETS = {f.__name__: f for f in (no_docstring, high_method_count, unused_function, high_coupling, no_test_coverage)}


def edge_scan(graph: Graph, rel_type: str, src_label: str | None = None, limit: int = 50) -> DataFrame:
    """The first edges of a type as source, target and both names."""
    edges = graph.edges.where(F.col("rel_type") == rel_type)
    if src_label is not None:
        edges = edges.where(F.col("src_label") == src_label)
    names = graph.nodes.select("label", "id", "name")
    source = names.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"), F.col("name").alias("source_name"))
    target = names.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"), F.col("name").alias("target_name"))
    rows = graph.dealt(edges, "src_label", "src_id").join(source, ["src_label", "src_id"])
    rows = graph.dealt(rows, "dst_label", "dst_id").join(target, ["dst_label", "dst_id"])
    return rows.select(F.col("src_id").alias("source"), "source_name", F.col("dst_id").alias("target"), "target_name").orderBy("source", "target").limit(limit)


def hubs(graph: Graph, limit: int = 15) -> DataFrame:
    """Nodes of any label by degree (a loop counts once)."""
    return degrees(graph.edges, loops_once=True).select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(limit)


def whole_graph(graph: Graph, limit: int = 200) -> DataFrame:
    """Nodes with each edge at them (null for a node without), both ways. Every
    node has a row, so the first rows are those of as many first nodes."""
    first = settled(graph.nodes.select("label", "id").orderBy("id", "label").limit(limit))
    way = lambda a, b: F.struct(F.col(f"{a}_label").alias("label"), F.col(f"{a}_id").alias("id"), "rel_type", F.col(f"{b}_id").alias("other"))
    each = graph.edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("at")).select("at.*")
    each = each.join(F.broadcast(first), ["label", "id"], "left_semi").distinct()  # ``limit`` rows
    # what comes later can't be among the first rows, and a node may have most edges
    each = each.orderBy("id", "label", "rel_type", "other").limit(limit)
    return first.join(each, ["label", "id"], "left").orderBy("id", "label", "rel_type", "other").limit(limit)

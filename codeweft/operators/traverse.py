"""Traversals as bounded joins: call chains, neighbourhoods, impact."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import settled
from codeweft.schema import Graph

MAX_DEPTH = 10


def check_depth(depth: int) -> int:
    if not isinstance(depth, int) or isinstance(depth, bool) or not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be a whole number from 1 to {MAX_DEPTH}, not {depth!r}")
    return depth


def split_reference(reference: str) -> tuple[str, str]:
    """(name, module) of ``file::name`` or ``module.name``."""
    if "::" in reference:
        module, name = reference.split("::", 1)
        return name, module
    module, _, name = reference.rpartition(".")
    return name, module


def find_node(nodes: DataFrame, reference: str, repo_id: str | None = None) -> DataFrame:
    """The one node that ``reference`` names best: by exact id, then as the end
    of an id, by name, by name within a module, and at last inside an id;
    among equals the shortest and first id."""
    name, module = split_reference(reference)
    ident = F.col("id")
    tier = (
        F.when(ident == reference, 1)
        .when(ident.endswith(f"::{reference}"), 2)
        .when(F.col("name") == reference, 3)
        .when((F.col("name") == name) & (F.col("file").contains(module) | ident.contains(module)), 4)
        .when(ident.contains(reference), 5)
    )
    rows = nodes if repo_id is None else nodes.where(F.col("repo_id") == repo_id)
    return rows.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.length("id"), "id", "label").limit(1)


def _step(graph: Graph, rel_type: str) -> DataFrame:
    return graph.edges.where(F.col("rel_type") == rel_type)


#: Up to this depth the number of chains is known without listing them.
COUNTED = 3


def chain_counts(graph: Graph, starts: DataFrame | None = None, depth: int = COUNTED, upstream: bool = False) -> DataFrame:
    """``label, id, depth_1 .. depth_n, within``: how many chains ``call_chains``
    would list from each of ``starts`` (all callers if none are given) at each
    depth, and in all, by sums over edges; no chain is made. Walks are counted
    step by step; those that use an edge twice are taken off: a loop taken
    twice at the first or the last step, and an edge, its reverse and the edge
    again. No join sends a table through the driver: written tables of long
    ids are small on disk and many times that in memory. Beyond ``COUNTED`` there are too many ways to use an edge twice:
    depths from there on count walks, which are at least as many."""
    check_depth(depth)
    near, far = ("dst", "src") if upstream else ("src", "dst")
    each = _step(graph, "CALLS").select(*[F.col(f"{end}_{c}").alias(f"{to}{c}") for end, to in ((near, ""), (far, "to_")) for c in ("label", "id")]).distinct()
    if upstream:
        ends = graph.nodes.where("label = 'Function'").select("label", "id")
        begin = each.join(ends, ["label", "id"], "left_semi")
    else:
        begin = each
    each = settled(each)
    there = [F.col("to_label") == F.col("at_label"), F.col("to_id") == F.col("at_id")]
    named = lambda df, **more: df.select(F.col("label").alias("at_label"), F.col("id").alias("at_id"), *[F.col(c).alias(n) for n, c in more.items()])
    is_function, loop = (F.col("to_label") == "Function").cast("bigint"), ((F.col("label") == F.col("to_label")) & (F.col("id") == F.col("to_id"))).cast("bigint")
    first = settled(each.groupBy("label", "id").agg(F.sum(is_function).alias("w"), F.sum(loop).alias("loop")))
    walks, columns = first.select("label", "id", "w"), {1: first.select("label", "id", F.col("w").alias("depth_1"))}
    back = each.select(F.col("to_label").alias("label"), F.col("to_id").alias("id"), F.col("label").alias("to_label"), F.col("id").alias("to_id"), F.lit(1).alias("back"))
    for d in range(2, depth + 1):
        onward = each.join(named(walks, ahead="w").hint("merge"), there, "left").groupBy("label", "id").agg(F.sum(F.coalesce("ahead", F.lit(0))).alias("w"))
        walks = settled(onward)
        counted = walks
        if d == 2:
            own = (F.col("label") == "Function").cast("bigint") * F.col("loop")
            counted = walks.join(first.select("label", "id", "loop").hint("merge"), ["label", "id"]).withColumn("w", F.col("w") - own)
        elif d == 3:
            around = each.join(named(first, at_loop="loop").hint("merge"), there, "left").join(back.hint("merge"), ["label", "id", "to_label", "to_id"], "left")
            twice = around.groupBy("label", "id").agg(F.sum(is_function * (F.coalesce("at_loop", F.lit(0)) + F.coalesce("back", F.lit(0)))).alias("twice"))
            own = (F.col("label") == "Function").cast("bigint") * F.col("loop")
            counted = walks.join(twice.hint("merge"), ["label", "id"]).join(first.withColumnRenamed("w", "out").hint("merge"), ["label", "id"]).withColumn("w", F.col("w") - F.col("twice") - F.col("loop") * F.col("out") + 2 * own)
        columns[d] = counted.select("label", "id", F.col("w").alias(f"depth_{d}"))
    out = begin.select("label", "id").distinct()
    out = out if starts is None else out.join(starts.select("label", "id").distinct(), ["label", "id"])
    for column in columns.values():
        out = out.join(column.hint("merge"), ["label", "id"])
    return out.withColumn("within", functools.reduce(lambda a, b: a + b, [F.col(f"depth_{d}") for d in columns]))


def call_chains(graph: Graph, starts: DataFrame, depth: int = 4, upstream: bool = False, max_paths: int | None = None) -> DataFrame:
    """Paths of 1 to ``depth`` CALLS edges from the nodes ``starts(label, id)``
    (``upstream``: to them). No edge occurs twice in a path, nodes may; the far
    end is a Function, and upstream the near end too. ``call_chain`` (names)
    and ``node_ids`` run from caller to callee. The number of paths can grow with
    the power of the depth: beyond ``max_paths`` at one depth it is a ValueError,
    nothing is left out. Up to ``COUNTED`` calls that is known from
    ``chain_counts`` before any path is made."""
    check_depth(depth)
    calls = _step(graph, "CALLS").select("src_label", "src_id", "dst_label", "dst_id")
    near, far = ("dst", "src") if upstream else ("src", "dst")
    if max_paths is not None and depth <= COUNTED:  # refused before any path is made
        sums = chain_counts(graph, starts, depth, upstream).agg(*[F.sum(f"depth_{d}").alias(f"depth_{d}") for d in range(1, depth + 1)]).first()
        for d in range(1, depth + 1):
            if (sums[f"depth_{d}"] or 0) > max_paths:
                raise ValueError(f"more than {max_paths} paths of {d} calls; ask for a smaller depth")
    names = graph.nodes.select(F.col("label").alias("at_label"), F.col("id").alias("at_id"), F.col("name").alias("at_name"))
    hop = calls.select(F.col(f"{near}_label").alias("label"), F.col(f"{near}_id").alias("id"), F.col(f"{far}_label").alias("at_label"), F.col(f"{far}_id").alias("at_id")).join(names, ["at_label", "at_id"])
    begin = graph.nodes.select("label", "id", "name").join(starts.select("label", "id").distinct(), ["label", "id"])
    if upstream:
        begin = begin.where("label = 'Function'")
    paths = begin.select("label", "id", F.array("name").alias("call_chain"), F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"))
    edge = F.concat_ws("\u0001", "label", "id", "at_label", "at_id")
    found = None
    for d in range(1, depth + 1):
        grown = paths.join(hop, ["label", "id"]).withColumn("edge", edge).where(~F.array_contains("edge_ids", F.col("edge")))
        add = (lambda a, c: F.concat(F.array(c), a)) if upstream else (lambda a, c: F.concat(a, F.array(c)))
        paths = grown.select(F.col("at_label").alias("label"), F.col("at_id").alias("id"), add(F.col("call_chain"), F.col("at_name")).alias("call_chain"), add(F.col("node_ids"), F.col("at_id")).alias("node_ids"), F.concat("edge_ids", F.array("edge")).alias("edge_ids"))
        if max_paths is not None or d < depth:  # else each depth would walk all those before it again
            paths = settled(paths)
        if max_paths is not None and depth > COUNTED and paths.limit(max_paths + 1).count() > max_paths:
            raise ValueError(f"more than {max_paths} paths of {d} calls; ask for a smaller depth")
        own = paths.where("label = 'Function'").select("call_chain", "node_ids", F.lit(d).alias("depth"))
        found = own if found is None else found.unionByName(own)
    return found


def subgraph(graph: Graph, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Distinct edges on any undirected path of up to ``hops`` edges from the
    seeds, in stored direction, with both nodes: the edges at nodes less than
    ``hops`` away, found by a breadth-first frontier."""
    check_depth(hops)
    edges = graph.edges
    way = lambda a, b: F.struct(F.col(f"{a}_label").alias("label"), F.col(f"{a}_id").alias("id"), F.col(f"{b}_label").alias("to_label"), F.col(f"{b}_id").alias("to_id"))
    either = edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("at")).select("at.*")
    visited = seeds.select("label", "id").distinct()
    frontier = visited
    for _ in range(hops - 1):
        reached = either.join(frontier, ["label", "id"]).select(F.col("to_label").alias("label"), F.col("to_id").alias("id")).distinct()
        # read in every later hop; its size tells whether the edges have to be shuffled
        frontier = settled(reached.join(visited, ["label", "id"], "left_anti"))
        visited = visited.unionByName(frontier)
    at = lambda end: (edges[f"{end}_label"] == visited["label"]) & (edges[f"{end}_id"] == visited["id"])
    touched = edges.join(visited, at("src"), "left_semi").unionByName(edges.join(visited, at("dst"), "left_semi"))
    touched = graph.dealt(touched, "src_label", "src_id").distinct()
    return with_names(graph, touched)


#: Edges of a target that are too many for one task.
HUB = 50_000


def with_names(graph: Graph, edges: DataFrame) -> DataFrame:
    """Subgraph rows: both ends with label, id and name. Edges are dealt by their
    targets, but for those of a hub, which stay where they are and meet its name:
    there are fewer hubs than edges by a factor of ``HUB``."""
    names = graph.nodes.select("label", "id", "name")
    source = names.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"), F.col("name").alias("source_name"))
    target = names.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"), F.col("name").alias("target_name"))
    to = ["dst_label", "dst_id"]
    named = settled(edges.join(source, ["src_label", "src_id"]))
    hubs = settled(named.groupBy(*to).agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(*to))
    often = settled(target.join(F.broadcast(hubs), to))
    rest = graph.dealt(named.join(F.broadcast(hubs), to, "left_anti"), *to).join(target, to)
    return rest.unionByName(named.join(F.broadcast(often), to)).select(F.col("src_id").alias("source_id"), F.col("src_label").alias("source_type"), "source_name", "rel_type", F.col("dst_id").alias("target_id"), F.col("dst_label").alias("target_type"), "target_name")


def callers(graph: Graph, target: DataFrame, hops: int = 3) -> DataFrame:
    """Distinct Functions from which 1 to ``hops`` CALLS edges lead to the
    target; one on a cycle through the target lists the target itself."""
    check_depth(hops)
    calls = _step(graph, "CALLS")
    at, found = target.select("label", "id").distinct(), None
    for _ in range(hops):
        meets = (calls["dst_label"] == at["label"]) & (calls["dst_id"] == at["id"])
        at = calls.join(at, meets).select(F.col("src_label").alias("label"), F.col("src_id").alias("id")).distinct()
        found = at if found is None else found.unionByName(at)
    return found.distinct().where("label = 'Function'")


def neighbours(graph: Graph, target: DataFrame, rel_type: str, label: str) -> DataFrame:
    """Distinct nodes of ``label`` that the target's ``rel_type`` edges reach."""
    edges = _step(graph, rel_type).where(F.col("dst_label") == label)
    meets = (edges["src_label"] == target["label"]) & (edges["src_id"] == target["id"])
    return edges.join(target, meets, "left_semi").select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")).distinct()


def impact_branches(graph: Graph, target: DataFrame, hops: int = 3) -> dict[str, DataFrame]:
    """What a change of the target may touch, a table ``label, id`` for each
    branch: ``callers, callees, exceptions, configs``. Every branch is found
    by itself, so no product of the branches arises."""
    one = target.select("label", "id").limit(1)
    return {
        "callers": callers(graph, one, hops),
        "callees": neighbours(graph, one, "CALLS", "Function"),
        "exceptions": neighbours(graph, one, "RAISES", "Exception"),
        "configs": neighbours(graph, one, "READS", "Config"),
    }


def impact(graph: Graph, target: DataFrame, hops: int = 3) -> DataFrame:
    """One row for the target (none for an unknown node): ``id, callers,
    callees, exceptions, configs``, each a sorted list of ids. The row is as
    large as what the target touches; ``impact_branches`` gives the same as
    tables, of which any part can be taken."""
    one = target.select("label", "id", "name", "file").limit(1)
    found = None
    for name, rows in impact_branches(graph, one, hops).items():
        rows = rows.select(F.lit(name).alias("branch"), F.col("id").alias("of"))
        found = rows if found is None else found.unionByName(rows)
    lists = found.groupBy().pivot("branch", ["callers", "callees", "exceptions", "configs"]).agg(F.array_sort(F.collect_set("of")))
    none = F.array().cast("array<string>")
    return one.join(lists, how="left").select("label", "id", "name", "file", *[F.coalesce(c, none).alias(c) for c in ("callers", "callees", "exceptions", "configs")])


def rendered(array: Column) -> Column:
    return F.array_join(array, "|")

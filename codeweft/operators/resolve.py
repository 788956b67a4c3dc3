"""Edge resolution: raw source and target strings to nodes, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import spread_join
from codeweft.runtime import settled


def node_keys(nodes: DataFrame) -> DataFrame:
    """``repo_id, key, label, id``: every string that names a node: its id,
    its name, and what follows each ``::`` of its id."""
    tails = F.expr("transform(filter(sequence(1, greatest(length(id), 1)), i -> substring(id, i, 2) = '::'), i -> substring(id, i + 2))")
    keys = F.array_compact(F.array_distinct(F.concat(F.array("id", "name"), tails)))
    return nodes.select("repo_id", "label", "id", F.explode(keys).alias("key"))


def cleaned(target: Column) -> Column:
    return F.replace(F.replace(target, F.lit("ts_call::"), F.lit("")), F.lit("config::"), F.lit(""))


def _ends(raw: DataFrame, keys: DataFrame, column: Column, label: str, ident: str) -> DataFrame:
    named = raw.withColumn("key", column)
    hits = named.join(keys.select("repo_id", "key", F.col("label").alias(label), F.col("id").alias(ident)), ["repo_id", "key"])
    every = keys.select("key", F.col("repo_id").alias("of"), F.col("label").alias(label), F.col("id").alias(ident))
    free = F.coalesce("repo_id", F.lit("")) == ""
    hits = hits.unionByName(named.where(~free).join(every.where("of IS NULL"), "key").select(*hits.columns))
    hits = hits.where(~free).unionByName(named.where(free).join(every, "key").select(*hits.columns))
    return hits.drop("key")


def raw_pairs(raw: DataFrame) -> DataFrame:
    """``repo_id, source, target, type`` of raw edges, each once: files repeat
    what they call, and only what differs has to be resolved."""
    return raw.select("repo_id", "source", cleaned(F.col("target")).alias("target"), "type").distinct()


def resolve_pairs(pairs: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """``pairs`` with ``src_label, src_id, dst_label, dst_id``: each pair between
    all nodes that its ends name. Each name is looked up once, however many
    pairs have it. With ``most`` the pairs of a name beyond so many rows are
    dealt out over cells (``skew.spread_join``), so a name that a large part of
    the nodes has keeps no task longer than others."""
    pairs = pairs if most is None else settled(pairs)

    def named(end: str, label: str) -> DataFrame:
        asked = pairs.select("repo_id", F.col(end).alias("key")).distinct()
        hits = asked.join(keys.select("repo_id", "key", "label", "id"), ["repo_id", "key"])
        return hits.select("repo_id", F.col("key").alias(end), F.col("label").alias(f"{label}_label"), F.col("id").alias(f"{label}_id"))

    sources, targets = named("source", "src"), named("target", "dst")
    if most is None:
        return pairs.join(sources, ["repo_id", "source"]).join(targets, ["repo_id", "target"])
    half = settled(spread_join(pairs, settled(sources), ["repo_id", "source"], most))
    return spread_join(half, settled(targets), ["repo_id", "target"], most)


def _same(a: DataFrame, b: DataFrame, columns: dict[str, str]) -> list[Column]:
    """Equality of columns of ``a`` and ``b``; the type of an edge may be null."""
    return [a[x].eqNullSafe(b[y]) for x, y in columns.items()]


def _ranked(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``repo_id, target, dst_label, dst_id, before``: the nodes of each name that
    is asked for, and which of the node's other asked names come before this
    one: those of more nodes, then the first."""
    hits = keys.select("repo_id", "key", "label", "id").join(asked, ["repo_id", "key"], "left_semi").distinct()
    often = hits.groupBy("repo_id", "key").agg(F.count("*").alias("n"))
    own = hits.join(often, ["repo_id", "key"]).groupBy("repo_id", "label", "id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key")))["key"].alias("names"))
    each = own.select("repo_id", F.col("label").alias("dst_label"), F.col("id").alias("dst_id"), "names", F.posexplode("names").alias("at", "target"))
    return each.select("repo_id", "target", "dst_label", "dst_id", F.slice("names", F.lit(1), F.col("at")).alias("before"))


def distinct_links(pairs: DataFrame, keys: DataFrame, most: int | None = None, written: bool = False) -> DataFrame:
    """The distinct edges of distinct ``pairs``, ``most`` as in ``resolve_pairs``.
    With ``written`` (or ``most``) what is as large as the pairs is written on the
    way, and only the links of each name's first nodes are left to be listed; the
    pairs had better be a written table.
    A name that n nodes have and m callers use makes n * m edges: they are
    listed by a join and never put together again. That one edge isn't listed by
    two names of its target is settled beforehand: each node takes part under
    the one of its names that most nodes have, and under another one only for
    callers that use none of those before it, so what has to be compared is
    what the rarer names list."""
    keep = settled if written or most is not None else lambda df: df
    join = (lambda a, b, on: spread_join(a, b, on, most)) if most is not None else (lambda a, b, on: a.join(b, on))
    ranked = keep(_ranked(pairs.select("repo_id", F.col("target").alias("key")).distinct(), keys))
    sources = keys.select("repo_id", F.col("key").alias("source"), F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    sources = keep(sources.join(pairs.select("repo_id", "source").distinct(), ["repo_id", "source"], "left_semi").distinct())
    half = keep(join(pairs, sources, ["repo_id", "source"]).select("repo_id", "src_label", "src_id", F.col("type").alias("rel_type"), "target").distinct())
    columns = ["repo_id", "src_label", "src_id", "rel_type", "dst_label", "dst_id"]
    is_first = F.size("before") == 0
    first = join(half, keep(ranked.where(is_first).drop("before")), ["repo_id", "target"]).select(*columns)
    rest = keep(join(half, keep(ranked.where(~is_first)), ["repo_id", "target"]).select(*columns, "before"))
    other = rest.withColumn("name", F.explode("before"))
    there = _same(other, half, {**{c: c for c in columns[:4]}, "name": "target"})
    listed = keep(other.join(half, there, "left_semi").select(*columns).distinct())
    return first.unionByName(keep(rest.join(listed, _same(rest, listed, {c: c for c in columns}), "left_anti").select(*columns)))


def resolve_edges(nodes: DataFrame, raw: DataFrame, lenient: bool = False, most: int | None = None, written: bool = False) -> DataFrame:
    """Distinct ``repo_id, src_label, src_id, rel_type, dst_label, dst_id``: each
    raw edge between all nodes that its ends name. With ``lenient``, nodes
    whose repository is null belong to every one, and raw edges without a
    repository (null or empty) join nodes of all. ``most`` bounds what a task
    takes of one name (see ``resolve_pairs``; tables are written on the way, as
    they are with ``written``)."""
    keys = node_keys(nodes)
    if not lenient:
        pairs = raw_pairs(raw)
        return distinct_links(settled(pairs) if written or most is not None else pairs, keys, most, written)
    both = _ends(raw, keys, F.col("source"), "src_label", "src_id")
    both = _ends(both, keys, cleaned(F.col("target")), "dst_label", "dst_id")
    return both.select("repo_id", "src_label", "src_id", F.col("type").alias("rel_type"), "dst_label", "dst_id").distinct()


def name_counts(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """``repo_id, key, nodes, as_source, as_target, links``: how many nodes each
    name stands for, how many distinct raw edges use it at either end, and how
    many links that makes at most of each raw edge's other end."""
    keys = node_keys(nodes).groupBy("repo_id", "key").agg(F.count("*").alias("nodes"))
    pairs = raw_pairs(raw)
    ends = pairs.select("repo_id", F.col("source").alias("key"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(pairs.select("repo_id", F.col("target").alias("key"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    used = ends.groupBy("repo_id", "key").agg(F.sum("s").alias("as_source"), F.sum("t").alias("as_target"))
    return keys.join(used, ["repo_id", "key"]).withColumn("links", F.col("nodes") * (F.col("as_source") + F.col("as_target")))


def dangling_edges(nodes: DataFrame, raw: DataFrame, parts: int | None = None) -> DataFrame:
    """Raw edges one of whose ends names no node, looked up in ``parts`` parts
    (Spark's own number if none is given)."""
    keys = node_keys(nodes).select("repo_id", "key").distinct()
    marked = raw.withColumns({"source_key": F.col("source"), "target_key": cleaned(F.col("target"))})
    for end in ("source", "target"):
        hit = keys.select("repo_id", F.col("key").alias(f"{end}_key"), F.lit(True).alias(f"{end}_found"))
        marked = marked if parts is None else marked.repartition(parts, "repo_id", f"{end}_key")
        marked = marked.join(hit, ["repo_id", f"{end}_key"], "left")
    return marked.where("source_found IS NULL OR target_found IS NULL").select(*raw.columns)


def upsert_nodes(stored: DataFrame, emitted: DataFrame, scope: str = "repo") -> DataFrame:
    """Merge ``emitted`` (with a total order ``seq``) into ``stored``: per key
    the last value that isn't null wins, property by property. ``scope`` is
    ``repo`` (key repo_id, label, id) or ``global`` (label, id)."""
    key = ["repo_id", "label", "id"] if scope == "repo" else ["label", "id"]
    columns = [c for c in stored.columns if c not in key]
    kind = emitted.schema["seq"].dataType
    old = stored.withColumn("seq", F.lit(None).cast(kind)).withColumn("fresh", F.lit(False))
    both = old.unionByName(emitted.select(*stored.columns, "seq").withColumn("fresh", F.lit(True)))
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("fresh", "seq"))).alias(c) for c in columns]
    return both.groupBy(*key).agg(*latest).select(*stored.columns)

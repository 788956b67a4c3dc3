"""Incremental maintenance on raw edges: resolved edges are a view, so edges
from other files come back by themselves when a file is parsed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.resolve import cleaned, node_keys, upsert_nodes


def file_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``file, status`` (added, changed, deleted or unchanged) of two tables
    ``file, file_hash``."""
    a, b = stored.select("file", F.col("file_hash").alias("old"), F.lit(1).alias("was")), current.select("file", F.col("file_hash").alias("new"), F.lit(1).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def stored_hashes(nodes: DataFrame, repo_id: str) -> DataFrame:
    return nodes.where((F.col("repo_id") == repo_id) & (F.col("label") == "Module")).select("file", "file_hash")


def without_files(rows: DataFrame, files: DataFrame, repo_id: str | None = None) -> DataFrame:
    """``rows`` (nodes or raw edges) without those of ``files(file)`` in the
    repository, or in all if none is given."""
    gone = files.select("file").distinct()
    if repo_id is None:
        return rows.join(gone, "file", "left_anti").select(*rows.columns)
    return rows.join(gone.withColumn("repo_id", F.lit(repo_id)), ["repo_id", "file"], "left_anti").select(*rows.columns)


def delete_file(nodes: DataFrame, raw: DataFrame, file: str, repo_id: str = "") -> tuple[DataFrame, DataFrame, int]:
    """(nodes, raw edges, how many nodes went) without those of a file in the
    repository, or in all if none is given."""
    mine = F.col("file") == file
    if repo_id:
        mine = mine & (F.col("repo_id") == repo_id)
    stays = ~F.coalesce(mine, F.lit(False))
    return nodes.where(stays), raw.where(stays), nodes.where(mine).count()


def wipe_repo(rows: DataFrame, repo_id: str) -> tuple[DataFrame, int]:
    mine = F.col("repo_id") == repo_id
    return rows.where(~F.coalesce(mine, F.lit(False))), rows.where(mine).count()


def stale_edges(nodes: DataFrame, raw: DataFrame, file: str, repo_id: str | None = None) -> DataFrame:
    """Raw edges of other files that point into ``file`` at something that no
    longer exists."""
    keys = node_keys(nodes).select("repo_id", "key").distinct()
    rows = raw if repo_id is None else raw.where(F.col("repo_id") == repo_id)
    into = rows.where((F.col("file") != file) & cleaned(F.col("target")).startswith(f"{file}::")).withColumn("key", cleaned(F.col("target")))
    return into.join(keys, ["repo_id", "key"], "left_anti").select(*raw.columns)


def resync(nodes: DataFrame, raw: DataFrame, current: DataFrame, parse, repo_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes, new raw edges and the diff. ``current`` lists ``file,
    file_hash`` as they are now; ``parse`` gives (emitted nodes, raw edges) of
    a table of files, and is asked for added and changed ones only."""
    diff = file_diff(stored_hashes(nodes, repo_id), current)
    todo = diff.where(F.col("status").isin("added", "changed")).select("file")
    gone = diff.where(F.col("status").isin("deleted", "changed")).select("file")
    new_nodes, new_raw = parse(todo)
    # A shared node whose first file went stays as long as another file names it.
    left = without_files(nodes, gone, repo_id)
    still = without_files(raw, gone, repo_id)
    shared = nodes.where(F.col("label").isin("Exception", "Config") & (F.col("repo_id") == repo_id)).join(left.select("repo_id", "label", "id"), ["repo_id", "label", "id"], "left_anti")
    kept = shared.join(still.groupBy(F.col("target").alias("id")).agg(F.min("file").alias("new_file")), "id").withColumn("file", F.col("new_file")).select(*nodes.columns)
    merged = upsert_nodes(left.unionByName(kept), new_nodes)
    return merged, still.unionByName(new_raw), diff

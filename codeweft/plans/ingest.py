"""Source trees to the property graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.resolve import resolve_edges, upsert_nodes
from codeweft.operators.sync import delete_file, resync, stored_hashes
from codeweft.operators.vector import Embedder, embed_missing
from codeweft.runtime import settled, ship
from codeweft.schema import NODES, RAW_EDGES, Graph
from codeweft.sources import python_source, script_source
from codeweft.sources.emit import Parsed, module_id, module_name
from codeweft.sources.files import DOCUMENTS, PYTHON, SCRIPT, file_names, file_rows, read_files

_NODE = "struct<label:string,id:string,name:string,line:int,docstring:string,source_code:string,file_hash:string>"
_CHOICE = "struct<lookup:int,before:string,behind:string>"
_EDGE = f"struct<source:string,target:string,type:string,props:map<string,string>,choices:array<{_CHOICE}>,unless:array<int>>"
#: The same as Arrow has them.
_TEXT = pa.string()
_MADE = {
    "nodes": pa.list_(pa.struct([(c, pa.int32() if c == "line" else _TEXT) for c in ("label", "id", "name", "line", "docstring", "source_code", "file_hash")])),
    "edges": pa.list_(pa.struct([*[(c, _TEXT) for c in ("source", "target", "type")], ("props", pa.map_(_TEXT, _TEXT)), ("choices", pa.list_(pa.struct([("lookup", pa.int32()), ("before", _TEXT), ("behind", _TEXT)]))), ("unless", pa.list_(pa.int32()))])),
    "lookups": pa.list_(pa.list_(_TEXT)),
    "error": _TEXT,
}


def parse_file(file: str, content: bytes, file_hash: str | None = None, extended: bool = False) -> Parsed:
    """One file by its suffix, imports as lookups; an unsupported one gives
    nothing. Whatever goes wrong with a file is that file's error: its module
    stays, and no other file is touched."""
    out = Parsed(file)
    try:
        text = content.decode("utf-8", errors="replace")
        if file.endswith(PYTHON):
            return python_source.scan(file, text, file_hash, extended)
        if file.endswith(SCRIPT):
            return script_source.scan(file, text, file_hash, extended)
    except (Exception, RecursionError, MemoryError) as problem:  # noqa: BLE001
        out.node("Module", module_id(file), module_name(file), line=1, file_hash=file_hash)
        return out.failed(problem)
    if file.endswith(DOCUMENTS):
        out.node("Module", module_id(file), file.rsplit("/", 1)[-1], file_hash=file_hash)
    return out


def scan_files(files: DataFrame, extended: bool = False, todo: DataFrame | None = None) -> DataFrame:
    """``repo_id, file, nodes, edges, lookups, error``, a row for each file, or
    for those of ``todo(file)`` only. Each file is parsed once, by itself."""
    ship(files.sparkSession)
    some = files if todo is None else files.join(todo, "file", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents, hashes = (batch.column(c).to_pylist() for c in ("file", "content", "file_hash"))
            got = [parse_file(*each, extended) for each in zip(names, contents, hashes)]
            edges = [[{**e, "props": list(e["props"].items())} for e in p.edges] for p in got]  # a map is a list of entries
            made = {"nodes": [p.nodes for p in got], "edges": edges, "lookups": [p.lookups for p in got], "error": [p.error for p in got]}
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("file"), *[pa.array(made[c], kind) for c, kind in _MADE.items()]], names=["repo_id", "file", *_MADE])

    shape = f"repo_id string, file string, nodes array<{_NODE}>, edges array<{_EDGE}>, lookups array<array<string>>, error string"
    return some.select("repo_id", "file", "content", "file_hash").mapInArrow(run, shape)


def _asked(scanned: DataFrame) -> DataFrame:
    """``repo_id, file, lookup, rank, candidate``: each path that an import of
    the file may stand for, in order of preference."""
    each = scanned.select("repo_id", "file", F.posexplode("lookups").alias("lookup", "paths"))
    return each.select("repo_id", "file", "lookup", F.posexplode("paths").alias("rank", "candidate"))


def import_candidates(files: DataFrame) -> DataFrame:
    """``repo_id, file, candidate``: what a file is joined on."""
    return _asked(scan_files(files)).select("repo_id", "file", "candidate").distinct()


def emitted_nodes(scanned: DataFrame) -> DataFrame:
    """Nodes with ``seq``, a total order: by file, then by place in the file."""
    rows = scanned.select("repo_id", "file", F.posexplode("nodes").alias("k", "n")).select("repo_id", "n.label", "n.id", "n.name", "file", "n.line", "n.docstring", "n.source_code", F.lit(None).cast("array<float>").alias("embedding"), "n.file_hash", F.struct("file", "k").alias("seq"))
    # An exception or config belongs to the first file that names it; only these
    # few columns are put together, before anything moves.
    shared = F.col("label").isin("Exception", "Config")
    rest = [c for c in rows.columns if c not in ("repo_id", "label", "id")]
    first = rows.where(shared).groupBy("repo_id", "label", "id").agg(F.min_by(F.struct(*rest), "seq").alias("n")).select("repo_id", "label", "id", "n.*")
    return rows.where(~shared).unionByName(first)


def raw_edges(scanned: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Raw edges with imports settled by a join: what each file may mean with
    the files there are, ``names(repo_id, file)`` (those of ``scanned`` if none
    are given). Edges that depend on no import don't take part."""
    there = (scanned if names is None else names).select("repo_id", F.col("file").alias("candidate"))
    hits = _asked(scanned).join(there, ["repo_id", "candidate"], "left_semi")
    paths = hits.groupBy("repo_id", "file", "lookup").agg(F.min_by("candidate", "rank").alias("path"))
    found = paths.groupBy("repo_id", "file").agg(F.map_from_entries(F.collect_list(F.struct("lookup", "path"))).alias("found"))
    each = scanned.select("repo_id", "file", F.explode("edges").alias("e")).select("repo_id", "e.*", "file")
    free = (F.size("choices") == 0) & (F.size("unless") == 0)
    at = lambda k: F.try_element_at("found", k)
    chosen = F.filter(F.transform("choices", lambda c: F.concat(c["before"], at(c["lookup"]), c["behind"])), lambda x: x.isNotNull())
    bound = each.where(~free).join(found, ["repo_id", "file"], "left").where(~F.exists("unless", lambda k: at(k).isNotNull()))
    bound = bound.withColumn("target", F.coalesce(F.try_element_at(chosen, F.lit(1)), "target")).where("target IS NOT NULL")
    columns = ["repo_id", "source", "target", "type", "props", "file"]
    return each.where(free).select(*columns).unionByName(bound.select(*columns))


def errors(scanned: DataFrame) -> DataFrame:
    """``repo_id, file, error`` of files that couldn't be parsed."""
    return scanned.where("error IS NOT NULL").select("repo_id", "file", "error")


def empty_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODES)


def ingest(spark: SparkSession, root: str, repo_id: str | None = None, embedder: Embedder | None = None, extended: bool = False) -> tuple[DataFrame, DataFrame, Graph]:
    """(nodes, raw edges, resolved graph) of a source tree."""
    scanned = settled(scan_files(read_files(spark, root, repo_id or root), extended))
    nodes = upsert_nodes(empty_nodes(spark), emitted_nodes(scanned))
    if embedder is not None:
        nodes = embed_missing(nodes, embedder)
    raw = raw_edges(scanned)
    return nodes, raw, Graph(nodes, resolve_edges(nodes, raw))


def ingest_changes(spark: SparkSession, root: str, repo_id: str, nodes: DataFrame, raw: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, raw edges, diff) after a resync: only added and changed files
    are parsed; vectors that are missing afterwards are filled."""
    files = read_files(spark, root, repo_id)

    def parse(todo: DataFrame) -> tuple[DataFrame, DataFrame]:
        scanned = settled(scan_files(files, todo=todo))
        return emitted_nodes(scanned), raw_edges(scanned, files)

    merged, edges, diff = resync(nodes, raw, files.select("file", "file_hash"), parse, repo_id)
    return (embed_missing(merged, embedder) if embedder is not None else merged), edges, diff


def update_file(spark: SparkSession, root: str, repo_id: str, file: str, nodes: DataFrame, raw: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, raw edges, what was done) after one file is looked at again:
    ``skipped`` with an equal hash, ``deleted`` if it isn't there any more,
    else ``updated``; only that file is read and parsed."""
    listed = file_names(spark, root)
    found = file_rows(listed.where(F.col("file") == file), repo_id)
    here = found.select("file_hash").first()
    was = stored_hashes(nodes, repo_id).where(F.col("file") == file).first()
    if here and was and was.file_hash and was.file_hash == here.file_hash:
        return nodes, raw, {"status": "skipped", "reason": "hash_match", "file": file}
    nodes, raw, removed = delete_file(nodes, raw, file, repo_id)
    if not here:
        return nodes, raw, {"status": "deleted", "file": file, "nodes_removed": removed}
    names = listed.select(F.lit(repo_id).alias("repo_id"), "file")
    scanned = settled(scan_files(found))
    added = raw_edges(scanned, names)
    counts = scanned.select(F.size("nodes").alias("nodes")).first()
    merged = upsert_nodes(nodes, emitted_nodes(scanned))
    merged = embed_missing(merged, embedder) if embedder is not None else merged
    return merged, raw.unionByName(added), {"status": "updated", "file": file, "nodes_added": counts.nodes, "edges_added": added.count(), "nodes_removed": removed}


def summary(rows: DataFrame, column: str) -> DataFrame:
    """Counts by ``label`` or ``type``, in order of the name."""
    return rows.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(column)


def save(nodes: DataFrame, raw: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write both tables, split by repository."""
    for name, rows in (("nodes", nodes), ("raw_edges", raw)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").format(fmt).save(f"{path}/{name}")


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> Graph:
    """What ``save`` wrote; the stored types are read, none is guessed."""
    nodes, raw = (spark.read.format(fmt).schema(kind).load(f"{path}/{name}").select(*kind.names) for name, kind in (("nodes", NODES), ("raw_edges", RAW_EDGES)))
    return Graph(nodes, resolve_edges(nodes, raw))

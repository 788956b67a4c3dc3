"""Queries of the ingest half over source files that are generated from
``part``, a Python and a script file for each part, so that SQL can tell what
parsers and resolution have to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.resolve import resolve_edges, upsert_nodes
from codeweft.operators.vector import EMBEDDABLE, embedding_text
from codeweft.plans.ingest import emitted_nodes, empty_nodes, raw_edges, scan_files
from codeweft.plans.projection import REPO, table
from codeweft.runtime import settled

_PYTHON = '''import pkg.m{next} as nxt
from . import m{before} as prev


class C{k}(Base):
    """{type}"""

    def run(self, x):
        if x:
            raise E{error}(x)
        prev.go(x)
        return nxt.go(config.K{size})


def go(x):
    """Makes one."""
    return C{k}(x)
'''
_SCRIPT = """import {{ view{next} }} from './v{next}';
export interface Props{k} {{ id: string }}
export class Store{k} {{ }}
export const view{k} = (x) => {{ return view{next}(x.map(wrap)); }};
function Page() {{ return <Panel{error}/>; }}
"""


def _filled(template: str) -> Column:
    """The template with a part's values, as a column."""
    key = F.col("p_partkey") + 1
    out = F.lit(template.replace("{{", "{").replace("}}", "}"))
    values = {"next": key + 1, "before": key - 1, "k": key, "error": key % 5, "size": F.col("p_size"), "type": F.col("p_type")}
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


#: Parts whose files one task makes and parses: a table of few row groups would
#: be read, and so parsed, by as few tasks.
PARTS = 5000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    part = part.select("p_partkey", "p_size", "p_type").repartition(part.count() // PARTS + 1)
    key = (F.col("p_partkey") + 1).cast("string")
    kinds = F.array(F.struct(F.concat(F.lit("pkg/m"), key, F.lit(".py")).alias("file"), _filled(_PYTHON).alias("text")), F.struct(F.concat(F.lit("web/v"), key, F.lit(".tsx")).alias("file"), _filled(_SCRIPT).alias("text")))
    rows = part.select(F.explode(kinds).alias("f")).select(F.lit(REPO).alias("repo_id"), "f.file", F.col("f.text").cast("binary").alias("content"))
    return rows.select("repo_id", "file", F.sha2("content", 256).alias("file_hash"), "content")


def ingest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = upsert_nodes(empty_nodes(spark), emitted_nodes(settled(scan_files(files(spark, sf_dir)))))
    shared = F.col("label").isin("Exception", "Config")
    return nodes.select("label", "id", "name", F.when(~shared, F.col("file")).alias("file"), "line", "docstring", (F.col("file_hash").isNotNull()).alias("hashed"))


def ingest_raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(settled(scan_files(files(spark, sf_dir)))).select("source", "target", F.col("type").alias("rel_type"), "file")


def ingest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = settled(scan_files(files(spark, sf_dir)))
    nodes = upsert_nodes(empty_nodes(spark), emitted_nodes(parsed))
    return resolve_edges(nodes, raw_edges(parsed)).drop("repo_id")


def ingest_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of the classes and functions of the Python files."""
    nodes = upsert_nodes(empty_nodes(spark), emitted_nodes(settled(scan_files(files(spark, sf_dir).where("file LIKE '%.py'")))))
    return nodes.where(F.col("label").isin(*EMBEDDABLE)).select("id", embedding_text().alias("text"))


QUERIES = {"ingest_embedding_text": ingest_embedding_text, "ingest_nodes": ingest_nodes, "ingest_raw_edges": ingest_raw_edges, "ingest_edges": ingest_edges}

_PARTS = """p AS (
        SELECT p_partkey + 1 AS k, p_size AS size, p_type AS type, 'pkg/m' || (p_partkey + 1) || '.py' AS f, 'web/v' || (p_partkey + 1) || '.tsx' AS w,
            EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey + 1) AS has_next, EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey - 1) AS has_before
        FROM part
    )"""
_RAW = f"""{_PARTS}, raw AS (
        SELECT 'module::' || f AS source, 'module::pkg/m' || (k + 1) || '.py' AS target, 'IMPORTS' AS rel_type, f AS file FROM p WHERE has_next
        UNION ALL SELECT 'module::' || f, 'module::pkg/m' || (k - 1) || '.py', 'IMPORTS', f FROM p WHERE has_before
        UNION ALL SELECT 'module::' || f, f || '::C' || k, 'CONTAINS', f FROM p
        UNION ALL SELECT f || '::C' || k, f || '::Base', 'INHERITS', f FROM p
        UNION ALL SELECT f || '::C' || k, f || '::run', 'CONTAINS', f FROM p
        UNION ALL SELECT f || '::C' || k, f || '::run', 'HAS_METHOD', f FROM p
        UNION ALL SELECT f || '::run', 'exception::E' || (k % 5), 'RAISES', f FROM p
        UNION ALL SELECT f || '::run', f || '::E' || (k % 5), 'CALLS', f FROM p
        UNION ALL SELECT f || '::run', 'pkg/m' || (k - 1) || '.py::go', 'CALLS', f FROM p WHERE has_before
        UNION ALL SELECT f || '::run', 'pkg/m' || (k + 1) || '.py::go', 'CALLS', f FROM p WHERE has_next
        UNION ALL SELECT f || '::run', 'config::config.K' || size, 'READS', f FROM p
        UNION ALL SELECT 'module::' || f, f || '::go', 'CONTAINS', f FROM p
        UNION ALL SELECT f || '::go', f || '::C' || k, 'CALLS', f FROM p
        UNION ALL SELECT 'module::' || w, 'module::web/v' || (k + 1) || '.tsx', 'IMPORTS', w FROM p WHERE has_next
        UNION ALL SELECT 'module::' || w, w || '::Props' || k, 'CONTAINS', w FROM p
        UNION ALL SELECT 'module::' || w, w || '::Store' || k, 'CONTAINS', w FROM p
        UNION ALL SELECT 'module::' || w, w || '::view' || k, 'CONTAINS', w FROM p
        UNION ALL SELECT 'module::' || w, w || '::Page', 'CONTAINS', w FROM p
        UNION ALL SELECT w || '::view' || k, 'ts_call::view' || (k + 1), 'CALLS', w FROM p
        UNION ALL SELECT w || '::view' || k, 'ts_call::x.map', 'CALLS', w FROM p
        UNION ALL SELECT w || '::Page', 'ts_call::Panel' || (k % 5), 'CALLS', w FROM p
    )"""
_NODES = f"""{_PARTS}, nodes AS (
        SELECT 'Module' AS label, 'module::' || f AS id, 'pkg.m' || k AS name, f AS file, 1 AS line, NULL AS docstring, TRUE AS hashed FROM p
        UNION ALL SELECT 'Class', f || '::C' || k, 'C' || k, f, 5, type, FALSE FROM p
        UNION ALL SELECT 'Function', f || '::run', 'run', f, 8, NULL, FALSE FROM p
        UNION ALL SELECT 'Function', f || '::go', 'go', f, 15, 'Makes one.', FALSE FROM p
        UNION ALL SELECT DISTINCT 'Exception', 'exception::E' || (k % 5), 'E' || (k % 5), NULL, NULL, NULL, FALSE FROM p
        UNION ALL SELECT DISTINCT 'Config', 'config::config.K' || size, 'config.K' || size, NULL, NULL, NULL, FALSE FROM p
        UNION ALL SELECT 'Module', 'module::' || w, 'web.v' || k, w, 1, NULL, TRUE FROM p
        UNION ALL SELECT 'Class', w || '::Props' || k, 'Props' || k, w, 2, NULL, FALSE FROM p
        UNION ALL SELECT 'Class', w || '::Store' || k, 'Store' || k, w, 3, NULL, FALSE FROM p
        UNION ALL SELECT 'Function', w || '::view' || k, 'view' || k, w, 4, NULL, FALSE FROM p
        UNION ALL SELECT 'Function', w || '::Page', 'Page', w, 5, NULL, FALSE FROM p
    )"""

_TEXT = f"""WITH {_PARTS}
        SELECT f || '::C' || k AS id, '[Class] C' || k || chr(10) || 'File: ' || f || ':5' || chr(10) || 'Docstring: ' || type AS text FROM p
        UNION ALL SELECT f || '::run', array_to_string(['[Function] run', 'File: ' || f || ':8', 'Source:', '    def run(self, x):', '        if x:', '            raise E' || (k % 5) || '(x)', '        prev.go(x)', '        return nxt.go(config.K' || size || ')'], chr(10)) FROM p
        UNION ALL SELECT f || '::go', array_to_string(['[Function] go', 'File: ' || f || ':15', 'Docstring: Makes one.', 'Source:', 'def go(x):', '    ' || repeat(chr(34), 3) || 'Makes one.' || repeat(chr(34), 3), '    return C' || k || '(x)'], chr(10)) FROM p"""

ORACLE_SQL = {
    "ingest_embedding_text": _TEXT,
    "ingest_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "ingest_raw_edges": f"WITH {_RAW} SELECT * FROM raw",
    "ingest_edges": f"""WITH {_RAW}, {_NODES.replace(_PARTS + ",", "")}, clean AS (SELECT source, rel_type, replace(replace(target, 'ts_call::', ''), 'config::', '') AS target FROM raw),
        keys AS (SELECT id AS key, label, id FROM nodes UNION SELECT name, label, id FROM nodes UNION SELECT array_to_string(string_split(id, '::')[2:], '::'), label, id FROM nodes WHERE contains(id, '::'))
        SELECT DISTINCT a.label AS src_label, a.id AS src_id, rel_type, b.label AS dst_label, b.id AS dst_id FROM clean JOIN keys a ON a.key = source JOIN keys b ON b.key = target""",
}

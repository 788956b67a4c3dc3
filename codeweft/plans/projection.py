"""A property graph over business tables: nations are modules, suppliers
classes, parts functions; orders tell which part calls which. Every pair of
neighbouring order lines is a call and every supplier of a part has it as a
method; ``thinned`` keeps few calls and methods, for queries that enumerate
paths, whose number grows with the power of the degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.schema import Graph

REPO = "r0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def function_id(key) -> F.Column:
    return F.concat(F.lit("p/"), key.cast("string"), F.lit("::"), F.col("p_name"))


def repository(key, several: bool) -> F.Column:
    """One repository for all, or three by the part's number."""
    return F.concat(F.lit("repo"), (key % 3).cast("string")) if several else F.lit(REPO)


#: Rows of a stored table that a task takes of what is put together by key.
TASK_ROWS = 150_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """In how many parts what follows the stored tables is put together: with a
    fixed number a task would hold more the larger they are. Most edges come from
    order lines; a stored table's count comes from the footers of its files."""
    rows = max(table(spark, sf_dir, name).count() for name in ("lineitem", "events"))
    return max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1)


def functions(spark: SparkSession, sf_dir: str, several: bool = False) -> DataFrame:
    """Parts as nodes without embedding, in one or three repositories."""
    part = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    return part.select(repository(F.col("p_partkey"), several).alias("repo_id"), F.lit("Function").alias("label"), function_id(F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("file"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("docstring"), none.alias("file_hash"), F.lit(None).cast("int").alias("line"), none.alias("source_code"), F.lit(None).cast("array<float>").alias("embedding"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("string")
    modules = read("nation").select(F.lit("Module").alias("label"), F.concat(F.lit("module::"), "n_name").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("file"), none.alias("docstring"), F.sha2("n_name", 256).alias("file_hash"))
    place = F.concat(F.lit("s/"), F.col("s_suppkey").cast("string"))
    classes = read("supplier").select(F.lit("Class").alias("label"), F.concat(place, F.lit("::"), "s_name").alias("id"), F.col("s_name").alias("name"), place.alias("file"), none.alias("docstring"), none.alias("file_hash"))
    parts = functions(spark, sf_dir).select("label", "id", "name", "file", "docstring", "file_hash")
    key = F.get_json_object("props", "$.k").cast("bigint")
    events = read("events")
    raised = F.concat(F.lit("E"), (key % 5).cast("string"))
    errors = events.where("event_type = 'error'").select(raised.alias("name")).where("name IS NOT NULL").distinct().select(F.lit("Exception").alias("label"), F.concat(F.lit("exception::"), "name").alias("id"), "name", none.alias("file"), none.alias("docstring"), none.alias("file_hash"))
    read_key = F.concat(F.lit("config.K"), key.cast("string"))
    configs = events.where("event_type = 'view'").select(read_key.alias("name")).where("name IS NOT NULL").distinct().select(F.lit("Config").alias("label"), F.concat(F.lit("config::"), "name").alias("id"), "name", none.alias("file"), none.alias("docstring"), none.alias("file_hash"))
    every = modules.unionByName(classes).unionByName(parts).unionByName(errors).unionByName(configs)
    return every.select(F.lit(REPO).alias("repo_id"), "*", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("source_code"), F.lit(None).cast("array<float>").alias("embedding"))


def call_pairs(spark: SparkSession, sf_dir: str, thinned: bool = False, n: int | None = None) -> DataFrame:
    """Distinct ``x, y``: part x calls part y; those of a caller are in one of ``n`` parts."""
    n = n or parts(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    near = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    near = near.where("l_returnflag = 'R'") if thinned else near
    begin = near.where("l_quantity > 40") if thinned else near
    line = lambda df, name, step: df.select("l_orderkey", (F.col("l_linenumber") + step).alias("line"), F.col("l_partkey").alias(name)).repartition(n, "l_orderkey", "line")
    return line(begin, "x", 1).join(line(near, "y", 0), ["l_orderkey", "line"]).select("x", "y").repartition(n, "x").distinct()


def edges(spark: SparkSession, sf_dir: str, thinned: bool = False) -> DataFrame:
    """Each kind is made distinct by the numbers of its ends, before they are
    spelled out: no two kinds have an edge in common. What is made distinct is dealt
    by the end that is spelled out first, and the names by the part's number, so
    one shuffle serves both."""
    read = lambda name: table(spark, sf_dir, name)
    n = parts(spark, sf_dir)
    # a part of them fits a task's memory; they don't go through the driver
    names = read("part").select("p_partkey", function_id(F.col("p_partkey")).alias("fid")).repartition(n, "p_partkey").distinct().hint("shuffle_hash")
    lines = read("lineitem")
    items = lines.where("l_quantity >= 49") if thinned else lines
    calls = call_pairs(spark, sf_dir, thinned, n).join(names.select(F.col("p_partkey").alias("x"), F.col("fid").alias("src_id")), "x")
    calls = calls.repartition(n, "y").join(names.select(F.col("p_partkey").alias("y"), F.col("fid").alias("dst_id")), "y")
    suppliers = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.concat(F.lit("s/"), F.col("s_suppkey").cast("string"), F.lit("::"), "s_name").alias("cid"))
    methods = items.select("l_suppkey", F.col("l_partkey").alias("p_partkey")).repartition(n, "l_suppkey").distinct()
    methods = methods.join(suppliers.select("l_suppkey", "cid").distinct(), "l_suppkey").repartition(n, "p_partkey").join(names, "p_partkey")
    contains = read("nation").select("n_nationkey", "n_name").distinct().join(suppliers, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "cid").distinct()
    key = F.get_json_object("props", "$.k").cast("bigint")
    seen = read("events").where("event_type IN ('error', 'view')").select(F.col("user_id").alias("p_partkey"), "event_type", F.when(F.col("event_type") == "error", key % 5).otherwise(key).alias("k")).where("k IS NOT NULL")
    events = seen.repartition(n, "p_partkey").distinct().join(names, "p_partkey")
    row = lambda df, source, s, kind, target, t: df.select(F.lit(REPO).alias("repo_id"), F.lit(source).alias("src_label"), s.alias("src_id"), F.lit(kind).alias("rel_type"), F.lit(target).alias("dst_label"), t.alias("dst_id"))
    out = row(calls, "Function", F.col("src_id"), "CALLS", "Function", F.col("dst_id"))
    out = out.unionByName(row(methods, "Class", F.col("cid"), "HAS_METHOD", "Function", F.col("fid")))
    out = out.unionByName(row(contains, "Module", F.concat(F.lit("module::"), "n_name"), "CONTAINS", "Class", F.col("cid")))
    out = out.unionByName(row(events.where("event_type = 'error'"), "Function", F.col("fid"), "RAISES", "Exception", F.concat(F.lit("exception::E"), F.col("k").cast("string"))))
    return out.unionByName(row(events.where("event_type = 'view'"), "Function", F.col("fid"), "READS", "Config", F.concat(F.lit("config::config.K"), F.col("k").cast("string"))))


def graph(spark: SparkSession, sf_dir: str, thinned: bool = False) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, thinned), parts(spark, sf_dir))


def repositories(spark: SparkSession, sf_dir: str) -> Graph:
    """Functions in three repositories; a call belongs to its caller's, and
    leads out of it where the called part is in another."""
    own = functions(spark, sf_dir, several=True)
    names = table(spark, sf_dir, "part").select("p_partkey", function_id(F.col("p_partkey")).alias("fid"))
    calls = call_pairs(spark, sf_dir).join(names.select(F.col("p_partkey").alias("x"), F.col("fid").alias("src_id")), "x").join(names.select(F.col("p_partkey").alias("y"), F.col("fid").alias("dst_id")), "y")
    return Graph(own, calls.select(repository(F.col("x"), True).alias("repo_id"), F.lit("Function").alias("src_label"), "src_id", F.lit("CALLS").alias("rel_type"), F.lit("Function").alias("dst_label"), "dst_id"))


#: The same projection for the SQL side.
_SQL = """
    fn AS (SELECT p_partkey, 'p/' || p_partkey || '::' || p_name AS fid FROM part),
    cl AS (SELECT s_suppkey, s_nationkey, s_name, 's/' || s_suppkey || '::' || s_name AS cid FROM supplier),
    ev AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    nodes AS (
        SELECT 'Module' AS label, 'module::' || n_name AS id, n_name AS name, n_name AS file, CAST(NULL AS VARCHAR) AS docstring FROM nation
        UNION ALL SELECT 'Class', cid, s_name, 's/' || s_suppkey, NULL FROM cl
        UNION ALL SELECT 'Function', 'p/' || p_partkey || '::' || p_name, p_name, 'p/' || p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type END FROM part
        UNION ALL SELECT DISTINCT 'Exception', 'exception::E' || (k % 5), 'E' || (k % 5), NULL, NULL FROM ev WHERE event_type = 'error' AND k IS NOT NULL
        UNION ALL SELECT DISTINCT 'Config', 'config::config.K' || k, 'config.K' || k, NULL, NULL FROM ev WHERE event_type = 'view' AND k IS NOT NULL
    ),
    edges AS (
        SELECT DISTINCT 'Function' AS src_label, f.fid AS src_id, 'CALLS' AS rel_type, 'Function' AS dst_label, g.fid AS dst_id
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN fn f ON f.p_partkey = a.l_partkey JOIN fn g ON g.p_partkey = b.l_partkey
        WHERE {calls}
        UNION SELECT 'Class', cid, 'HAS_METHOD', 'Function', fid FROM lineitem JOIN cl ON l_suppkey = s_suppkey JOIN fn ON l_partkey = p_partkey WHERE {methods}
        UNION SELECT 'Module', 'module::' || n_name, 'CONTAINS', 'Class', cid FROM nation JOIN cl ON n_nationkey = s_nationkey
        UNION SELECT 'Function', fid, 'RAISES', 'Exception', 'exception::E' || (k % 5) FROM ev JOIN fn ON user_id = p_partkey WHERE event_type = 'error' AND k IS NOT NULL
        UNION SELECT 'Function', fid, 'READS', 'Config', 'config::config.K' || k FROM ev JOIN fn ON user_id = p_partkey WHERE event_type = 'view' AND k IS NOT NULL
    ),
    calls AS (SELECT src_id, dst_id FROM edges WHERE rel_type = 'CALLS')
"""
SQL = _SQL.replace("{calls}", "TRUE").replace("{methods}", "TRUE")
THIN_SQL = _SQL.replace("{calls}", "a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_quantity > 40").replace("{methods}", "l_quantity >= 49")
REPOSITORIES_SQL = """
    fn AS (SELECT p_partkey, p_name, 'repo' || (p_partkey % 3) AS repo_id, 'p/' || p_partkey || '::' || p_name AS fid FROM part),
    calls AS (
        SELECT DISTINCT f.repo_id, f.fid AS src_id, g.fid AS dst_id, g.repo_id AS dst_repo
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN fn f ON f.p_partkey = a.l_partkey JOIN fn g ON g.p_partkey = b.l_partkey
    )
"""

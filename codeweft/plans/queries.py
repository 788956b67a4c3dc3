"""Registered queries over the projected graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import metrics
from codeweft.operators import adjacency, inspect, knn, resolve, sync, traverse, vector
from codeweft.plans import generated, questions, resolution, sessions, tracked
from codeweft.plans.projection import REPO, REPOSITORIES_SQL, SQL, THIN_SQL, edges, graph, nodes, parts, repositories, table
from codeweft.runtime import settled
from codeweft.schema import Graph

joined = traverse.rendered


def _busiest(g: Graph, end: str = "src") -> DataFrame:
    """The function with the most calls, the first by id of several."""
    calls = g.edges.where("rel_type = 'CALLS'").groupBy(F.col(f"{end}_label").alias("label"), F.col(f"{end}_id").alias("id")).agg(F.count("*").alias("n"))
    return calls.orderBy(F.desc("n"), "id").limit(1).select("label", "id")


_BUSY = "busy AS (SELECT {0} AS id FROM calls GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


def _calls(spark: SparkSession, sf_dir: str, thinned: bool = False) -> Graph:
    """The projected graph with its calls alone, written once: each depth of a
    chain reads them."""
    return Graph(nodes(spark, sf_dir), settled(edges(spark, sf_dir, thinned).where("rel_type = 'CALLS'")), parts(spark, sf_dir))


#: Up to this depth all chains of the whole graph are listed; beyond it those of
#: the thinned one, as each further call has some 15 times as many.
LISTED_DEPTH = 2


def call_chain(depth: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _calls(spark, sf_dir, thinned=depth > LISTED_DEPTH)
        starts = g.edges.where("rel_type = 'CALLS'").select(F.col("src_label").alias("label"), F.col("src_id").alias("id"))
        paths = traverse.call_chains(g, starts, depth)
        return paths.select(joined(F.col("node_ids")).alias("node_ids"), joined(F.col("call_chain")).alias("call_chain"), "depth")

    return run


def _chain_sql(depth: int, upstream: bool = False) -> str:
    near, far = ("dst_id", "src_id") if upstream else ("src_id", "dst_id")
    grow = (lambda a, x: f"list_prepend({x}, {a})") if upstream else (lambda a, x: f"list_append({a}, {x})")
    start = "SELECT id FROM busy" if upstream else "SELECT DISTINCT src_id FROM calls"
    return f"""WITH RECURSIVE {SQL if upstream or depth <= LISTED_DEPTH else THIN_SQL}{", " + _BUSY.format("dst_id") if upstream else ""},
        paths AS (
            SELECT id AS node, [id] AS node_ids, CAST([] AS VARCHAR[]) AS used, 0 AS depth FROM ({start}) s(id)
            UNION ALL
            SELECT {far}, {grow("node_ids", far)}, list_append(used, src_id || '>' || dst_id), depth + 1
            FROM paths JOIN calls ON node = {near} WHERE depth < {depth} AND NOT list_contains(used, src_id || '>' || dst_id)
        )
        SELECT array_to_string(node_ids, '|') AS node_ids, array_to_string(list_transform(node_ids, lambda x: regexp_replace(x, '^.*::', '')), '|') AS call_chain, depth
        FROM paths WHERE depth > 0"""


def call_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chains of one to three calls begin at each function."""
    return traverse.chain_counts(graph(spark, sf_dir)).drop("label")


def upstream_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _calls(spark, sf_dir)
    paths = traverse.call_chains(g, settled(_busiest(g, "dst")), 4, upstream=True)
    return paths.select(joined(F.col("node_ids")).alias("node_ids"), joined(F.col("call_chain")).alias("call_chain"), "depth")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Graph, adjacency.Adjacency]:
    """The projected graph with its edges stored for traversal."""
    held = adjacency.store(edges(spark, sf_dir), buckets=parts(spark, sf_dir))
    out = held.table.where("outward").select("repo_id", F.col("label").alias("src_label"), F.col("id").alias("src_id"), "rel_type", F.col("to_label").alias("dst_label"), F.col("to_id").alias("dst_id"))
    return Graph(nodes(spark, sf_dir), out, parts(spark, sf_dir)), held


def _written(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph with its edges written once: for one question, to sort
    them for traversal as well would take longer than its few scans."""
    return Graph(nodes(spark, sf_dir), settled(edges(spark, sf_dir)), parts(spark, sf_dir))


def subgraph(hops: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _written(spark, sf_dir)
        return traverse.subgraph(g, settled(_busiest(g)), hops)

    return run


def _subgraph_sql(hops: int, seeds: str = "SELECT 'Function' AS label, id FROM busy", more: str = ", " + _BUSY.format("src_id")) -> str:
    levels = f"l0 AS ({seeds})"
    for h in range(1, hops):
        levels += f", l{h} AS (SELECT * FROM l{h - 1} UNION SELECT dst_label, dst_id FROM edges JOIN l{h - 1} ON src_id = id AND src_label = label UNION SELECT src_label, src_id FROM edges JOIN l{h - 1} ON dst_id = id AND dst_label = label)"
    last = f"l{hops - 1}"
    return f"""WITH {SQL}{more}, {levels}
        SELECT DISTINCT e.src_id AS source_id, e.src_label AS source_type, a.name AS source_name, e.rel_type, e.dst_id AS target_id, e.dst_label AS target_type, b.name AS target_name
        FROM edges e JOIN nodes a ON a.label = e.src_label AND a.id = e.src_id JOIN nodes b ON b.label = e.dst_label AND b.id = e.dst_id
        WHERE (e.src_label, e.src_id) IN (SELECT (label, id) FROM {last}) OR (e.dst_label, e.dst_id) IN (SELECT (label, id) FROM {last})"""


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _written(spark, sf_dir)
    target = settled(g.nodes.join(F.broadcast(_busiest(g, "dst")), ["label", "id"]))  # one row
    found = traverse.impact(g, target)
    return found.select("id", *[joined(F.col(c)).alias(c) for c in ("callers", "callees", "exceptions", "configs")])


_IMPACT_SQL = f"""WITH {SQL}, {_BUSY.format("dst_id")},
    c1 AS (SELECT DISTINCT src_id AS id FROM calls JOIN busy ON dst_id = id),
    c2 AS (SELECT DISTINCT src_id AS id FROM calls JOIN c1 ON dst_id = id),
    c3 AS (SELECT DISTINCT src_id AS id FROM calls JOIN c2 ON dst_id = id),
    callers AS (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3),
    out AS (SELECT e.rel_type, e.dst_id FROM edges e JOIN busy ON e.src_id = busy.id)
    SELECT id,
        coalesce((SELECT string_agg(id, '|' ORDER BY id) FROM callers), '') AS callers,
        coalesce((SELECT string_agg(dst_id, '|' ORDER BY dst_id) FROM out WHERE rel_type = 'CALLS'), '') AS callees,
        coalesce((SELECT string_agg(dst_id, '|' ORDER BY dst_id) FROM out WHERE rel_type = 'RAISES'), '') AS exceptions,
        coalesce((SELECT string_agg(dst_id, '|' ORDER BY dst_id) FROM out WHERE rel_type = 'READS'), '') AS configs
    FROM busy"""


def impact_part(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        callers = g.edges.where("rel_type = 'CALLS'").select(F.col("src_label").alias("label"), F.col("src_id").alias("id"))
        rel, label = {"callees": ("CALLS", "Function"), "exceptions": ("RAISES", "Exception"), "configs": ("READS", "Config")}.get(name, (None, None))
        found = traverse.callers(g, _busiest(g, "dst")) if rel is None else traverse.neighbours(g, callers.distinct(), rel, label)
        return found.select("id")

    return run


def _impact_part_sql(name: str) -> str:
    if name == "callers":
        return _IMPACT_SQL.split("out AS (")[0].rstrip().rstrip(",") + " SELECT id FROM callers"
    rel = {"callees": "CALLS", "exceptions": "RAISES", "configs": "READS"}[name]
    return f"WITH {SQL} SELECT DISTINCT dst_id AS id FROM edges WHERE rel_type = '{rel}' AND src_id IN (SELECT src_id FROM calls)"


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as a parser would leave them: by id, by name, or unresolved."""
    g = edges(spark, sf_dir).where("rel_type = 'CALLS'")
    number = F.regexp_extract("dst_id", r"^p/(\d+)::", 1).cast("bigint")
    name = F.regexp_replace("dst_id", r"^.*::", "")
    target = F.when(number % 4 == 0, F.col("dst_id")).when(number % 4 == 1, name).when(number % 4 == 2, F.concat(F.lit("ts_call::"), F.col("dst_id"))).otherwise(F.concat(F.lit("lost::"), name))
    return g.select("repo_id", F.col("src_id").alias("source"), target.alias("target"), F.lit("CALLS").alias("type"), F.regexp_extract("src_id", r"^(.*)::", 1).alias("file"))


_RAW_SQL = f"""{SQL}, raw AS (
        SELECT src_id AS source, regexp_extract(src_id, '^(.*)::', 1) AS file, CASE k % 4 WHEN 0 THEN dst_id WHEN 1 THEN name WHEN 2 THEN 'ts_call::' || dst_id ELSE 'lost::' || name END AS target
        FROM (SELECT src_id, dst_id, CAST(regexp_extract(dst_id, '^p/(\\d+)::', 1) AS BIGINT) AS k, regexp_replace(dst_id, '^.*::', '') AS name FROM calls)
    ), clean AS (SELECT *, replace(replace(target, 'ts_call::', ''), 'config::', '') AS t FROM raw)"""
_NAMES = "(n.id = {0} OR n.name = {0} OR ends_with(n.id, '::' || {0}))"

_RESOLVED_SQL = f"SELECT DISTINCT n.label AS src_label, n.id AS src_id, 'CALLS' AS rel_type, m.label AS dst_label, m.id AS dst_id FROM clean JOIN nodes n ON {_NAMES.format('source')} JOIN nodes m ON {_NAMES.format('t').replace('n.', 'm.')}"


def fuzzy_resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_edges(nodes(spark, sf_dir), raw_edges(spark, sf_dir), written=True).drop("repo_id")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dangling_edges(nodes(spark, sf_dir), raw_edges(spark, sf_dir), parts(spark, sf_dir)).select("source", "target")


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and current files: every part is a file; of the current ones
    each seventh changed and each eleventh is gone, and suppliers are new."""
    part = table(spark, sf_dir, "part")
    file = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))
    stored = part.select(file.alias("file"), F.sha2("p_name", 256).alias("file_hash"), "p_partkey")
    current = stored.where("p_partkey % 11 <> 0").withColumn("file_hash", F.when(F.col("p_partkey") % 7 == 0, "changed").otherwise(F.col("file_hash"))).select("file", "file_hash")
    added = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("file"), F.lit("new").alias("file_hash"))
    return stored.select("file", "file_hash"), current.unionByName(added)


def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.file_diff(*_moved(spark, sf_dir))


def delete_file_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = file_diff(spark, sf_dir).where("status = 'deleted'")
    return sync.without_files(nodes(spark, sf_dir), gone, REPO).select("label", "id")


def stale_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges into the busiest file once it is gone."""
    g = graph(spark, sf_dir)
    file = _busiest(g, "dst").select(F.regexp_extract("id", r"^(.*)::", 1).alias("file")).first().file
    left = sync.without_files(g.nodes, spark.createDataFrame([(file,)], "file string"), REPO)
    raw = g.edges.where("rel_type = 'CALLS'").select("repo_id", F.col("src_id").alias("source"), F.col("dst_id").alias("target"), F.lit("CALLS").alias("type"), F.regexp_extract("src_id", r"^(.*)::", 1).alias("file"))
    return sync.stale_edges(left, raw, file, REPO).select("source", "target")


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    text = F.col("vec_id").cast("string")
    return v.select(F.concat(F.lit("repo"), (F.col("label") % 3).cast("string")).alias("repo_id"), F.when(F.col("label") % 2 == 0, "Function").otherwise("Class").alias("label"), F.concat(F.lit("v/"), text).alias("id"), text.alias("name"), F.concat(F.lit("f"), text).alias("file"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("source_code"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def top_k(label: str, repo: str | None = None, compat: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = vector.vector_top_k(vector_nodes(spark, sf_dir), _query_vector(spark, sf_dir), label, 5, repo, compat=compat)
        return found.select("id", "name", "file", F.round("score", 6).alias("score"))

    return run


_VECTORS = """v AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'Function' ELSE 'Class' END AS kind, 'repo' || (label % 3) AS repo,
        list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) AS s FROM embeddings)"""


def _top_sql(kind: str, source: str = "v", where: str = "TRUE") -> str:
    return f"SELECT 'v/' || vec_id AS id, CAST(vec_id AS VARCHAR) AS name, 'f' || vec_id AS file, round(s, 6) AS score FROM {source} WHERE kind = '{kind}' AND {where} ORDER BY s DESC, 'v/' || vec_id LIMIT 5"


def _placed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Nodes with vectors: they stand at the functions and classes of their
    number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("e"))
    number = F.regexp_extract("id", r"^[ps]/(\d+)::", 1)
    return rows.drop("embedding").withColumn("n", F.when(number != "", number).cast("bigint")).join(v, "n", "left").withColumn("embedding", F.col("e"))


def hybrid_retrieve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _written(spark, sf_dir)
    seeds = vector.seeds(_placed(spark, sf_dir, g.nodes), _query_vector(spark, sf_dir), 3)
    return traverse.subgraph(g, settled(seeds), 2)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asks with the vector of its number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").join(v, "item_id").select(F.col("item_id").alias("query_id"), "vector")


def batch_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions.seeds(_placed(spark, sf_dir, nodes(spark, sf_dir)), _asked(spark, sf_dir), 3)
    return found.select("query_id", "label", "rank", "id", F.round("score", 6).alias("score"))


def batch_retrieve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, held = _stored(spark, sf_dir)
    return questions.retrieve_all(_placed(spark, sf_dir, g.nodes), held, _asked(spark, sf_dir), 3, 1)


_BATCH_SEEDS = r"""asked AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON item_id = vec_id),
    placed AS (SELECT n.label, n.id, CAST(embedding AS DOUBLE[]) AS v FROM nodes n JOIN embeddings ON CAST(vec_id AS VARCHAR) = regexp_extract(n.id, '^[ps]/(\d+)::', 1) WHERE n.label IN ('Function', 'Class')),
    near AS (SELECT * FROM (SELECT query_id, label, id, s, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, id) AS rank FROM (SELECT query_id, label, id, list_cosine_similarity(q, v) AS s FROM asked, placed)) WHERE rank <= 3)"""


def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = knn.nearest(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector's ten nearest, from the cells that can hold one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found, _ = knn.search(knn.build(v), _query_vector(spark, sf_dir), 10)
    return found.select("id", F.round("score", 6).alias("score"))


_HYBRID_SQL = _subgraph_sql(
    2,
    "SELECT label, id FROM near",
    f""", {_VECTORS}, placed AS (SELECT n.label, n.id, v.s FROM nodes n JOIN v ON CAST(v.vec_id AS VARCHAR) = regexp_extract(n.id, '^[ps]/(\\d+)::', 1) WHERE n.label IN ('Function', 'Class')),
    near AS (SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS r FROM placed) WHERE r <= 3)""",
)


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).where(F.col("label").isin(*vector.EMBEDDABLE))
    return own.select("id", vector.embedding_text().alias("text"))


def conversation_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chats and messages out of ``conversations``."""
    turns = table(spark, sf_dir, "conversations")
    messages = turns.select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    chats = turns.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("chat_id"), F.concat(F.lit("repo"), (F.col("conv_id") % 30).cast("string")).alias("repo_id"))
    return chats, messages


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("repo"), F.col("n_nationkey").cast("string")).alias("repo_id"), F.col("n_name").alias("name"), F.concat(F.lit("/src/"), F.col("n_name")).alias("source"))


def chat_list_with_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats, _ = conversation_tables(spark, sf_dir)
    return sessions.chats_with_repo(chats, _repos(spark, sf_dir)).select("chat_id", "repo_id", "repo_name")


def message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, messages = conversation_tables(spark, sf_dir)
    return sessions.message_counts(messages)


def auto_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, messages = conversation_tables(spark, sf_dir)
    return sessions.auto_titles(messages)


def find_repo_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.find_repo_by_source(_repos(spark, sf_dir), " /home/x/NATION_3 ").select("repo_id", "name")


def delete_repo_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats, messages = conversation_tables(spark, sf_dir)
    return sessions.delete_repo(_repos(spark, sf_dir), chats, messages, "repo3")[2].groupBy("chat_id").agg(F.count("*").alias("n"))


def tracker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.plans.tracker import STAGES

    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    stage = F.get(F.array(*map(F.lit, STAGES)), F.array_position(kinds, F.col("event_type")).cast("int") - 1)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo_id"), F.struct("ts", "event_id").alias("seq"), F.lit("update").alias("op"), stage.alias("stage"), F.greatest(F.lit(0), F.least(F.lit(100), F.floor("value"))).cast("int").alias("percent"))


def tracker_latest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.plans.tracker import latest_stages

    return latest_stages(tracker_events(spark, sf_dir).where("stage IS NOT NULL"))


def dot_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeweft.plans.tracker import dot_color as color

    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "indexing").otherwise("idle")
    return table(spark, sf_dir, "orders").groupBy(color(status).alias("color")).agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document answers one item, by its number among all items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ground_truth"))
    number = items.agg(F.count("*").alias("items"))  # one row
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(number)).select("doc_id", F.col("text").alias("answer"), F.pmod("doc_id", "items").alias("item_id"))
    return docs.join(items, "item_id")


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", F.round(metrics.jaccard(metrics.tokens(F.col("answer")), metrics.tokens(F.col("ground_truth"))), 6).alias("overlap"))


def _scored(spark: SparkSession, sf_dir: str, score=metrics.entity_scores) -> DataFrame:
    expected = F.transform(F.slice(F.split("ground_truth", " "), 1, 3), lambda w: F.concat(F.lit("svc."), F.regexp_replace(w, "[^A-Za-z]", "")))
    return score(_answers(spark, sf_dir).withColumn("expected_entities", F.filter(expected, lambda e: F.length(e) > 4)))


def entity_recall_precision_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def eval_summary_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 2 == 0, "single").otherwise("agent")
    rows = _scored(spark, sf_dir, metrics.evaluate).withColumns({"mode": mode, "latency": F.length("answer") / 1000})
    return metrics.summary(rows)


_STOP = ", ".join(f"'{w}'" for w in metrics.STOP_WORDS)
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND len(w) > 1 AND w NOT IN (" + _STOP + ")))"
_ANSWERS = f"""a AS (
        SELECT doc_id, d.text AS answer, b.text AS truth, {_TOKENS.format("d.text")} AS x, {_TOKENS.format("b.text")} AS y,
            list_filter(list_transform(string_split(b.text, ' ')[1:3], lambda w: 'svc.' || regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda e: len(e) > 4) AS expected
        FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
    ), o AS (
        SELECT *, CASE WHEN len(y) = 0 THEN 1.0 WHEN len(x) = 0 THEN 0.0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END AS overlap FROM a
    ), r AS (
        SELECT *, CASE WHEN len(expected) = 0 THEN 1.0 ELSE CAST(len(list_filter(expected, lambda e: contains(lower(answer), lower(e)) OR contains(lower(answer), lower(string_split(e, '.')[-1])))) AS DOUBLE) / len(expected) END AS recall,
            list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower(answer), '[^\\P{{L}}\\x00-\\x7F]', 'Z', 'g'), '[^\\P{{N}}\\x00-\\x7F]', 'Z', 'g'), '\\b{metrics.DOTTED}\\b')) AS dotted FROM o
    ), p AS (
        SELECT *, CASE WHEN len(expected) = 0 THEN 1.0 WHEN len(dotted) > 0 THEN greatest(0.5, least(1.0, CAST(len(list_filter(dotted, lambda m: len(list_filter(expected, lambda e: contains(m, lower(e)) OR contains(lower(e), m))) > 0)) AS DOUBLE) / len(dotted)))
            WHEN recall > 0 THEN 1.0 ELSE 0.0 END AS precision FROM r
    ), s AS (SELECT *, CASE WHEN recall + precision = 0 THEN 0.0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM p)"""


def _of(f, *names: str, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = f(graph(spark, sf_dir), **more)
        return found.select(*names) if names else found

    return run


def repo_isolation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each of three repositories, seen from within; an edge counts
    where both its ends are."""
    g = repositories(spark, sf_dir)
    found = None
    for k in range(3):
        own = inspect.repo_stats(g, f"repo{k}").withColumn("repo_id", F.lit(f"repo{k}"))
        found = own if found is None else found.unionByName(own)
    return found


def repo_isolation_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds the busiest function of one repository, within it."""
    g = repositories(spark, sf_dir).within("repo1")
    return traverse.subgraph(g, _busiest(g), 1)


def repo_isolation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by name: they find functions of their own repository only."""
    g = repositories(spark, sf_dir)
    raw = g.edges.select("repo_id", F.col("src_id").alias("source"), F.regexp_replace("dst_id", r"^.*::", "").alias("target"), F.lit("CALLS").alias("type"))
    return resolve.resolve_edges(g.nodes, raw, written=True).select("repo_id", "src_id", "dst_id")


def chat_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats, _ = conversation_tables(spark, sf_dir)
    moved = sessions.set_repo(chats, "3", "repo1")
    return sessions.chats_with_repo(sessions.get_chat(moved, "3"), _repos(spark, sf_dir)).select("chat_id", "repo_id", "repo_name")


def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that each of some references names: by id, by name, by name
    within a module, and inside an id."""
    name = table(spark, sf_dir, "part").where("p_partkey = 7").first().p_name
    every, found = nodes(spark, sf_dir), None
    for kind, reference in (("id", f"p/7::{name}"), ("name", name), ("module", f"p/7.{name}"), ("part", f"7::{name}")):
        own = traverse.find_node(every, reference).select(F.lit(kind).alias("kind"), "label", "id")
        found = own if found is None else found.unionByName(own)
    return found


_FIND_SQL = f"""WITH {SQL}, q AS (SELECT p_name AS n FROM part WHERE p_partkey = 7),
    r AS (SELECT 'id' AS kind, 'p/7::' || n AS ref, n AS last, 'p/7' AS module FROM q UNION ALL SELECT 'name', n, n, '' FROM q UNION ALL SELECT 'module', 'p/7.' || n, n, 'p/7' FROM q UNION ALL SELECT 'part', '7::' || n, n, '7' FROM q),
    t AS (SELECT kind, label, id, CASE WHEN id = ref THEN 1 WHEN ends_with(id, '::' || ref) THEN 2 WHEN name = ref THEN 3 WHEN name = last AND (contains(coalesce(file, ''), module) OR contains(id, module)) THEN 4 WHEN contains(id, ref) THEN 5 END AS tier FROM r, nodes)
    SELECT kind, label, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY tier, length(id), id, label) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1"""


_DEGREE = "SELECT src_label AS label, src_id AS id FROM edges UNION ALL SELECT dst_label, dst_id FROM edges"
_ONCE = "SELECT src_label AS label, src_id AS id FROM edges UNION ALL SELECT dst_label, dst_id FROM edges WHERE NOT (src_label = dst_label AND src_id = dst_id)"
_SCAN = "SELECT src_id AS source, a.name AS source_name, dst_id AS target, b.name AS target_name FROM edges JOIN nodes a ON a.id = src_id JOIN nodes b ON b.id = dst_id WHERE rel_type = '{0}' ORDER BY source, target LIMIT 50"

QUERIES = {
    "node_count_by_label": _of(inspect.count_by_label),
    "edge_count_by_type": _of(inspect.count_by_type),
    "repo_stats": _of(inspect.repo_stats, repo_id=REPO),
    "graph_preview_nodes": _of(inspect.preview_nodes, highlighted=["E1", "config::config.K3"]),
    "graph_preview_edges": _of(inspect.preview_edges),
    **{f"call_chain_d{d}": call_chain(d) for d in (1, 2, 3, 4)},
    "upstream_callers": upstream_callers,
    "subgraph_1hop": subgraph(1),
    "subgraph_2hop": subgraph(2),
    "impact": impact,
    **{f"impact_{n}": impact_part(n) for n in ("callers", "callees", "exceptions", "configs")},
    "preset_no_docstring": _of(inspect.no_docstring),
    "preset_high_method_count": _of(inspect.high_method_count),
    "preset_unused_function": _of(inspect.unused_function),
    "preset_high_coupling": _of(inspect.high_coupling),
    "preset_no_test_coverage": _of(inspect.no_test_coverage),
    "ui_call_graph": _of(inspect.edge_scan, rel_type="CALLS"),
    "ui_class_methods": _of(inspect.edge_scan, rel_type="HAS_METHOD"),
    "ui_module_contents": _of(inspect.edge_scan, rel_type="CONTAINS", src_label="Module"),
    "ui_hubs": _of(inspect.hubs),
    "ui_whole_graph": _of(inspect.whole_graph),
    "fuzzy_resolve_edges": fuzzy_resolve_edges,
    "dangling_edges": dangling_edges,
    "vector_topk_function": top_k("Function"),
    "vector_topk_class": top_k("Class"),
    "vector_topk_repo": top_k("Function", "repo1"),
    "vector_topk_overfetch_compat": top_k("Function", "repo1", "overfetch"),
    "hybrid_retrieve_edges": hybrid_retrieve_edges,
    "embedding_text": embedding_text,
    "file_diff": file_diff,
    "delete_file_survivors": delete_file_survivors,
    "stale_edges": stale_edges,
    "chat_list_with_repo": chat_list_with_repo,
    "message_count": message_count,
    "auto_title": auto_title,
    "find_repo_by_source": find_repo_by_source,
    "delete_repo_survivors": delete_repo_survivors,
    "tracker_latest_stage": tracker_latest_stage,
    "dot_color": dot_color,
    "token_jaccard": token_jaccard,
    "entity_recall_precision_f1": entity_recall_precision_f1,
    "eval_summary_avg": eval_summary_avg,
    "repo_isolation_stats": repo_isolation_stats,
    "repo_isolation_subgraph": repo_isolation_subgraph,
    "repo_isolation_resolve": repo_isolation_resolve,
    "chat_get": chat_get,
    "find_node": find_node,
    **generated.QUERIES,
    **tracked.QUERIES,
    "call_chain_all_d2": call_chain(2),
    "call_chain_counts": call_chain_counts,
    "batch_seeds": batch_seeds,
    "batch_retrieve_edges": batch_retrieve_edges,
    "knn_embeddings": knn_embeddings,
    "vector_index_topk": vector_index_topk,
    **resolution.queries(nodes, raw_edges, _moved),
}

ORACLE_SQL = {
    "node_count_by_label": f"WITH {SQL} SELECT label, count(*) AS cnt FROM nodes GROUP BY label",
    "edge_count_by_type": f"WITH {SQL} SELECT rel_type, count(*) AS cnt FROM edges GROUP BY rel_type",
    "repo_stats": f"WITH {SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges WHERE src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes)) AS edge_count, (SELECT count(DISTINCT file) FROM nodes) AS file_count",
    "graph_preview_nodes": f"WITH {SQL}, deg AS (SELECT label, id, count(*) AS n FROM ({_DEGREE}) GROUP BY label, id) SELECT f.id, f.name, f.label, coalesce(n, 0) AS degree, f.name = 'E1' OR f.id = 'config::config.K3' AS highlighted FROM (SELECT * FROM nodes ORDER BY id, label LIMIT 60) f LEFT JOIN deg USING (label, id)",
    "graph_preview_edges": f"WITH {SQL}, f AS (SELECT id FROM nodes ORDER BY id, label LIMIT 60) SELECT DISTINCT src_id AS source, dst_id AS target, rel_type AS type FROM edges WHERE src_id IN (SELECT id FROM f) OR dst_id IN (SELECT id FROM f)",
    **{f"call_chain_d{d}": _chain_sql(d) for d in (1, 2, 3, 4)},
    "upstream_callers": _chain_sql(4, upstream=True),
    "subgraph_1hop": _subgraph_sql(1),
    "subgraph_2hop": _subgraph_sql(2),
    "impact": _IMPACT_SQL,
    **{f"impact_{n}": _impact_part_sql(n) for n in ("callers", "callees", "exceptions", "configs")},
    "preset_no_docstring": f"WITH {SQL} SELECT id, name, file FROM nodes WHERE label IN ('Function', 'Class') AND (docstring IS NULL OR docstring = '') ORDER BY id LIMIT 10",
    "preset_high_method_count": f"WITH {SQL} SELECT n.id, n.name, count(e.dst_id) AS methods FROM nodes n LEFT JOIN edges e ON e.src_id = n.id AND e.rel_type = 'HAS_METHOD' WHERE n.label = 'Class' GROUP BY n.id, n.name ORDER BY methods DESC, n.id LIMIT 10",
    "preset_unused_function": f"WITH {SQL} SELECT id, name, file FROM nodes WHERE label = 'Function' AND id NOT IN (SELECT dst_id FROM calls) ORDER BY id LIMIT 10",
    "preset_high_coupling": f"WITH {SQL} SELECT id, label, count(*) AS degree FROM ({_DEGREE}) WHERE label IN ('Function', 'Class') GROUP BY id, label ORDER BY degree DESC, id LIMIT 10",
    "preset_no_test_coverage": f"WITH {SQL} SELECT id, name, file FROM nodes n WHERE label = 'Function' AND NOT contains(lower(file), 'test') AND id NOT IN (SELECT dst_id FROM calls JOIN nodes t ON t.id = src_id WHERE contains(lower(t.file), 'test')) ORDER BY id LIMIT 10",
    "ui_call_graph": f"WITH {SQL} " + _SCAN.format("CALLS"),
    "ui_class_methods": f"WITH {SQL} " + _SCAN.format("HAS_METHOD"),
    "ui_module_contents": f"WITH {SQL} " + _SCAN.format("CONTAINS"),
    "ui_hubs": f"WITH {SQL} SELECT id, label, count(*) AS degree FROM ({_ONCE}) GROUP BY id, label ORDER BY degree DESC, id LIMIT 15",
    "ui_whole_graph": f"WITH {SQL}, b AS (SELECT src_id AS id, rel_type, dst_id AS other FROM edges UNION SELECT dst_id, rel_type, src_id FROM edges) SELECT n.label, n.id, b.rel_type, b.other FROM nodes n LEFT JOIN b USING (id) ORDER BY n.id, n.label, b.rel_type NULLS FIRST, b.other NULLS FIRST LIMIT 200",
    "fuzzy_resolve_edges": f"WITH {_RAW_SQL} {_RESOLVED_SQL}",
    "dangling_edges": f"WITH {_RAW_SQL} SELECT source, target FROM clean WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE {_NAMES.format('source')}) OR NOT EXISTS (SELECT 1 FROM nodes n WHERE {_NAMES.format('t')})",
    "vector_topk_function": f"WITH {_VECTORS} " + _top_sql("Function"),
    "vector_topk_class": f"WITH {_VECTORS} " + _top_sql("Class"),
    "vector_topk_repo": f"WITH {_VECTORS} " + _top_sql("Function", where="repo = 'repo1'"),
    "vector_topk_overfetch_compat": f"WITH {_VECTORS}, pool AS (SELECT * FROM v WHERE kind = 'Function' ORDER BY s DESC, 'v/' || vec_id LIMIT 15), own AS (SELECT * FROM pool WHERE repo = 'repo1' UNION ALL SELECT * FROM pool WHERE NOT EXISTS (SELECT 1 FROM pool WHERE repo = 'repo1')) " + _top_sql("Function", "own"),
    "hybrid_retrieve_edges": _HYBRID_SQL,
    "embedding_text": f"WITH {SQL} SELECT id, '[' || label || '] ' || name || chr(10) || 'File: ' || file || CASE WHEN coalesce(docstring, '') <> '' THEN chr(10) || 'Docstring: ' || docstring ELSE '' END AS text FROM nodes WHERE label IN ('Function', 'Class')",
    "file_diff": "SELECT 'p/' || p_partkey AS file, CASE WHEN p_partkey % 11 = 0 THEN 'deleted' WHEN p_partkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM part UNION ALL SELECT 's/' || s_suppkey, 'added' FROM supplier",
    "delete_file_survivors": f"WITH {SQL} SELECT label, id FROM nodes WHERE file IS NULL OR file NOT IN (SELECT 'p/' || p_partkey FROM part WHERE p_partkey % 11 = 0)",
    "stale_edges": f"WITH {SQL}, {_BUSY.format('dst_id')} SELECT src_id AS source, dst_id AS target FROM calls WHERE dst_id = (SELECT id FROM busy) AND src_id <> dst_id",
    "chat_list_with_repo": "SELECT CAST(conv_id AS VARCHAR) AS chat_id, 'repo' || (conv_id % 30) AS repo_id, n_name AS repo_name FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN nation ON conv_id % 30 = n_nationkey",
    "message_count": "SELECT CAST(conv_id AS VARCHAR) AS chat_id, count(*) AS message_count FROM conversations GROUP BY conv_id",
    "auto_title": r"""WITH f AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
        g AS (SELECT conv_id, regexp_replace(array_to_string(string_split(t, ' ')[1:5], ' '), '[?.!,;:]+$', '') AS title FROM f)
        SELECT CAST(conv_id AS VARCHAR) AS chat_id, CASE WHEN title = '' THEN 'New Chat' ELSE title END AS title FROM g""",
    "find_repo_by_source": "SELECT 'repo' || n_nationkey AS repo_id, n_name AS name FROM nation WHERE n_name = 'NATION_3'",
    "delete_repo_survivors": "SELECT CAST(conv_id AS VARCHAR) AS chat_id, count(*) AS n FROM conversations WHERE conv_id % 30 <> 3 GROUP BY conv_id",
    "tracker_latest_stage": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS repo_id, list_extract(['cloning', 'parsing', 'building_graph', 'embedding', 'ready'], list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)) AS stage, CAST(greatest(0, least(100, floor(value))) AS INT) AS percent, ts, event_id FROM events)
        SELECT repo_id, stage, percent FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, stage ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE stage IS NOT NULL) WHERE r = 1""",
    "dot_color": "SELECT CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'amber' ELSE 'grey' END AS color, count(*) AS n FROM orders GROUP BY 1",
    "token_jaccard": f"WITH {_ANSWERS} SELECT doc_id, round(overlap, 6) AS overlap FROM o",
    "entity_recall_precision_f1": f"WITH {_ANSWERS} SELECT doc_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM s",
    "eval_summary_avg": f"WITH {_ANSWERS} SELECT CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'agent' END AS mode, round(avg(round_even(recall, 3)), 3) AS avg_recall, round(avg(round_even(precision, 3)), 3) AS avg_precision, round(avg(round_even(f1, 3)), 3) AS avg_f1, round(avg(round_even(overlap, 3)), 3) AS avg_fact_overlap, round(avg(len(answer) / 1000), 2) AS avg_latency FROM s GROUP BY 1",
    "repo_isolation_stats": f"WITH {REPOSITORIES_SQL} SELECT repo_id, count(*) AS node_count, (SELECT count(*) FROM calls c WHERE c.repo_id = fn.repo_id AND c.dst_repo = fn.repo_id) AS edge_count, count(DISTINCT p_partkey) AS file_count FROM fn GROUP BY repo_id",
    "repo_isolation_subgraph": f"""WITH {REPOSITORIES_SQL}, own AS (SELECT * FROM calls WHERE repo_id = 'repo1'), busy AS (SELECT src_id AS id FROM own GROUP BY src_id ORDER BY count(*) DESC, src_id LIMIT 1)
        SELECT src_id AS source_id, 'Function' AS source_type, a.p_name AS source_name, 'CALLS' AS rel_type, dst_id AS target_id, 'Function' AS target_type, b.p_name AS target_name
        FROM own JOIN fn a ON a.fid = src_id JOIN fn b ON b.fid = dst_id WHERE b.repo_id = 'repo1' AND (src_id = (SELECT id FROM busy) OR dst_id = (SELECT id FROM busy))""",
    "repo_isolation_resolve": f"WITH {REPOSITORIES_SQL} SELECT DISTINCT c.repo_id, c.src_id, m.fid AS dst_id FROM calls c JOIN fn d ON d.fid = c.dst_id JOIN fn m ON m.repo_id = c.repo_id AND m.p_name = d.p_name",
    "chat_get": "SELECT '3' AS chat_id, 'repo1' AS repo_id, n_name AS repo_name FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id = 3) LEFT JOIN nation ON n_nationkey = 1",
    "find_node": _FIND_SQL,
    **generated.ORACLE_SQL,
    **tracked.ORACLE_SQL,
    "call_chain_all_d2": _chain_sql(2),
    "call_chain_counts": f"""WITH {SQL}, two AS (
            SELECT a.src_id AS id, a.src_id AS x, a.dst_id AS y, b.dst_id AS z FROM calls a JOIN calls b ON b.src_id = a.dst_id WHERE NOT (a.src_id = b.src_id AND a.dst_id = b.dst_id)
        ), three AS (
            SELECT id, count(*) AS n FROM two JOIN calls c ON c.src_id = z WHERE NOT (c.src_id = x AND c.dst_id = y) AND NOT (c.src_id = y AND c.dst_id = z) GROUP BY id
        ) SELECT id, n AS depth_1, coalesce(t.n2, 0) AS depth_2, coalesce(h.n3, 0) AS depth_3, n + coalesce(t.n2, 0) + coalesce(h.n3, 0) AS within
        FROM (SELECT src_id AS id, count(*) AS n FROM calls GROUP BY src_id) LEFT JOIN (SELECT id, count(*) AS n2 FROM two GROUP BY id) t USING (id) LEFT JOIN (SELECT id, n AS n3 FROM three) h USING (id)""",
    "batch_seeds": f"WITH {SQL}, {_BATCH_SEEDS} SELECT query_id, label, rank, id, round(s, 6) AS score FROM near",
    "batch_retrieve_edges": f"WITH {SQL}, {_BATCH_SEEDS} SELECT query_id, src_label, src_id, rel_type, dst_label, dst_id FROM edges JOIN near ON src_label = label AND src_id = id UNION SELECT query_id, src_label, src_id, rel_type, dst_label, dst_id FROM edges JOIN near ON dst_label = label AND dst_id = id",
    "knn_embeddings": """SELECT query_id, rank, id, round(s, 6) AS score FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS rank
            FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "vector_index_topk": "SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) DESC, vec_id LIMIT 10",
    **resolution.oracle_sql(_RAW_SQL, _RESOLVED_SQL),
}

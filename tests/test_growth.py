"""Work that has to be spread over tasks, or done once, whatever the size."""

import time

import pandas as pd
from pyspark.sql import functions as F

from codeweft import runtime
from codeweft.operators import incremental, inspect, resolve, traverse
from codeweft.plans import generated, projection, queries
from codeweft.runtime import settled
from codeweft.schema import Graph
from codeweft.streaming import tracker as stream

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_generated_files_are_parsed_once_in_many_tasks(spark, monkeypatch):
    """A table of one row group is no single task of the parsers, and what reads
    the parsed files several times doesn't parse them again."""
    monkeypatch.setattr(generated, "PARTS", 50)
    parts = spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert generated.files(spark, SMALL).rdd.getNumPartitions() == parts // 50 + 1
    for query in generated.QUERIES.values():
        assert "MapIn" not in plan(query(spark, SMALL))


def test_links_of_a_shared_name_are_listed_once(spark):
    """Callers times nodes of a name are listed by a join; no aggregate and no
    shuffle follows it. Overlapping names give each edge once."""
    nodes = spark.createDataFrame([("r", "Function", f"f{k}::A::run", "run") for k in range(40)], "repo_id string, label string, id string, name string")
    raw = [("r", f"f{k}::A::run", target, kind, "f") for k in range(40) for target in ("run", "A::run", f"f{k}::A::run", "ts_call::run") for kind in ("CALLS", None)]
    raw = spark.createDataFrame(raw, "repo_id string, source string, target string, type string, file string")
    for most in (None, 10):
        edges = resolve.resolve_edges(nodes, raw, most=most)
        assert "Union" in plan(edges).splitlines()[1]
        assert edges.count() == edges.distinct().count() == 2 * 40 * 40
    kept = incremental.resolve_all(nodes, raw)
    assert kept.links.count() == 2 * 40 * 81 and kept.edges.count() == 2 * 40 * 40


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What was shuffled for a step is gone before the next one begins."""
    shuffled = lambda: {x for x in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks().getAllFiles())) if x.startswith("shuffle_")}
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    numbers = spark.range(1000).select((F.col("id") % 10).alias("k")).groupBy("k").count()
    before = shuffled()
    assert len(numbers.collect()) == 10 and shuffled() - before  # a result's own are let go later
    before = shuffled()
    settled(numbers.select("k"))
    time.sleep(0.2)  # and no garbage collection was needed for it
    assert shuffled() <= before


def test_writes_beside_each_other_put_the_setting_back(spark):
    before = spark.conf.get(runtime._CLEANUP)
    one, two = runtime._passing_shuffles(spark), runtime._passing_shuffles(spark)
    one.__enter__(), two.__enter__(), one.__exit__(None, None, None)
    assert spark.conf.get(runtime._CLEANUP) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(runtime._CLEANUP) == before


def listed(spark, name):
    """The plan of what is left to do: one join, of written tables."""
    text = plan(queries.QUERIES[name](spark, SMALL))
    return "lineitem.parquet" not in text and text.count("Join ") == 1 and "Aggregate" not in text


def test_only_links_are_left_to_list_by_fuzzy_resolve_edges(spark):
    assert listed(spark, "fuzzy_resolve_edges")


def test_only_links_are_left_to_list_by_repo_isolation_resolve(spark):
    assert listed(spark, "repo_isolation_resolve")


def test_only_links_are_left_to_list_by_resolve_after_change(spark):
    assert listed(spark, "resolve_after_change")


def test_parts_follow_the_graph(spark, monkeypatch):
    """What is as large as the edges is put together in parts of bounded size."""
    monkeypatch.setattr(projection, "TASK_ROWS", 500)
    parts = spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 500 + 1
    assert parts > spark.sparkContext.defaultParallelism and projection.parts(spark, SMALL) == parts
    for name in ("edge_count_by_type", "repo_stats", "ui_whole_graph", "ui_call_graph", "dangling_edges"):
        assert f", {parts}), REPARTITION_BY_NUM" in plan(queries.QUERIES[name](spark, SMALL))


def test_edges_are_made_once_and_in_few_shuffles(spark):
    """Both ends of an edge come from one pass over the edges, the first nodes are
    taken before edges are put together, and what is made distinct isn't shuffled
    again to be spelled out."""
    scans = lambda name: plan(queries.QUERIES[name](spark, SMALL)).count("lineitem.parquet")
    assert {scans(name) for name in ("edge_count_by_type", "ui_hubs", "preset_high_coupling", "graph_preview_nodes", "ui_whole_graph")} == {3}
    for name in ("graph_preview_nodes", "ui_whole_graph"):
        assert "LeftSemi, BuildRight" in plan(queries.QUERIES[name](spark, SMALL))
    lines = plan(projection.edges(spark, SMALL))
    assert lines.count("Exchange hashpartitioning") <= 16 and "ShuffledHashJoin" in lines


def test_a_target_of_many_edges_makes_no_long_task(spark, monkeypatch):
    """Edges are counted before they are dealt by target, a hub's meet its name where
    they are, and the first rows are taken before nodes are joined to them."""
    monkeypatch.setattr(traverse, "HUB", 20, raising=False)
    ends = [*[(f"f{k}", "E0") for k in range(50)], ("f0", "E0"), ("f0", "E1"), ("lost", "E0"), ("f0", "Elost")]
    edges = spark.createDataFrame(ends, "src_id string, dst_id string").select(F.lit("r").alias("repo_id"), F.lit("Function").alias("src_label"), "src_id", F.lit("RAISES").alias("rel_type"), F.lit("Exception").alias("dst_label"), "dst_id")
    nodes = [("r", "Function", f"f{k}", f"f{k}", "a") for k in range(50)] + [("r", "Exception", f"E{k}", f"E{k}", None) for k in range(2)]
    g = Graph(spark.createDataFrame(nodes, "repo_id string, label string, id string, name string, file string"), settled(edges), 7)
    named = traverse.with_names(g, edges.distinct())
    assert "Union" in plan(named) and "LeftAnti, BuildRight" in plan(named)
    assert sorted((r.source_name, r.target_name) for r in named.collect()) == sorted([(f"f{k}", "E0") for k in range(50)] + [("f0", "E1")])
    stats = inspect.repo_stats(g, "r")
    assert "hashpartitioning(dst_label" not in "".join(x for x in plan(stats).splitlines() if "REPARTITION_BY_NUM" in x)
    assert stats.collect() == [(52, 51, 1)] and inspect.repo_stats(g, "none").collect() == [(0, 0, 0)]
    assert plan(queries.QUERIES["ui_whole_graph"](spark, SMALL)).count("TakeOrderedAndProject") == 2


def test_chains_read_calls_that_are_written_once(spark):
    for name in ("call_chain_d2", "call_chain_all_d2", "upstream_callers"):
        assert "lineitem.parquet" not in plan(queries.QUERIES[name](spark, SMALL))


def test_chain_counts_send_no_table_through_the_driver(spark):
    g = projection.graph(spark, SMALL)
    assert "BroadcastHashJoin" not in plan(traverse.chain_counts(Graph(g.nodes, settled(g.edges))))


def test_a_batch_asks_the_state_store_once_for_each_repository():
    class Store:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def getValueState(self, *_):  # noqa: N802  the handle's own name
            return self

    store, tracker = Store(), stream.Tracker()
    tracker.init(store)
    columns = ["repo_id", "slot", "seq", "op", "percent", "detail", "error", "at"]
    batch = lambda *seqs: iter([pd.DataFrame([("r", slot, s, "start", 0, None, None, None) for s in seqs for slot in ("began", "start", "stage:ready")], columns=columns)])
    seen = lambda out: {r.slot: r.seq for part in out for r in part.itertuples()}
    assert seen(tracker.handleInputRows(("r",), batch(5, 7), None)) == {"began": 5, "start": 7, "stage:ready": 7}
    assert seen(tracker.handleInputRows(("r",), batch(3, 6), None)) == {"began": 3, "start": 7, "stage:ready": 7}
    assert seen(tracker.handleInputRows(("r",), batch(6), None)) == {}
    assert store.calls == 5

"""Smaller parts of the surface: sources, tools, retrieval, scores, logs, the
command line and the stream."""

import json
import re
from pathlib import Path

import pytest

from codeweft.__main__ import main
from codeweft.functions import metrics
from codeweft.operators import inspect, resolve, vector
from codeweft.plans import agent, evaluate, ingest, tools
from codeweft.schema import NODES, Graph, problems
from codeweft.sources import files
from codeweft.streaming import tracker as stream
from tests.test_parse import FILES, write


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root)
    nodes, raw, graph = ingest.ingest(spark, str(root), "r", vector.HashingEmbedder(16))
    return root, raw, Graph(nodes.cache(), graph.edges.cache())


def test_sources(spark, built, tmp_path):
    assert files.repo_name("https://host/owner/digit.git/") == "owner_digit" and files.repo_name("git@host:o/n.git") == "o_n"
    assert files.resolve_repo(str(tmp_path)) == tmp_path and files.is_url("git@x") and not files.is_url("/x")
    with pytest.raises(NotADirectoryError):
        files.resolve_repo(str(tmp_path / "none"))
    there = tmp_path / "repos" / "o_n"
    there.mkdir(parents=True)
    assert files.resolve_repo("https://h/o/n.git", str(tmp_path / "repos")) == there  # cloned before
    listed = files.read_files(spark, str(built[0]), "r")
    got = files.file_content(listed, "r", "app/errors.py")
    assert got == {"content": FILES["app/errors.py"], "file_path": "app/errors.py", "lines": 2}
    assert "error" in files.file_content(listed, "r", "../x") and "error" in files.file_content(listed, "other", "app/errors.py")


def test_summary_and_schema(spark, built):
    _, _, graph = built
    assert {r.label: r.cnt for r in ingest.summary(graph.nodes, "label").collect()}["Module"] == len(FILES) - 1
    assert problems(graph.nodes).count() == 0
    odd = spark.createDataFrame([("r", "Gadget", "g", *[None] * 7), ("r", "Class", "c", *[None] * 7), ("r", "Class", "c", *[None] * 7)], NODES)
    assert {(r.label, r.n) for r in problems(odd).collect()} == {("Gadget", 1), ("Class", 2)}


def test_lenient(spark):
    node = lambda repo, i: (repo, "Function", i, i, "f", *[None] * 5)
    nodes = spark.createDataFrame([node("a", "x"), node("b", "y"), node(None, "z")], NODES)
    raw = spark.createDataFrame([("a", "x", "z", "CALLS"), ("a", "x", "y", "CALLS"), ("", "x", "y", "CALLS"), ("b", "y", "z", "CALLS")], "repo_id string, source string, target string, type string")
    pairs = lambda lenient: {(r.repo_id, r.src_id, r.dst_id) for r in resolve.resolve_edges(nodes, raw, lenient).collect()}
    assert pairs(False) == set() and pairs(True) == {("a", "x", "z"), ("b", "y", "z"), ("", "x", "y")}
    g = Graph(nodes, resolve.resolve_edges(nodes, raw, True))
    assert g.within("a").nodes.count() == 1 and g.within("a", lenient=True).nodes.count() == 2 and g.within("", lenient=True).nodes.count() == 3


def test_preview_highlights(built):
    rows = {r.id: r.highlighted for r in inspect.preview_nodes(built[2], 60, ["save", "app/store.py::Store"]).collect()}
    assert {i for i, h in rows.items() if h} == {"app/store.py::save", "app/store.py::Store"}


def test_retrieval(spark, built):
    _, _, graph = built
    embedder = vector.HashingEmbedder(16)
    assert embedder.dim == 16 and embedder.embed([""]) == [[0.0] * 16]
    query = embedder.embed(["Keeps rows"])[0]
    plain, scaled = (vector.vector_top_k(graph.nodes, query, "Class", 3, score_norm=n).collect() for n in (False, True))
    assert [r.id for r in plain] == [r.id for r in scaled] and all(s.score == pytest.approx((p.score + 1) / 2) for p, s in zip(plain, scaled))
    got = vector.retrieve(graph, "who saves rows?", embedder, 3, 2, "r")
    assert 1 <= len(got.seeds) <= 6 and not got.truncated and got.context.startswith("## Entities") and set(got.metrics) == {"embed_ms", "vector_search_ms", "graph_traversal_ms", "total_retrieval_ms"}
    relations = got.context.split("## Relations\n")[1].split("\n")
    assert len(relations) == len(set(relations)) > 0 and re.fullmatch(r"- \S+ -[A-Z_]+-> \S+ \(.+\)", relations[0])
    assert vector.retrieve(graph, "x", embedder, repo_id="none").context == vector.NO_SEEDS
    long = {"label": "Function", "name": "f", "file": "a", "score": 0.5, "docstring": "Says.", "source_code": "s" * 400}
    assert "  Says.\n  " + "s" * 300 + "..." in vector.render_context([long], [])


def test_tools_and_log(built, tmp_path):
    _, _, graph = built
    box = tools.Toolbox(graph, embedder=vector.HashingEmbedder(16), generate=lambda p: p)
    found = box.graph_rag_search({"query": "save rows", "repo_id": "r"})
    assert found["seeds"] and "context" in found and box.graph_rag_search({}) == {"error": "query is needed"}
    assert "Issue: leak" in box.suggest_fix({"issue": "leak"})["suggestion"] and "error" in tools.Toolbox(graph).suggest_fix({})
    assert re.fullmatch(r"20240101-000000-[0-9a-f]{6}", agent.run_id("q", 1704067200))
    replies = iter(['{"tool": "list_by_pattern", "args": {"pattern": "no_docstring"}}', '{"complete": true, "answer": "There are several functions without any docstring in the tree."}'])
    agent.run_agent("Which lack docstrings?", box, lambda p: next(replies), "r", str(tmp_path))
    written = {p.name: json.loads(p.read_text()) for p in Path(tmp_path).glob("*/*.json")}
    assert set(written) == {"0_execute.json", "0_judge.json", "final.json"} and written["final.json"]["seconds"] >= 0


def test_scores(spark):
    rows = spark.createDataFrame([("1", "a", "svc.run calls café", "svc.run calls", ["svc.run", "svc.stop", "svc.x"], 1.234), ("1", "b", "nothing", "svc.run calls", ["svc.run", "svc.stop", "svc.x"], 2.0)], "id string, mode string, answer string, ground_truth string, expected_entities array<string>, latency double")
    scored = metrics.evaluate(rows)
    a = scored.where("mode = 'a'").first()
    assert (a.recall, a.precision, a.f1, a.fact_overlap) == (0.333, 1.0, 0.5, 1.0)  # a word with an accent is no token
    means = {r["mode"]: r for r in metrics.summary(scored).collect()}
    assert (means["a"].avg_latency, means["b"].avg_recall) == (1.23, 0.0)
    delta = metrics.answer_delta(scored, "b", "a").first()
    assert (delta.delta_recall, delta.delta_fact_overlap) == (0.333, 1.0)
    assert metrics.entity_recall(rows).where("mode = 'a'").first().recall == 0.333
    assert metrics.overlap_judge(rows).where("mode = 'a'").select("correctness", "faithfulness").first() == (1.0, 1.0)
    assert evaluate.scored(rows.select("id", "ground_truth", "expected_entities").distinct(), rows.select("id", "mode", "answer", "latency")).count() == 2


def test_command_line(spark, built, tmp_path, capsys):
    for _ in range(2):  # the second run builds anew
        counts = main([str(built[0]), "--data", str(tmp_path)])
    assert counts["nodes"]["Module"] == len(FILES) - 1 and counts["edges"]["HAS_METHOD"] == 2
    assert "nodes: " in capsys.readouterr().out


def test_stream(spark, tmp_path):
    schema = "repo_id string, seq bigint, stage string, percent int"
    folder = str(tmp_path / "events")
    batch = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
    batch([("a", 1, "parsing", 10), ("a", 3, "parsing", 60), ("b", 1, "cloning", 5)])
    events = spark.readStream.schema(schema).json(folder)
    state = lambda: {(r.repo_id, r.stage): r.percent for r in spark.table("progress").collect()}
    stream.start(events, "progress", str(tmp_path / "checkpoint")).awaitTermination(60)
    assert state() == {("a", "parsing"): 60, ("b", "cloning"): 5}
    batch([("a", 2, "parsing", 99), ("a", 4, "embedding", 1)])  # an older event changes nothing
    stream.start(events, "progress", str(tmp_path / "checkpoint")).awaitTermination(60)
    assert state() == {("a", "parsing"): 60, ("b", "cloning"): 5, ("a", "embedding"): 1}

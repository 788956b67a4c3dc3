import itertools
import random

import pytest

from codeweft.operators import inspect, resolve, traverse, vector
from codeweft.plans.agent import extract_json, run_agent
from codeweft.plans.tools import Toolbox, guarded, unfenced
from codeweft.plans.tracker import fold
from codeweft.schema import NODES, Graph


def make(spark, names, calls):
    nodes = spark.createDataFrame([("r", "Function", f"f::{n}", n, "f", 1, None, None, [1.0, float(i)], None) for i, n in enumerate(names)], NODES)
    edges = spark.createDataFrame([("r", "Function", f"f::{a}", "CALLS", "Function", f"f::{b}") for a, b in sorted(set(calls))], "repo_id string, src_label string, src_id string, rel_type string, dst_label string, dst_id string")
    return Graph(nodes, edges)


def trails(calls, start, depth):
    out, todo = [], [([start], frozenset())]
    for _ in range(depth):
        todo = [(path + [b], used | {(a, b)}) for path, used in todo for a, b in calls if a == path[-1] and (a, b) not in used]
        out += [tuple(p) for p, _ in todo]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals_against_enumeration(spark, seed):
    rnd = random.Random(seed)
    names = list("abcdef")
    calls = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(9)})
    g = make(spark, names, calls)
    start = g.nodes.where("name = 'a'")
    got = sorted(tuple(r.call_chain) for r in traverse.call_chains(g, start, 3).collect())
    assert got == trails(calls, "a", 3)
    up = sorted(tuple(r.call_chain) for r in traverse.call_chains(g, start, 3, upstream=True).collect())
    assert up == sorted(tuple(reversed(t)) for t in trails([(b, a) for a, b in calls], "a", 3))
    near = {"a"}
    for _ in range(1):
        near |= {y for x, y in calls if x in near} | {x for x, y in calls if y in near}
    assert {(r.source_name, r.target_name) for r in traverse.subgraph(g, start, 2).collect()} == {e for e in calls if e[0] in near or e[1] in near}
    reach, at = set(), {"a"}
    for _ in range(3):
        at = {x for x, y in calls if y in at}
        reach |= at
    assert set(traverse.impact(g, start).first().callers) == {f"f::{n}" for n in reach}


def test_depth_is_checked(spark):
    for bad in (0, -1, 11, "3"):
        with pytest.raises(ValueError):
            traverse.check_depth(bad)


def test_resolution_matches_the_or_predicate(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("ab:") for _ in range(rnd.randint(1, 6)))
    nodes = [("r", "Function", f"{word()}::{word()}", word()) for _ in range(30)]
    raws = [("r", word(), rnd.choice(["", "ts_call::"]) + word(), "CALLS", "f") for _ in range(60)]
    n = spark.createDataFrame(nodes, "repo_id string, label string, id string, name string")
    raw = spark.createDataFrame(raws, "repo_id string, source string, target string, type string, file string")
    match = lambda x, row: row[2] == x or row[3] == x or row[2].endswith("::" + x)
    want = {(a[2], b[2]) for r in raws for a, b in itertools.product(nodes, nodes) if match(r[1], a) and match(r[2].replace("ts_call::", ""), b)}
    assert {(r.src_id, r.dst_id) for r in resolve.resolve_edges(n, raw).collect()} == want


def test_lookup_tiers(spark):
    g = make(spark, ["save", "save_all", "x"], [])
    assert traverse.find_node(g.nodes, "save").first().id == "f::save"
    assert traverse.find_node(g.nodes, "f.x").first().id == "f::x"
    assert traverse.find_node(g.nodes, "nothing").count() == 0


def test_presets_and_vectors(spark):
    g = make(spark, list("abc"), [("a", "b"), ("b", "b")])
    assert [r.name for r in inspect.unused_function(g).collect()] == ["a", "c"]
    assert {r.id: r.degree for r in inspect.high_coupling(g).collect()} == {"f::a": 1, "f::b": 3}
    assert {r.id: r.degree for r in inspect.hubs(g).collect()} == {"f::a": 1, "f::b": 2}
    assert [r.id for r in vector.vector_top_k(g.nodes, [1.0, 0.0], "Function", 2).collect()] == ["f::a", "f::b"]
    assert vector.vector_top_k(g.nodes, [0.0, 0.0], "Function", 9).count() == 3
    assert vector.HashingEmbedder(4).embed([""]) == [[0.0] * 4]


def test_tools_and_agent(spark):
    g = make(spark, list("abc"), [("a", "b"), ("b", "c")])
    replies = iter(["DROP TABLE nodes", "```sql\nSELECT name FROM nodes WHERE name = 'a'\n```"])
    tools = Toolbox(g, generate=lambda prompt: next(replies))
    assert tools.run_query({"intent": "x", "repo_id": "r"})["rows"] == [{"name": "a"}]
    bad = ["DELETE FROM nodes", "SELECT 1; DROP TABLE x", "SELECT * FROM parquet.`/etc`", "SELECT * FROM secrets", "SELECT * FROM nodes WHERE id IN (SELECT id FROM default.secrets)"]
    bad += ["WITH x AS (SELECT * FROM secrets) SELECT * FROM x", "SELECT * FROM secrets WHERE 1 IN (WITH secrets AS (SELECT 1 AS a) SELECT a FROM secrets)", "SELECT java_method('java.lang.System', 'exit', 1)", "SET x = 1", "CACHE TABLE nodes", "SELECT * FROM read_files('/etc')", "INSERT INTO nodes SELECT * FROM nodes"]
    for sql in bad:
        with pytest.raises(ValueError):
            guarded(spark, sql)
    for sql in ("SELECT replace(name, 'a', 'b') AS deleted FROM nodes;", "WITH x AS (SELECT src_id FROM edges), y AS (SELECT * FROM x) SELECT count(*) FROM y JOIN nodes ON src_id = id WHERE name <> '; drop table x'", "SELECT * FROM nodes n WHERE EXISTS (SELECT 1 FROM edges WHERE src_id = n.id) UNION SELECT * FROM nodes ORDER BY 1 LIMIT 3"):
        assert guarded(spark, sql)
    others = Toolbox(make(spark, list("xyz"), []), generate=lambda prompt: "SELECT count(*) AS n FROM nodes")
    assert others.run_query({"intent": "x"}) == {"sql": "SELECT count(*) AS n FROM nodes", "rows": [{"n": 3}], "truncated": False}
    assert not spark.catalog.tableExists("nodes")
    found = tools.trace_impact({"node_id": "c", "repo_id": "r"})
    assert len(found["callers"]) == 2 and not found["callees"] and not found["truncated"]
    assert unfenced("a ```sql\nSELECT 1\n``` b") == "SELECT 1"
    assert tools.get_call_chain({"node_id": "a", "direction": "sideways"})["error"]
    assert tools.trace_impact({"node_id": "zzz"})["error"]
    assert tools.list_by_pattern({"pattern": "unused_function"})["results"][0]["name"] == "a"
    script = iter(['{"tool": "nope", "args": {}}', '{"complete": false}', '{"tool": "trace_impact", "args": {"node_id": "c"}}', '{"complete": true, "answer": "a and b call c, directly or through others."}'])
    got = run_agent("who calls c?", tools, lambda prompt: next(script), "r")
    assert [t["tool"] for t in got.trace] == ["nope", "trace_impact"] and not got.is_partial and "c" in got.highlighted_nodes
    assert extract_json('so {"a": {"b": 1}} and') == {"a": {"b": 1}} and extract_json("none") == {}
    endless = run_agent("?", tools, lambda prompt: "{}", "r")
    assert endless.is_partial and len(endless.trace) == 3


def test_tracker(spark):
    schema = "repo_id string, seq long, op string, stage string, percent int, detail string, error string, at timestamp"
    log = [("x", 1, "init", None), ("x", 2, "start", None), ("x", 3, "update", "parsing"), ("x", 4, "complete", "cloning"), ("x", 5, "update", "nonsense"), ("x", 6, "fail", None), ("y", 1, "start", None), ("y", 2, "finish", None), ("z", 1, "update", "parsing")]
    events = spark.createDataFrame([(r, s, o, g, 250, None, "boom" if o == "fail" else None, None) for r, s, o, g in log], schema)
    state = {r.repo_id: r for r in fold(events).collect()}
    assert set(state) == {"x", "y"} and state["x"].status == "error" and state["x"].error == "boom"
    assert [(s.status, s.percent) for s in state["x"].stages][:3] == [("done", 100), ("error", 100), ("pending", 0)]
    assert state["y"].status == "ready" and {s.status for s in state["y"].stages} == {"done"}


def test_paths_are_bounded(spark):
    """A dense graph: the guard says that there are too many paths."""
    names = list("abcdef")
    g = make(spark, names, [(x, y) for x in names for y in names if x != y])
    target = traverse.find_node(g.nodes, "a")
    assert traverse.call_chains(g, target, 2, max_paths=30).count() == 5 + 25
    with pytest.raises(ValueError, match="more than 30 paths of 3 calls"):
        traverse.call_chains(g, target, 3, max_paths=30)
    assert traverse.subgraph(g, target, 4).count() == 30

"""Stored edges: hops against plain traversal, plans, many questions, nearest
vectors."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.operators import adjacency, knn, traverse
from codeweft.operators.vector import HashingEmbedder
from codeweft.plans import questions
from codeweft.schema import NODES, Graph

r = random.Random(9)


@pytest.fixture(scope="module")
def g(spark):
    names = [f"n{k}" for k in range(60)]
    kinds = ["Function"] * 45 + ["Class"] * 10 + ["Exception"] * 3 + ["Config"] * 2
    ids = dict(zip(names, kinds))
    edges = {(r.choice(names[:45]), "CALLS", r.choice(names[:45])) for _ in range(70)} | {("n0", "CALLS", n) for n in names[:45:3]} | {("n0", "CALLS", "n0")}
    edges |= {(r.choice(names[:45]), "RAISES", f"n{55 + r.randrange(3)}") for _ in range(9)} | {(r.choice(names[:45]), "READS", f"n{58 + r.randrange(2)}") for _ in range(9)} | {(f"n{45 + r.randrange(10)}", "HAS_METHOD", r.choice(names[:45])) for _ in range(15)}
    embedder = HashingEmbedder(8)
    nodes = spark.createDataFrame([("r", kind, f"f::{n}", n, "f", None, None, None, embedder.embed([f"{n} {kind}"])[0] if kind in ("Function", "Class") else None, None) for n, kind in ids.items()], NODES)
    table = spark.createDataFrame([("r", ids[a], f"f::{a}", kind, ids[b], f"f::{b}") for a, kind, b in sorted(edges)], "repo_id string, src_label string, src_id string, rel_type string, dst_label string, dst_id string")
    return Graph(nodes.cache(), table.cache())


@pytest.fixture(scope="module")
def held(g):
    return adjacency.store(g.edges, buckets=4, most=6)  # n0 is a hub of several slices


def got(df):
    rows = [tuple(x) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_hops_are_those_of_plain_traversal(g, held):
    assert held.hubs.where("id = 'f::n0'").first().slices > 1
    for name in ("n0", "n7", "n50", "gone"):
        start = g.nodes.where(F.col("name") == name)
        for hops in (1, 3):
            assert got(adjacency.subgraph(held, g, start, hops)) == got(traverse.subgraph(g, start, hops))
        assert got(adjacency.callers(held, start, 3)) == got(traverse.callers(g, start, 3))
    target = g.nodes.where("name = 'n0'")
    assert adjacency.impact(held, target).first() == traverse.impact(g, target).first()
    assert adjacency.impact(held, g.nodes.where("name = 'gone'")).collect() == []


def test_a_hop_scans_once_and_moves_no_stored_edge(spark, held, g):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        step = held.at(g.nodes.where("name = 'n3'"), types=["CALLS"])
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [line for line in plan.splitlines() if held.name in line and "Scan" in line]
    assert len(scans) == 1 and "Bucketed: true" in scans[0] and re.search(r"PartitionFilters: \[[^]]*rel_type", scans[0])
    # From the scan up to the join there is no exchange.
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if line == scans[0])
    depth = lambda line: len(re.match(r"[\s:+\-]*", line).group())
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)


def test_reopened(spark, g, tmp_path):
    adjacency.store(g.edges, str(tmp_path / "kept"), buckets=3).drop()
    again = adjacency.reopen(spark, str(tmp_path / "kept"), 3)
    start = g.nodes.where("name = 'n5'")
    assert got(adjacency.subgraph(again, g, start, 2)) == got(traverse.subgraph(g, start, 2))


def test_many_questions_share_a_frontier(spark, g, held):
    embedder = HashingEmbedder(8)
    asked = spark.createDataFrame([(1, "n3 Function"), (2, "n50 Class"), (3, None), (4, "n3 Function")], "question_id long, text string")
    vectors = questions.embedded(asked, embedder).cache()
    found = questions.seeds(g.nodes, vectors, 2).collect()
    rows = [(x.label, x.id, np.array(x.embedding)) for x in g.nodes.where("embedding IS NOT NULL").collect()]
    for q, text in ((1, "n3 Function"), (2, "n50 Class"), (3, ""), (4, "n3 Function")):
        v = np.array(embedder.embed([text])[0])
        cos = lambda e: 0.0 if not v.any() or not e.any() else round(float(v @ e / np.linalg.norm(v) / np.linalg.norm(e)), 9)
        for label in ("Function", "Class"):
            want = sorted((-cos(e), i) for kind, i, e in rows if kind == label)[:2]
            mine = sorted((x.rank, -round(x.score, 9), x.id) for x in found if (x.query_id, x.label) == (q, label))
            assert [(s, i) for _, s, i in mine] == want
    edges = questions.retrieve_all(g.nodes, held, vectors, 2, 2).collect()
    for q in (1, 2, 3, 4):
        seeds = spark.createDataFrame([(x.label, x.id) for x in found if x.query_id == q], "label string, id string")
        assert {(x.src_id, x.rel_type, x.dst_id) for x in edges if x.query_id == q} == {(x.source_id, x.rel_type, x.target_id) for x in traverse.subgraph(g, seeds, 2).collect()}


def vectors(spark, n, dim=6):
    rows = [(k, [float(np.float32(r.gauss(0, 1))) for _ in range(dim)]) for k in range(n)]
    rows[5] = (5, rows[3][1])  # a tie
    rows[7] = (7, [0.0] * dim)
    return rows, spark.createDataFrame([*rows, (None, rows[0][1]), (n, None)], "id long, vector array<float>")


def ranking(rows, query, k, skip=None):
    cos = lambda a, b: 0.0 if not a.any() or not b.any() else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    every = sorted((-round(cos(np.array(v), np.array(query)), 9), i) for i, v in rows if i != skip)
    return [(i, -s) for s, i in every[:k]]


def test_nearest_of_a_query_set(spark, monkeypatch):
    rows, table = vectors(spark, 130)
    monkeypatch.setattr(knn, "MATRICES", 1)  # several cells of the grid
    monkeypatch.setattr(knn, "QUERIES", 3)
    asked = table.where("id % 10 = 0 OR id IN (3, 7)").selectExpr("id AS query_id", "vector")
    found = knn.nearest(table.repartition(3), asked, 4).collect()
    for q in [k for k, _ in rows if k % 10 == 0 or k in (3, 7)]:
        mine = sorted((x.rank, x.id, round(x.score, 9)) for x in found if x.query_id == q)
        assert [m[1:] for m in mine] == ranking(rows, rows[q][1], 4, skip=q)
    assert knn.nearest(table.where("id < 0"), asked, 4).collect() == [] == knn.nearest(table, asked.where("query_id < 0"), 4).collect()
    assert len(knn.nearest(table.where("id < 3"), asked.where("query_id = 0"), 4).collect()) == 2


def test_index_is_exact_and_reads_a_part(spark):
    rows, table = vectors(spark, 10)
    near = [[10.0 * (k % 8 == j) + r.gauss(0, 0.05) for j in range(8)] for k in range(400)]
    rows = [(k, v) for k, v in enumerate(near)] + [(400, [0.0] * 8)]
    index = knn.build(spark.createDataFrame(rows, "id long, vector array<double>"), cells=8)
    for query in (near[0], near[13], [1.0] * 8, [0.0] * 8):
        found, share = knn.search(index, query, 5)
        assert [(x.id, round(x.score, 9)) for x in found.collect()] == ranking(rows, query, 5)
        assert share < 0.3 if query in (near[0], near[13]) else share <= 1
    empty = knn.build(table.where("id < 0"))
    assert knn.search(empty, [1.0] * 6, 3)[0].collect() == []

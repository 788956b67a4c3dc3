"""Numbers of call chains against the chains themselves."""

import random
from collections import Counter

import pytest

from codeweft.operators import traverse
from codeweft.schema import NODES, Graph


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_are_those_of_the_chains(spark, seed):
    r = random.Random(seed)
    labels = {n: r.choice(("Function", "Function", "Class")) for n in "abcdefg"}
    calls = {(x, y) for x in labels for y in labels if r.random() < 0.35} | {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}
    nodes = spark.createDataFrame([("r", label, n, n, "f", None, None, None, None, None) for n, label in labels.items()], NODES)
    edges = spark.createDataFrame([("r", labels[x], x, "CALLS", labels[y], y) for x, y in sorted(calls)], "repo_id string, src_label string, src_id string, rel_type string, dst_label string, dst_id string")
    g = Graph(nodes.cache(), edges.cache())
    for upstream in (False, True):
        paths = traverse.call_chains(g, g.nodes, 3, upstream=upstream).collect()
        want = Counter((p.node_ids[-1] if upstream else p.node_ids[0], p.depth) for p in paths)
        got = {(x.id, d): x[f"depth_{d}"] for x in traverse.chain_counts(g, upstream=upstream).collect() for d in (1, 2, 3)}
        assert {k: n for k, n in got.items() if n} == dict(want)
    most = max(n for (_, d), n in want.items() if d == 3)
    start = g.nodes.where(f"id = '{next(i for (i, d), n in want.items() if d == 3 and n == most)}'")
    assert traverse.call_chains(g, start, 3, upstream=True, max_paths=most).count() > most
    with pytest.raises(ValueError, match="of 3 calls"):
        traverse.call_chains(g, start, 3, upstream=True, max_paths=most - 1)

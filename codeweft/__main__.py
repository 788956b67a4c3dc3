"""``python -m codeweft SOURCE --data FOLDER``: parse a source tree or a
repository's URL into the engine's tables, in place of what was there before,
and print how many nodes and edges of each kind there are."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from codeweft.plans.engine import Engine
from codeweft.plans.ingest import summary


def main(args: list[str] | None = None) -> dict[str, dict[str, int]]:
    parser = argparse.ArgumentParser(prog="codeweft", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("--data", default="data/codeweft")
    parser.add_argument("--keep", action="store_true", help="keep other repositories' nodes and edges")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName("codeweft").getOrCreate()
    engine = Engine(spark, chosen.data)
    if not chosen.keep:
        engine.clear()
    known = {r.repo_id for r in engine.table("repos").collect()}  # one row for each repository
    repo_id = engine.add_repo(chosen.source)
    if repo_id in known:
        engine.rebuild(repo_id)
    graph = engine.graph(repo_id)
    counts = {"nodes": {r.label: r.cnt for r in summary(graph.nodes, "label").collect()}, "edges": {r.rel_type: r.cnt for r in summary(graph.edges, "rel_type").collect()}}
    for name, rows in counts.items():
        print(f"{name}: {sum(rows.values())}")
        for kind, n in rows.items():
            print(f"  {kind}: {n}")
    return counts


if __name__ == "__main__":
    main()

"""Exact vector search and hybrid retrieval."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.traverse import subgraph
from codeweft.runtime import ship
from codeweft.schema import Graph

EMBEDDABLE = ("Function", "Class")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """A deterministic embedder that needs no model: signed hashes of words.
    An empty text gives the zero vector."""

    dim: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(self.dim)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                vector[h % self.dim] += 1 if h >> 63 else -1
            norm = float(np.linalg.norm(vector))
            out.append((vector / norm if norm else vector).tolist())
        return out


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if either has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def vector_top_k(nodes: DataFrame, query: Sequence[float], label: str, k: int = 5, repo_id: str | None = None, score_norm: bool = False, compat: str | None = None) -> DataFrame:
    """The ``k`` nodes of ``label`` nearest to ``query``, exactly: the filters
    come first, then the scores, then top-k. ``score_norm`` maps the cosine to
    0..1. ``compat="overfetch"`` looks at max(3k, 15) nodes of all repositories
    before the repository filter, and drops that filter if nothing is left."""
    vector = F.array(*[F.lit(float(v)) for v in query])
    rows = nodes.where((F.col("label") == label) & F.col("embedding").isNotNull())
    score = cosine(F.col("embedding"), vector)
    score = (score + 1) / 2 if score_norm else score
    columns = ["id", "name", "file", "line", "docstring", *(["source_code"] if label == "Function" else [])]
    order = [F.desc("score"), F.asc("id")]
    if compat == "overfetch":
        pool = rows.withColumn("score", score).orderBy(*order).limit(max(3 * k, 15))
        own = pool if repo_id is None else pool.where(F.col("repo_id") == repo_id)
        pool = own if repo_id is None or not own.isEmpty() else pool
        return pool.select(*columns, "score").orderBy(*order).limit(k)
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    return rows.select(*columns, score.alias("score")).orderBy(*order).limit(k)


def embedding_text() -> Column:
    """What is embedded of a node; parts that are empty are left out."""
    place = F.concat(F.lit("File: "), F.col("file"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(F.lit("")))
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    return F.concat_ws("\n", F.format_string("[%s] %s", "label", "name"), place, part("Docstring: ", "docstring"), part("Source:\n", "source_code"))


def embed_missing(nodes: DataFrame, embedder: Embedder) -> DataFrame:
    """``nodes`` with a vector for every function and class; those that have
    one keep it."""
    ship(nodes.sparkSession)
    todo = F.col("label").isin(*EMBEDDABLE) & F.col("embedding").isNull()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["embedding"] = embedder.embed(part.pop("text").fillna("").tolist())
            yield part

    fresh = nodes.where(todo).withColumn("text", embedding_text()).drop("embedding")
    made = fresh.mapInPandas(run, schema=", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema if f.name != "text") + ", embedding array<float>")
    return nodes.where(~todo).unionByName(made.select(*nodes.columns))


NO_SEEDS = "No matching code entities were found."


@dataclass
class Retrieved:
    context: str
    seeds: list[dict]
    edges: list[dict] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    truncated: bool = False


#: Edges that a context holds; ``truncated`` says when there are more.
CONTEXT_EDGES = 2000


def seeds(nodes: DataFrame, query: Sequence[float], k: int = 3) -> DataFrame:
    """``label, id`` of the k nearest functions and k nearest classes."""
    found = None
    for label in EMBEDDABLE:
        part = vector_top_k(nodes, query, label, k).select(F.lit(label).alias("label"), "id")
        found = part if found is None else found.unionByName(part)
    return found


def hybrid_edges(graph: Graph, query: Sequence[float], k: int = 3, hops: int = 2, repo_id: str | None = None) -> DataFrame:
    """Edges within ``hops`` of the k nearest functions and k nearest classes."""
    own = graph if repo_id is None else graph.within(repo_id)
    return subgraph(own, seeds(own.nodes, query, k), hops)


def retrieve(graph: Graph, question: str, embedder: Embedder, k: int = 3, hops: int = 2, repo_id: str | None = None) -> Retrieved:
    """Embed the question, find seeds, expand, and render the context. At most
    2k seeds and ``CONTEXT_EDGES`` edges come to the driver."""
    begin = time.perf_counter()
    query = embedder.embed([question])[0]
    embedded = time.perf_counter()
    own = graph if repo_id is None else graph.within(repo_id)
    near = [r.asDict() | {"label": label} for label in EMBEDDABLE for r in vector_top_k(own.nodes, query, label, k).collect()]
    searched = time.perf_counter()
    metrics = {"embed_ms": (embedded - begin) * 1e3, "vector_search_ms": (searched - embedded) * 1e3}
    if not near:
        return Retrieved(NO_SEEDS, [], [], metrics | {"graph_traversal_ms": 0.0, "total_retrieval_ms": (searched - begin) * 1e3})
    spark = graph.nodes.sparkSession
    chosen = spark.createDataFrame([(s["label"], s["id"]) for s in near], "label string, id string")
    found = subgraph(own, chosen, hops).orderBy("source_id", "rel_type", "target_id").limit(CONTEXT_EDGES + 1).collect()
    edges = [r.asDict() for r in found[:CONTEXT_EDGES]]
    done = time.perf_counter()
    metrics |= {"graph_traversal_ms": (done - searched) * 1e3, "total_retrieval_ms": (done - begin) * 1e3}
    return Retrieved(render_context(near, edges), near, edges, metrics, len(found) > CONTEXT_EDGES)


def render_context(seeds: list[dict], edges: list[dict]) -> str:
    lines = ["## Entities"]
    for s in seeds:
        lines.append(f"- {s['label']} {s['name']} ({s['file']}) score {s['score']:.3f}")
        if s.get("docstring"):
            lines.append(f"  {s['docstring']}")
        if s.get("source_code"):
            source = s["source_code"]
            lines.append("  " + (source[:300] + "..." if len(source) > 300 else source))
    rendered = [f"- {e['source_name']} -{e['rel_type']}-> {e['target_name']} ({e['target_id'].split('::', 1)[0]})" for e in edges]
    return "\n".join([*lines, "## Relations", *dict.fromkeys(rendered)])

"""Retrieval for many questions at once.

All questions are embedded in tasks, their seeds found in one pass over the
vectors of the nodes, and their neighbourhoods by one frontier ``(question,
label, id)``: a hop scans the stored edges once, however many questions there
are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators import adjacency, knn
from codeweft.operators.vector import EMBEDDABLE, Embedder
from codeweft.runtime import ship


def embedded(questions: DataFrame, embedder: Embedder) -> DataFrame:
    """``query_id, vector`` of ``questions(question_id bigint, text)``."""
    ship(questions.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"query_id": part["question_id"], "vector": embedder.embed(part["text"].fillna("").tolist())})

    return questions.select("question_id", "text").mapInPandas(run, "query_id bigint, vector array<double>")


def seeds(nodes: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, label, id, rank, score``: the ``k`` nearest functions and the
    ``k`` nearest classes of each of ``asked(query_id, vector)``."""
    placed = nodes.where(F.col("label").isin(*EMBEDDABLE) & F.col("embedding").isNotNull()).select("id", F.col("embedding").alias("vector"), "label")
    return knn.nearest(placed, asked, k, by=["label"], keep_self=True)


def retrieve_all(nodes: DataFrame, edges: adjacency.Adjacency, asked: DataFrame, k: int = 3, hops: int = 2) -> DataFrame:
    """``query_id, src_label, src_id, rel_type, dst_label, dst_id``: the edges
    within ``hops`` of each question's seeds."""
    return adjacency.neighbourhood(edges, seeds(nodes, asked, k), hops, by=["query_id"]).drop("repo_id")

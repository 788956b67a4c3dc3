"""Answer evaluation: golden questions, runners, scores and reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import metrics

PAIRS = "id string, category string, question string, ground_truth string, expected_entities array<string>, hops int"
ANSWERS = "id string, mode string, answer string, latency double"


def golden_pairs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Questions with what a right answer names; ``hops`` is 1 where missing."""
    return spark.createDataFrame([(*r, 1) if len(r) == 5 else r for r in rows], PAIRS)


def run(pairs: DataFrame, runners: dict[str, Callable[[str], str]]) -> DataFrame:
    """Every runner's answer to every question of a stated set, with its
    latency; a runner's error is an empty answer."""
    rows = []
    for pair in pairs.orderBy("id").toLocalIterator():
        for mode, answer in runners.items():
            begin = time.perf_counter()
            try:
                text = str(answer(pair.question))
            except Exception:  # noqa: BLE001  scored as no answer
                text = ""
            rows.append((pair.id, mode, text, time.perf_counter() - begin))
    return pairs.sparkSession.createDataFrame(rows, ANSWERS)


def scored(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    return metrics.evaluate(answers.join(pairs, "id"))


def report(rows: DataFrame, path: str) -> None:
    """Scores as JSON, averages by mode as CSV and as a markdown table."""
    rows.write.mode("overwrite").json(f"{path}/scores")
    means = metrics.summary(rows).orderBy("mode")
    means.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    head = F.lit("| " + " | ".join(means.columns) + " |\n|" + "-|" * len(means.columns))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in means.columns]), F.lit(" |"))
    lines = means.select(cells.alias("value")).agg(F.concat_ws("\n", head, F.array_join(F.array_sort(F.collect_list("value")), "\n")).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/report")  # one row for each mode

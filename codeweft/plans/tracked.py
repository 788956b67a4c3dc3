"""Queries of the progress tracker over a log that is derived from ``events``:
the batch fold, and the same states from the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.plans import tracker
from codeweft.plans.projection import table
from codeweft.runtime import settled, shared_folder
from codeweft.streaming import tracker as stream

#: Files that the stream reads, so that it has several micro-batches, and how
#: many each of them takes.
FILES, AT_ONCE = 8, 3


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a repository, each event an operation."""
    kind, number = F.col("event_type"), F.col("event_id")
    op = (
        F.when(kind == "signup", F.when(number % 3 == 0, "init").otherwise("start"))
        .when(kind == "error", "fail")
        .when((kind == "purchase") & (number % 4 == 0), "finish")
        .when(kind == "view", "complete")
        .otherwise("update")
    )
    stage = F.get(F.array(*map(F.lit, (*tracker.STAGES, "unknown"))), (number % 6).cast("int"))
    events = table(spark, sf_dir, "events").withColumn("op", op)
    step = F.col("op").isin("update", "complete")
    return events.select(
        F.col("user_id").cast("string").alias("repo_id"),
        number.alias("seq"),
        "op",
        F.when(step, stage).alias("stage"),
        F.floor("value").cast("int").alias("percent"),
        F.when(step, F.concat(F.lit("e"), number)).alias("detail"),
        F.when(F.col("op") == "fail", F.concat(F.lit("E"), number)).alias("error"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def _flat(states: DataFrame) -> DataFrame:
    written = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    stage = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["name"], s["status"], s["percent"].cast("string"), s["detail"])), ",")
    return states.select("repo_id", "status", written("started_at"), written("finished_at"), "error", stage.alias("stages"))


def tracker_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(tracker.fold(log(spark, sf_dir)))


def tracker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in several files, out of order, through the stream's state."""
    whole = log(spark, sf_dir)
    kept = settled(whole.repartition(FILES, F.xxhash64("seq")))
    source = kept.inputFiles()[0].rpartition("/")[0]
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-settled/{uuid.uuid4().hex}"
    events = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", AT_ONCE).parquet(source)
    query = stream.start_states(events, f"{place}/states", f"{place}/checkpoint", once=True)
    query.awaitTermination()
    return _flat(stream.states(spark, f"{place}/states"))


QUERIES = {"tracker_fold": tracker_fold, "tracker_stream": tracker_stream}

_SQL = f"""WITH ops AS (
        SELECT *, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'init' ELSE 'start' END WHEN event_type = 'error' THEN 'fail'
            WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'finish' WHEN event_type = 'view' THEN 'complete' ELSE 'update' END AS op FROM events
    ), log AS (
        SELECT CAST(user_id AS VARCHAR) AS repo_id, event_id AS seq, op, ts AS moment, CASE WHEN op IN ('update', 'complete') THEN list_extract([{", ".join(f"'{s}'" for s in tracker.STAGES)}, 'unknown'], CAST(event_id % 6 + 1 AS INT)) END AS stage,
            CASE WHEN op = 'complete' THEN 100 ELSE greatest(0, least(100, CAST(floor(value) AS INT))) END AS percent FROM ops
    ), bounds AS (
        SELECT repo_id, min(seq) FILTER (op IN ('init', 'start')) AS began, coalesce(max(seq) FILTER (op = 'init'), -1) AS reset FROM log GROUP BY repo_id
    ), ok AS (
        SELECT log.* FROM log JOIN bounds USING (repo_id) WHERE seq >= began AND seq >= reset AND (stage IS NULL OR stage <> 'unknown')
    ), whole AS (
        SELECT repo_id, arg_max(op, seq) FILTER (op IN ('init', 'start', 'finish', 'fail')) AS last, arg_max(moment, seq) FILTER (op = 'start') AS started_at, arg_max(moment, seq) FILTER (op IN ('finish', 'fail')) AS finished_at,
            max(seq) FILTER (op = 'start') AS s, max(seq) FILTER (op = 'finish') AS f, max(seq) FILTER (op = 'fail') AS x
        FROM ok GROUP BY repo_id
    ), steps AS (
        SELECT repo_id, stage, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(percent, seq) AS percent FROM ok WHERE stage IS NOT NULL GROUP BY repo_id, stage
    ), names AS (
        SELECT unnest([{", ".join(f"'{s}'" for s in tracker.STAGES)}]) AS stage, unnest(range(5)) AS k
    ), states AS (
        SELECT whole.repo_id, k, stage, CASE WHEN f IS NOT NULL AND (seq IS NULL OR seq <= f) THEN 'done' WHEN op = 'complete' THEN 'done' WHEN seq IS NULL THEN 'pending' WHEN x IS NOT NULL AND seq <= x THEN 'error' ELSE 'in_progress' END AS state,
            CASE WHEN f IS NOT NULL AND (seq IS NULL OR seq <= f) THEN 100 ELSE coalesce(percent, 0) END AS percent, coalesce('e' || seq, '') AS detail
        FROM whole CROSS JOIN names LEFT JOIN steps USING (repo_id, stage)
    )
    SELECT repo_id, CASE last WHEN 'finish' THEN 'ready' WHEN 'fail' THEN 'error' WHEN 'start' THEN 'indexing' ELSE 'idle' END AS status,
        strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(finished_at, '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
        CASE WHEN x IS NOT NULL AND (s IS NULL OR s < x) THEN 'E' || x END AS error, stages
    FROM whole JOIN (SELECT repo_id, string_agg(stage || ':' || state || ':' || percent || ':' || detail, ',' ORDER BY k) AS stages FROM states GROUP BY repo_id) USING (repo_id)"""

ORACLE_SQL = {"tracker_fold": _SQL, "tracker_stream": _SQL}

"""Indexing progress: a log of events, folded to the state of each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the stages in order.
STAGES = ("cloning", "parsing", "building_graph", "embedding", "ready")


def latest_stages(events: DataFrame) -> DataFrame:
    """``repo_id, stage, percent``: the last update of each stage."""
    last = Window.partitionBy("repo_id", "stage").orderBy(F.desc("seq"))
    return events.withColumn("n", F.row_number().over(last)).where("n = 1").select("repo_id", "stage", "percent")


def slots(events: DataFrame) -> DataFrame:
    """``repo_id, slot, seq, op, percent, detail, error, at``: what each event
    may settle. The state of a repository follows from one event of each slot:
    the last ``init``, ``start``, ``finish`` and ``fail``, the first that
    ``began`` it, and the last of each stage. So the log can be put together in
    any order and in any pieces, and again. Events of unknown stages have no
    slot, and neither have those without a repository."""
    steps = F.col("op").isin("update", "complete") & F.col("stage").isin(*STAGES)
    own = (
        F.when(F.col("op").isin("init", "start"), F.array(F.col("op"), F.lit("began")))
        .when(F.col("op").isin("finish", "fail"), F.array(F.col("op")))
        .when(steps, F.array(F.concat(F.lit("stage:"), F.col("stage"))))
    )
    percent = F.when(F.col("op") == "complete", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("percent", F.lit(0)))))
    return events.where("repo_id IS NOT NULL").select("repo_id", F.explode(own).alias("slot"), "seq", "op", percent.cast("int").alias("percent"), "detail", "error", "at")


def rendered(held: DataFrame) -> DataFrame:
    """``repo_id, status, started_at, finished_at, error, stages`` from
    ``repo_id, slots`` (a map of slots to their events)."""
    slot = lambda name: F.try_element_at("slots", name)
    began, reset = slot(F.lit("began"))["seq"], slot(F.lit("init"))["seq"]
    # What came before a repository began, or before its last init, is forgotten.
    counts = lambda s: (s["seq"] >= began) & (reset.isNull() | (s["seq"] >= reset))
    live = lambda name: F.when(counts(slot(name)), slot(name))
    start, finish, fail = (live(F.lit(n)) for n in ("start", "finish", "fail"))
    latest = lambda *several: F.array_max(F.array(*[F.when(s.isNotNull(), F.struct(s["seq"].alias("seq"), s["op"].alias("op"), s["at"].alias("at"))) for s in several]))
    end = latest(live(F.lit("init")), start, finish, fail)["op"]
    status = F.when(end == "finish", "ready").when(end == "fail", "error").when(end == "start", "indexing").otherwise("idle")
    error = F.when(start.isNull() | (start["seq"] < fail["seq"]), fail["error"])

    def stage(name: Column) -> Column:
        step = live(F.concat(F.lit("stage:"), name))
        over = finish.isNotNull() & (step.isNull() | (step["seq"] <= finish["seq"]))
        state = F.when(over | (step["op"] == "complete"), "done").when(step.isNull(), "pending").when(step["seq"] <= fail["seq"], "error").otherwise("in_progress")
        return F.struct(name.alias("name"), state.alias("status"), F.when(over, 100).otherwise(F.coalesce(step["percent"], F.lit(0))).alias("percent"), F.coalesce(step["detail"], F.lit("")).alias("detail"))

    begun = held.where(began.isNotNull())
    return begun.select("repo_id", status.alias("status"), start["at"].alias("started_at"), latest(finish, fail)["at"].alias("finished_at"), error.alias("error"), F.transform(F.array(*map(F.lit, STAGES)), stage).alias("stages"))


def fold(events: DataFrame) -> DataFrame:
    """State of each repository from ``repo_id, seq, op, stage, percent,
    detail, error, at``: ``status, stages, started_at, finished_at, error``.

    Operations: init (forgets what came before), start, update, complete,
    finish (completes every stage) and fail (marks stages in progress). An
    update of an unknown stage, or of a repository that began in no way, is
    ignored; percents are held within 0 and 100; a start forgets the error of
    the run before. A task puts its events together before any move, so a busy
    repository is no large group."""
    event = F.struct("seq", "op", "percent", "detail", "error", "at")
    one = F.when(F.col("slot") == "began", F.min_by(event, "seq")).otherwise(F.max_by(event, "seq"))
    each = slots(events).groupBy("repo_id", "slot").agg(one.alias("event"))
    return rendered(each.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "event"))).alias("slots")))


def dot_color(status: Column) -> Column:
    return F.when(status == "ready", "green").when(status == "indexing", "amber").otherwise("grey")


def with_live_status(repos: DataFrame, live: DataFrame) -> DataFrame:
    """Stored repositories with the live status where there is one."""
    now = live.select("repo_id", F.col("status").alias("live_status"))
    return repos.join(now, "repo_id", "left").withColumn("status", F.coalesce("live_status", "status")).drop("live_status")


def untracked(repos: DataFrame) -> DataFrame:
    """State of repositories without any event: all stages done if they are
    ready, else none begun."""
    ready = F.col("status") == "ready"
    stage = lambda s: F.struct(s.alias("name"), F.when(ready, "done").otherwise("pending").alias("status"), F.when(ready, 100).otherwise(0).alias("percent"), F.lit("").alias("detail"))
    none = F.lit(None).cast("timestamp")
    return repos.select("repo_id", "status", none.alias("started_at"), none.alias("finished_at"), F.lit(None).cast("string").alias("error"), F.transform(F.array(*map(F.lit, STAGES)), stage).alias("stages"))

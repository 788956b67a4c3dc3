"""Repositories kept current by a stream of notices.

A notice names a repository that changed (``repo_id``), for instance a file
that a hook drops into a folder. Each micro-batch resyncs the repositories that
its notices name, each once, however many notices there are. What a batch did
is recorded under its number: a batch that runs again after a failure does the
repositories that it hadn't come to, and no other twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.plans.engine import Engine

NOTICE = "repo_id string"


def notices(spark: SparkSession, folder: str, at_once: int = 100) -> DataFrame:
    """The notices in a folder of JSON files; up to ``at_once`` files make a
    micro-batch."""
    return spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", at_once).json(folder)


def apply(engine: Engine, changed: DataFrame, run: str, batch: int) -> dict[str, dict[str, int] | None]:
    """Resync what a micro-batch names. One that fails doesn't keep the others
    from their turn; the batch then fails, and runs again."""
    named = [r.repo_id for r in changed.where("repo_id IS NOT NULL").select("repo_id").distinct().orderBy("repo_id").toLocalIterator()]
    done, failed = {}, []
    for repo_id in named:
        try:
            done[repo_id] = engine.resync_once(repo_id, run, batch)
        except Exception as problem:  # noqa: BLE001  told below, and by the repository's status
            failed.append(f"{repo_id}: {str(problem).splitlines()[0] if str(problem) else type(problem).__name__}")
    if failed:
        raise RuntimeError(f"batch {batch}: " + "; ".join(failed))
    return done


def start(engine: Engine, changed: DataFrame, run: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Resync as notices come, without holding up the caller: the query runs
    beside it, ``engine.index_status`` tells where a repository stands.
    ``run`` names the stream for good, ``once`` ends with the notices that are
    there now."""
    writer = changed.writeStream.foreachBatch(lambda rows, batch: apply(engine, rows, run, batch) and None).option("checkpointLocation", checkpoint).queryName(run)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""The progress tracker on a stream.

``latest_stages`` keeps the latest percent of each stage by an aggregate.
``start_states`` runs the whole state machine: its state store holds, for each
repository, the few events that settle its state (``plans.tracker.slots``), so
events may come late, out of order and again, and the state grows with the
number of repositories, not of events. What a task reads of one micro-batch is
put together before it moves, so a repository with most of the events is no
large group. The states that a micro-batch changed are written under the
number of that batch: one that is run again after a failure replaces its own.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from codeweft.plans.tracker import rendered, slots
from codeweft.runtime import ship

_EVENT = "seq bigint, op string, percent int, detail string, error string, at bigint"
_SLOTS = f"repo_id string, slot string, {_EVENT}"
_FIELDS = ["seq", "op", "percent", "detail", "error", "at"]
STATES = "repo_id string, status string, started_at timestamp, finished_at timestamp, error string, stages array<struct<name:string,status:string,percent:int,detail:string>>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_stages(events: DataFrame) -> DataFrame:
    """``repo_id, stage, percent`` of a streaming event log, as an aggregate
    whose state is one row for each repository and stage."""
    return events.groupBy("repo_id", "stage").agg(F.max_by("percent", "seq").alias("percent"))


def start(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest percents in an in-memory table ``name`` (complete mode)."""
    return latest_stages(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settling(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each repository and slot the event that counts: the first that began
    it, the last of the others."""
    ordered = rows.sort_values("seq", kind="stable")
    began = ordered["slot"] == "began"
    return pd.concat([ordered[began].drop_duplicates("repo_id", keep="first"), ordered[~began].drop_duplicates(["repo_id", "slot"], keep="last")])


def _settling_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield settling(part)


def _values(row) -> tuple:
    """An event as the state store takes it: pandas has NaN for null."""
    return (int(row.seq), row.op, int(row.percent), *(None if pd.isna(x) else x for x in (row.detail, row.error)), None if pd.isna(row.at) else int(row.at))


class Tracker(StatefulProcessor):
    """Holds the events that settle the state of a repository, and sends them
    all on when one of them changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as each access is a message to the store
        self._held = handle.getValueState("settled", "slots string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = self._held.get()
        held, changed = json.loads(found[0]) if found else {}, False
        for part in rows:
            for row in settling(part).itertuples(index=False):
                event = _values(row)
                if row.slot in held:
                    seq = held[row.slot][0]
                    if seq == event[0] or (event[0] > seq) == (row.slot == "began"):
                        continue
                held[row.slot] = event
                changed = True
        if changed:
            self._held.update((json.dumps(held),))
            yield pd.DataFrame([(key[0], slot, *event) for slot, event in held.items()], columns=["repo_id", "slot", *_FIELDS])

    def close(self) -> None:
        pass


def settled_slots(events: DataFrame) -> DataFrame:
    """All slots of each repository that a micro-batch of ``events`` (the
    columns of ``plans.tracker.fold``, with a ``bigint`` ``seq``) changed."""
    ship(events.sparkSession)
    # The driver's own worker for state doesn't see shipped files: the class
    # goes to it as code, not by name.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    each = slots(events).withColumn("at", F.unix_micros(F.col("at").cast("timestamp"))).select("repo_id", "slot", *_FIELDS)
    return each.mapInPandas(_settling_batches, _SLOTS).groupBy("repo_id").transformWithStateInPandas(Tracker(), _SLOTS, "Update", "None")


def start_states(events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the states of ``events`` in the folder ``out`` (``states`` reads
    them); ``once`` ends with the events that are there now."""
    spark = events.sparkSession

    def write(changed: DataFrame, batch: int) -> None:
        event = F.struct("seq", "op", "percent", "detail", "error", F.timestamp_micros("at").alias("at"))
        held = changed.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", event))).alias("slots"))
        rendered(held).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the store that keeps maps; read when a query starts
    try:
        writer = settled_slots(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def states(spark: SparkSession, out: str) -> DataFrame:
    """The state of each repository, as ``plans.tracker.fold`` of all events
    that the stream has seen."""
    try:
        rows = spark.read.schema(f"{STATES}, batch bigint").parquet(out)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], STATES)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col("repo_id").alias("__repo")).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("s.*")

"""The tracker on a stream against the fold of the same log, in any order."""

import random
from datetime import datetime, timedelta

from codeweft.plans.tracker import STAGES, fold
from codeweft.streaming import tracker as stream

SCHEMA = "repo_id string, seq long, op string, stage string, percent int, detail string, error string, at timestamp"


def by_hand(log):
    """The state machine, event by event in order."""
    state = {}
    for repo, _, op, stage, percent, detail, error, at in sorted(log, key=lambda e: e[1]):
        fresh = {"status": "idle", "started": None, "finished": None, "error": None, "stages": {s: ("pending", 0, "") for s in STAGES}}
        if op == "init" or (op == "start" and repo not in state):
            state[repo] = fresh
        mine = state.get(repo)
        if mine is None or (stage is not None and stage not in STAGES):
            continue
        if op == "start":
            mine.update(status="indexing", started=at, error=None)
        elif op in ("update", "complete") and stage:
            mine["stages"][stage] = ("done", 100, detail or "") if op == "complete" else ("in_progress", max(0, min(100, percent or 0)), detail or "")
        elif op == "finish":
            mine.update(status="ready", finished=at, stages={s: ("done", 100, d) for s, (_, _, d) in mine["stages"].items()})
        elif op == "fail":
            mine.update(status="error", finished=at, error=error, stages={s: ("error" if x == "in_progress" else x, p, d) for s, (x, p, d) in mine["stages"].items()})
    return {r: (m["status"], m["started"], m["finished"], m["error"], tuple((s, *m["stages"][s]) for s in STAGES)) for r, m in state.items()}


def rows(df):
    return {r.repo_id: (r.status, r.started_at, r.finished_at, r.error, tuple(tuple(s) for s in r.stages)) for r in df.collect()}


def random_log(n, seed):
    r = random.Random(seed)
    log = []
    for seq in range(n):
        op = r.choices(("init", "start", "update", "complete", "finish", "fail"), (1, 3, 12, 8, 1, 2))[0]
        stage = r.choice((*STAGES, "nonsense")) if op in ("update", "complete") else None
        repo = "busy" if r.random() < 0.4 else f"r{r.randrange(12)}"
        log.append((repo, seq, op, stage, r.choice((None, -5, 40, 250)) if stage else None, r.choice((None, f"d{seq}")), f"e{seq}" if op == "fail" else None, datetime(2024, 1, 1) + timedelta(seconds=seq)))
    return log


def test_fold_is_the_state_machine(spark):
    for seed in (1, 2):
        log = random_log(400, seed)
        assert rows(fold(spark.createDataFrame(log, SCHEMA))) == by_hand(log)


def test_stream_equals_fold(spark, tmp_path):
    log = random_log(300, 3)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    mixed = random.Random(4).sample(log, len(log))  # late and out of order
    assert stream.states(spark, out).collect() == []
    for begin, end in ((0, 120), (120, 260), (200, 300)):  # some events come twice
        spark.createDataFrame(mixed[begin:end], SCHEMA).repartition(2).write.mode("append").parquet(folder)
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream.start_states(events, out, checkpoint, once=True)  # a new start each time, from the checkpoint
        assert query.awaitTermination(180)
        assert rows(stream.states(spark, out)) == by_hand(mixed[:end])
    assert len(list((tmp_path / "out").glob("batch=*"))) == 6
    # Nothing new: nothing is written.
    assert stream.start_states(events, out, checkpoint, once=True).awaitTermination(180)
    assert rows(stream.states(spark, out)) == by_hand(log)

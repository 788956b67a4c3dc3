"""One manifest for nodes and edges, changes at the same time, logs put together."""

import threading

import pytest

from codeweft.plans import ingest, sessions
from codeweft.plans.engine import Engine
from codeweft.plans.snapshots import KEPT, Conflict, Manifests, every


def test_a_number_is_given_once(spark, tmp_path):
    folder = f"{tmp_path}/m"
    assert Manifests(spark, folder).last() == (0, {})
    won, lost = [], []

    def add(k):
        try:
            won.append(Manifests(spark, folder).add(0, {"who": k}))
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 7
    for number in range(1, 2 * KEPT):
        assert Manifests(spark, folder).add(number, {"who": "é"}) == number + 1
    assert Manifests(spark, folder).last() == (2 * KEPT, {"who": "é", "number": 2 * KEPT})
    for old in (0, 1, 2 * KEPT - 1):  # also where that number's file is gone already
        with pytest.raises(Conflict):
            Manifests(spark, folder).add(old, {})
    rows = every(spark, folder, "number bigint, who string").collect()
    assert sorted(r.number for r in rows) == list(range(KEPT, 2 * KEPT + 1))
    assert every(spark, f"{tmp_path}/none", "number bigint").count() == 0


def source(tmp_path, **files):
    (tmp_path / "src").mkdir(exist_ok=True)
    for name, text in files.items():
        (tmp_path / "src" / f"{name}.py").write_text(text)
    return str(tmp_path / "src")


def names(engine, repo):
    return {r.name for r in engine.table("nodes", repo).where("label = 'Function'").collect()}


def test_a_change_between_is_not_lost(spark, tmp_path, monkeypatch):
    """Two engines, as two processes have: the second changes a file while the
    first works out its own change."""
    src = source(tmp_path, a="def one():\n    pass\n", b="def two():\n    pass\n")
    first, second = Engine(spark, str(tmp_path / "data")), Engine(spark, str(tmp_path / "data"))
    repo = first.add_repo(src)
    source(tmp_path, a="def uno():\n    pass\n", b="def due():\n    pass\n")
    whole, between = ingest.update_file, [True]

    def held(*args):
        out = whole(*args)
        if between and between.pop():
            assert second.update_file(repo, "b.py")["status"] == "updated"
        return out

    monkeypatch.setattr(ingest, "update_file", held)
    assert first.update_file(repo, "a.py")["status"] == "updated"
    assert names(first, repo) == names(second, repo) == {"uno", "due"}
    assert first._manifests(repo).last()[0] == 3
    # Nodes and raw edges of two versions, the last and the one before, no more.
    for name in ("nodes", "raw_edges"):
        assert len(list((tmp_path / "data" / name / repo).iterdir())) == 2


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "data"))
    repo = engine.add_repo(source(tmp_path, a="def one():\n    pass\n"))
    before = engine.graph(repo)
    monkeypatch.setattr(Engine, "_name", lambda *args: 1 / 0)
    source(tmp_path, b="def two():\n    pass\n")
    with pytest.raises(ZeroDivisionError):
        engine.resync(repo)
    assert names(engine, repo) == {"one"} and len(list((tmp_path / "data/nodes" / repo).iterdir())) == 1
    monkeypatch.undo()
    assert engine.resync(repo) == {"added": 1, "unchanged": 1}
    # What was read before the change can still be read.
    assert before.nodes.where("label = 'Function'").count() == 1 and before.edges.count() == 1
    assert engine.graph().edges.count() == 2
    engine.clear()
    assert engine.graph(repo).nodes.count() == engine.graph().nodes.count() == 0
    assert engine.resync(repo) == {"added": 2} and names(engine, repo) == {"one", "two"}


def test_logs_are_put_together(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"))
    repo = engine.add_repo(source(tmp_path, a="def one():\n    pass\n"))
    kept, gone = engine.create_chat(repo), engine.create_chat(repo)
    for chat in (kept, gone):
        for k in range(3):
            engine._append("messages", sessions.new_message(spark, chat, "user", f"secret {k}"))
    engine.update_chat(kept, title="Mine")
    shown = lambda: [sorted(map(str, df.collect())) for df in (engine.table("repos"), engine.table("chats"), engine.table("messages"), engine.table("events"), engine.index_status(repo), engine.list_repos())]
    files = lambda name: list((tmp_path / "data/logs" / name).rglob("*.parquet"))
    engine.delete_chat(gone)
    was, many, reader = shown(), len(files("messages")), engine.table("messages")
    assert engine.compact(100) == []
    assert set(engine.compact(2)) == {"repos", "chats", "messages", "events"} and engine.compact(1) == []
    assert shown() == was
    assert len(files("messages")) == many + 1 and reader.count() == 3  # for those who read them now
    engine._append("messages", sessions.new_message(spark, kept, "user", "later"))
    assert engine.compact(1) == ["messages"]
    assert engine.table("messages").count() == 4 and shown()[3:] == was[3:]
    # The files put together first are gone, and with them what was deleted.
    assert len(files("messages")) == 3
    held = spark.read.parquet(*[str(f) for f in files("messages")])
    assert held.where("gone").count() > 0 and held.where("gone AND content IS NOT NULL").count() == 0
    # Put together beside each other, once.
    engine._append("messages", sessions.new_message(spark, kept, "user", "last"))
    done = []
    threads = [threading.Thread(target=lambda: done.extend(engine.compact(1))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert done.count("messages") >= 1 and engine.table("messages").count() == 5


def test_jobs_put_logs_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Engine.compact, "__defaults__", (4,))
    engine = Engine(spark, str(tmp_path / "data"))
    repo = engine.add_repo(source(tmp_path, a="def one():\n    pass\n"))
    for _ in range(2):
        engine.resync(repo)
    assert engine._log_files("events")[0] == 3 and engine.index_status(repo).first().status == "ready"
    assert engine.table("events").count() == 1 + 3 * 4

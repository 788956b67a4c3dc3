"""Jobs beside the caller, and repositories kept current by notices."""

import json
import threading

import pytest

from codeweft.plans.engine import Engine
from codeweft.streaming import resync


def notice(folder, name, *repos):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"repo_id": r}) + "\n" for r in repos))


def test_notices_are_applied_once(spark, tmp_path):
    src, box = tmp_path / "src", tmp_path / "notices"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    engine = Engine(spark, str(tmp_path / "data"))
    repo = engine.add_repo(str(src))
    run = lambda: resync.start(engine, resync.notices(spark, str(box)), "keeper", str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    names = lambda: {r.name for r in engine.table("nodes", repo).where("label = 'Function'").collect()}
    (src / "b.py").write_text("def two():\n    pass\n")
    notice(box, "1.json", repo, repo, "nobody")
    assert run() and names() == {"one", "two"}
    assert [r.counts for r in engine.resyncs(repo).collect()] == [{"added": 1, "unchanged": 1}]
    # The same batch again does nothing, even though files changed since.
    (src / "b.py").write_text("def three():\n    pass\n")
    again = spark.createDataFrame([(repo,), (None,)], resync.NOTICE)
    assert resync.apply(engine, again, "keeper", 0) == {repo: None} and names() == {"one", "two"}
    # The next one is another batch, and a stream of another name its own.
    notice(box, "2.json", repo)
    assert run() and names() == {"one", "three"}
    stored = lambda: {p.name for p in (tmp_path / "data/nodes" / repo).iterdir()}
    before = stored()
    assert resync.apply(engine, again, "other", 0) == {repo: {"unchanged": 2}} and stored() == before
    assert engine.resyncs().count() == 3


def test_a_failed_repository_is_done_by_the_next_run(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"))
    repos = []
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text("def one():\n    pass\n")
        repos.append(engine.add_repo(str(tmp_path / name)))
    (tmp_path / "x").rename(tmp_path / "away")
    both = spark.createDataFrame([(r,) for r in repos], resync.NOTICE)
    with pytest.raises(RuntimeError, match=repos[0]):
        resync.apply(engine, both, "k", 7)
    assert engine.index_status(repos[0]).first().status == "error" and engine.index_status(repos[1]).first().status == "ready"
    (tmp_path / "away").rename(tmp_path / "x")
    assert resync.apply(engine, both, "k", 7) == {repos[0]: {"unchanged": 1}, repos[1]: None}
    assert engine.index_status(repos[0]).first().status == "ready"


def test_jobs_run_beside_the_caller(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    engine = Engine(spark, str(tmp_path / "data"))
    go, at_work = threading.Event(), threading.Event()
    whole = Engine._store

    def held(self, *args):
        at_work.set()
        assert go.wait(60)
        whole(self, *args)

    monkeypatch.setattr(Engine, "_store", held)
    repo = engine.add_repo(str(src), wait=False)
    assert at_work.wait(60)
    now = engine.index_status(repo).first()  # while it runs
    assert now.status == "indexing" and {s.name: s.status for s in now.stages}["parsing"] == "done"
    assert engine.list_repos().first().dot_color == "amber" and engine.stats(repo)["node_count"] == 0
    second = engine.submit("resync", repo)  # waits for its turn
    assert not second.done()
    go.set()
    assert second.result(120) == {"unchanged": 1}
    assert engine.index_status(repo).first().status == "ready" and engine.stats(repo)["node_count"] == 2
    (src / "a.py").unlink()
    src.rmdir()
    with pytest.raises(NotADirectoryError):
        engine.submit("rebuild", repo).result(120)
    with pytest.raises(KeyError):
        engine.submit("index", "nobody")

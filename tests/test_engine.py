import pytest

from codeweft.plans import evaluate
from codeweft.plans.engine import Engine
from tests.test_parse import write


def write_second(tmp_path):
    write(tmp_path / "second", {"a.py": "def one():\n    pass\n"})
    return str(tmp_path / "second")


def test_engine(spark, tmp_path):
    write(tmp_path / "src", {"a.py": "import b\n\n\ndef one():\n    b.two()\n", "b.py": "def two():\n    raise Broken('x')\n"})
    engine = Engine(spark, str(tmp_path / "data"))
    repo = engine.add_repo(str(tmp_path / "src"))
    assert engine.add_repo(str(tmp_path / "src")) == repo
    assert engine.stats(repo) == {"node_count": 5, "edge_count": 5, "file_count": 2}
    assert engine.stats("nobody")["node_count"] == 0
    (tmp_path / "src/c.py").write_text("def three():\n    pass\n")
    assert engine.resync(repo) == {"added": 1, "unchanged": 2}
    assert engine.stats(repo)["file_count"] == 3
    assert engine.list_repos().first().dot_color == "green"
    chat = engine.create_chat(repo)
    replies = iter(['{"tool": "trace_impact", "args": {"node_id": "two"}}', '{"complete": true, "answer": "The function one in the file a.py calls two, and nothing else does."}'])
    assert "one" in engine.ask(chat, "Who on earth calls the function two?", lambda prompt: next(replies)).answer
    assert engine.table("chats").first().title == "Who on earth calls the"
    assert engine.table("messages").count() == 2
    assert [r.role for r in engine.messages(chat).collect()] == ["user", "assistant"]
    # another repository's chat isn't touched
    other = engine.create_chat(repo)
    engine.update_chat(other, title="Mine")
    assert engine.get_chat(other)["title"] == "Mine" and engine.get_chat(other)["repo_name"] == "tmp_src".replace("tmp", str(tmp_path).rsplit("/", 1)[-1])
    assert engine.list_chats(repo).count() == 2 and engine.list_chats("none").count() == 0
    engine.delete_chat(other)
    engine.delete_chat("unknown")
    assert engine.list_chats().count() == 1
    with pytest.raises(KeyError):
        engine.get_chat(other)
    assert engine.health()["status"] == "online" and repo in engine.query_url(repo)["url"]
    assert engine.index_status(repo).first().status == "ready"
    # one file
    assert engine.update_file(repo, "b.py") == {"status": "skipped", "reason": "hash_match", "file": "b.py"}
    (tmp_path / "src/b.py").write_text("def second():\n    pass\n")
    told = engine.update_file(repo, "b.py")
    assert (told["status"], told["nodes_added"], told["edges_added"], told["nodes_removed"]) == ("updated", 2, 1, 3)
    assert [s["target"] for s in told["stale_edges"]] == ["b.py::two"]
    (tmp_path / "src/c.py").unlink()
    assert engine.update_file(repo, "c.py") == {"status": "deleted", "file": "c.py", "nodes_removed": 2}
    assert engine.stats(repo)["file_count"] == 2
    second = engine.add_repo(write_second(tmp_path))
    assert engine.stats(second)["node_count"] == 2
    engine.delete_repo(second)
    assert engine.stats(repo)["file_count"] == 2
    engine.clear()
    assert engine.table("nodes").count() == 0 and engine.table("repos").count() == 1
    engine.delete_repo(repo)
    assert engine.table("chats").count() == engine.table("messages").count() == engine.table("nodes").count() == engine.table("repos").count() == 0


def test_evaluation(spark, tmp_path):
    pairs = evaluate.golden_pairs(spark, [("q1", "calls", "Who?", "service.create calls save", ["service.create"]), ("q2", "none", "What?", "", [])])
    answers = evaluate.run(pairs, {"good": lambda q: "service.create calls save", "bad": lambda q: 1 / 0})
    rows = {(r.id, r["mode"]): r for r in evaluate.scored(pairs, answers).collect()}
    assert (rows["q1", "good"].recall, rows["q1", "good"].f1, rows["q1", "good"].fact_overlap) == (1.0, 1.0, 1.0)
    assert (rows["q1", "bad"].recall, rows["q1", "bad"].fact_overlap, rows["q2", "bad"].recall) == (0.0, 0.0, 1.0)
    evaluate.report(evaluate.scored(pairs, answers), str(tmp_path / "out"))
    assert "| good |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/report")).collect())

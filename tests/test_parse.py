from codeweft.plans.ingest import import_candidates, ingest, ingest_changes, load, save
from codeweft.sources.files import listed_files, read_files
from codeweft.sources import python_source, script_source

FILES = {
    "app/__init__.py": "",
    "app/store.py": 'from app import errors\n\n\nclass Base:\n    "Base of all."\n\n\nclass Store(Base):\n    """Keeps rows."""\n\n    def save(self, row):\n        if not row:\n            raise ValueError("empty")\n        return config.PATH\n\n    def find(self, key):\n        raise errors.Missing(key)\n',
    "app/errors.py": "class Missing(Exception):\n    pass\n",
    "app/service.py": 'import app.store as store\nfrom app.errors import Missing\nimport os\n\n\ndef create(row):\n    def inner():\n        return store.save(row)\n    check(row)\n    return inner()\n\n\ndef check(row):\n    os.getenv("MODE", "dev")\n    Missing(row)\n\n\n@deco\nclass Hidden:\n    def lost(self):\n        pass\n',
    "web/api.tsx": "import { get } from './client';\nimport x from 'react';\n// function no() {}\nexport interface User { id: string }\ntype Pair<T> = { a: T };\nexport const load = async (id: string) => {\n  const s = `${wrap(id)} } function gone() {`;\n  return client.get(id);\n};\nfunction View() { function inner() { return 1; } return <Panel><b/></Panel>; }\nclass Api {}\n",
    "web/client.ts": "export function get(id) { return new Thing(fetch('/x')); }\n",
    "notes.md": "# Notes\n",
    "bad.py": "def broken(:\n",
    "node_modules/skip.js": "function never() {}\n",
}


def write(root, files=FILES):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def edges(parsed, kind):
    return {(e["source"], e["target"]) for e in parsed.edges if e["type"] == kind}


def test_python_rules():
    got = python_source.parse("app/service.py", FILES["app/service.py"], FILES)
    assert {n["name"] for n in got.nodes if n["label"] == "Function"} == {"create", "check"}
    assert not [n for n in got.nodes if n["label"] == "Class"]
    assert edges(got, "CALLS") == {("app/service.py::create", "app/store.py::save"), ("app/service.py::create", "app/service.py::check"), ("app/service.py::create", "app/service.py::inner"), ("app/service.py::check", "module::app/errors.py::Missing")}
    assert edges(got, "READS") == {("app/service.py::check", "config::env.MODE"), ("app/service.py::check", "config::env.dev")}
    assert edges(got, "IMPORTS") == {("module::app/service.py", "module::app/store.py"), ("module::app/service.py", "module::app/errors.py")}
    got = python_source.parse("app/store.py", FILES["app/store.py"], FILES)
    assert edges(got, "INHERITS") == {("app/store.py::Store", "app/store.py::Base")}
    assert edges(got, "RAISES") == {("app/store.py::save", "exception::ValueError"), ("app/store.py::find", "exception::errors.Missing")}
    assert ("app/store.py::Store", "app/store.py::save") in edges(got, "HAS_METHOD") & edges(got, "CONTAINS")
    assert edges(got, "IMPORTS") == {("module::app/store.py", "module::app/errors.py")}
    bad = python_source.parse("bad.py", FILES["bad.py"], FILES)
    assert bad.error and [n["label"] for n in bad.nodes] == ["Module"]
    assert python_source.parse("empty.py", "", FILES).error is None


def test_script_rules():
    got = script_source.parse("web/api.tsx", FILES["web/api.tsx"], FILES)
    assert {n["name"] for n in got.nodes if n["label"] == "Function"} == {"load", "View", "inner"}
    assert {n["name"] for n in got.nodes if n["label"] == "Class"} == {"User", "Pair", "Api"}
    assert edges(got, "IMPORTS") == {("module::web/api.tsx", "module::web/client.ts")}
    assert edges(got, "CALLS") == {("web/api.tsx::load", "ts_call::wrap"), ("web/api.tsx::load", "ts_call::client.get"), ("web/api.tsx::View", "ts_call::Panel")}
    got = script_source.parse("web/client.ts", FILES["web/client.ts"], FILES)
    assert edges(got, "CALLS") == {("web/client.ts::get", "ts_call::fetch")}


def test_ingest_and_resync(spark, tmp_path):
    write(tmp_path)
    nodes, raw, graph = ingest(spark, str(tmp_path), "r")
    found = {(r.label, r.id) for r in nodes.collect()}
    assert ("Module", "module::notes.md") in found and ("Module", "module::bad.py") in found
    assert not [i for _, i in found if "node_modules" in i or "Hidden" in i]
    calls = {(r.src_id, r.dst_id) for r in graph.edges.where("rel_type = 'CALLS'").collect()}
    assert calls == {("app/service.py::create", "app/store.py::save"), ("app/service.py::create", "app/service.py::check"), ("app/store.py::find", "app/errors.py::Missing")}
    nodes, raw = nodes.cache(), raw.cache()
    nodes.count(), raw.count()
    (tmp_path / "app/store.py").write_text(FILES["app/store.py"].replace("def find", "def search"))
    (tmp_path / "app/errors.py").unlink()
    (tmp_path / "new.py").write_text("def fresh():\n    pass\n")
    merged, edges_now, diff = ingest_changes(spark, str(tmp_path), "r", nodes, raw)
    assert {r.file: r.status for r in diff.where("status <> 'unchanged'").collect()} == {"app/store.py": "changed", "app/errors.py": "deleted", "new.py": "added"}
    ids = {r.id for r in merged.collect()}
    assert {"app/store.py::search", "new.py::fresh", "module::notes.md"} <= ids and "app/store.py::find" not in ids
    assert edges_now.where("source = 'app/service.py::create' AND target = 'app/store.py::save'").count() == 1


def test_every_file(spark, tmp_path):
    """Names that begin with an underscore or a dot are read, skipped
    directories aren't entered."""
    files = {"pkg/__init__.py": "from pkg import _private\n", "pkg/_private.py": "class P:\n    pass\n", "pkg/__main__.py": "import pkg\n", "__tests__/a.js": "import { x } from '../pkg/_b';\n", "pkg/_b.js": "function x() {}\n", ".hidden.json": "{}", ".github/w.yml": "a: 1", "notes.txt": "no"}
    write(tmp_path, files | {f"{d}/x.py": "def lost(): pass\n" for d in ("node_modules", "a/__pycache__", ".git", "dist", "venv")})
    assert [f for f, _ in listed_files(spark, str(tmp_path))] and {f for f, _ in listed_files(spark, str(tmp_path))} == set(files) - {"notes.txt"}
    assert {f for f, _ in listed_files(spark, f"file://{tmp_path}")} == set(files) - {"notes.txt"}
    _, raw, graph = ingest(spark, str(tmp_path), "0042")
    imports = {(r.src_id, r.dst_id) for r in graph.edges.where("rel_type = 'IMPORTS'").collect()}
    assert imports == {("module::pkg/__init__.py", "module::pkg/_private.py"), ("module::pkg/__main__.py", "module::pkg/__init__.py"), ("module::__tests__/a.js", "module::pkg/_b.js")}
    save(graph.nodes, raw, str(tmp_path / "stored"))
    stored = load(spark, str(tmp_path / "stored"))
    assert {r.repo_id for r in stored.nodes.collect()} == {"0042"} and stored.edges.count() == graph.edges.count()


def test_candidates_are_few(spark, tmp_path):
    """What a file is joined on follows its own imports, not the number of
    files there are."""
    write(tmp_path, {f"m{k}.py": f"import m{k + 1}\n" for k in range(300)})
    files = read_files(spark, str(tmp_path), "r")
    assert import_candidates(files).groupBy("file").count().agg({"count": "max"}).first()[0] == 3
    assert ingest(spark, str(tmp_path), "r")[2].edges.where("rel_type = 'IMPORTS'").count() == 299

"""Ingest of files that can't be parsed, are deep, long or odd."""

import time

from codeweft.plans.ingest import emitted_nodes, errors, ingest, parse_file, raw_edges, scan_files
from codeweft.sources import python_source, script_source
from codeweft.sources.files import listed_files, read_files

FILES = {
    "ok.py": "import deep\n\n\ndef go():\n    deep.f(1)\n",
    "deep.py": "def f(x):\n    return x" + ".a()" * 200 + "\n",
    "deeper.py": "def f(x):\n    return x" + ".a()" * 5000 + "\n",
    "nested.py": "x = " + "(" * 5000 + ")" * 5000 + "\n",
    "bytes.py": "def lost():\n    pass\n\0",
    "deep.js": "function a() {" + "x(function () {" * 3000 + "})" * 3000 + "}",
    "open.ts": "function b() { if (`${c(",
}


def targets(parsed, kind="CALLS"):
    return [e["target"] for e in parsed.edges if e["type"] == kind]


def test_one_file_stops_no_other(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    scanned = scan_files(read_files(spark, str(tmp_path), "r"))
    assert {r.file for r in errors(scanned).collect()} == {"deeper.py", "nested.py", "bytes.py"}
    nodes, raw, graph = ingest(spark, str(tmp_path), "r")
    ids = {r.id for r in nodes.collect()}
    assert {f"module::{f}" for f in FILES} <= ids and {"ok.py::go", "deep.py::f", "deep.js::a", "open.ts::b"} <= ids
    assert graph.edges.where("rel_type = 'CALLS' AND src_id = 'ok.py::go' AND dst_id = 'deep.py::f'").count() == 1


def test_parser_that_breaks(monkeypatch):
    def breaks(*_):
        raise KeyError("odd")

    monkeypatch.setattr(script_source, "Tokens", breaks)
    got = parse_file("a.ts", b"x()", "h")
    assert got.error == "KeyError: 'odd'" and [(n["label"], n["file_hash"]) for n in got.nodes] == [("Module", "h")] and not got.edges


def test_lines_end_where_the_tokenizer_ends_them():
    text = 'def a():\n    x = 1\n\x0c\ndef b():\r\n    """S\u2028T"""\r    return "\x1c"\n\ndef c():\n    pass\n'
    got = {n["name"]: n for n in python_source.scan("m.py", text).nodes if n["label"] == "Function"}
    assert got["b"]["source_code"] == 'def b():\n    """S\u2028T"""\n    return "\x1c"' and got["b"]["line"] == 4
    assert got["c"]["source_code"] == "def c():\n    pass"
    assert python_source.scan("m.py", "\ufeffdef d():\n    pass\n").error is None


def test_raised():
    body = "def f(e):\n    raise a.b(c).d\n    raise errs[0](1)\n    raise (Q)\n    raise\n    raise e from x\n    raise pkg.Gone\n    raise 'é' if e else é.Z(1)\n"
    assert targets(python_source.scan("m.py", body), "RAISES") == ["exception::a.b", "exception::errs[0]", "exception::e", "exception::pkg.Gone"]


def test_later_import_binds_a_name():
    text = "import one.x\nfrom two import x\nimport nowhere.x\nfrom pk import *\nfrom pk import s, s as t, z\n\ndef f():\n    x.go()\n    z()\n"
    known = {"one/x.py", "two/x.py", "pk/__init__.py", "pk/s.py"}
    got = python_source.parse("m.py", text, known)
    assert targets(got) == ["two/x.py::go", "module::pk/__init__.py::z"]
    assert sorted(targets(got, "IMPORTS")) == ["module::one/x.py", "module::pk/__init__.py", "module::pk/s.py", "module::two/x.py"]
    assert targets(python_source.parse("m.py", text, {"one/x.py"})) == ["one/x.py::go", "m.py::z"]


def test_join_settles_imports_as_a_list_does(spark):
    texts = {"a.py": "from p import q, r\nimport p.r as k\nclass C(k.B, q):\n    def m(self):\n        k.go(); q()\n", "p/__init__.py": "", "p/r.py": "from . import z\nfrom .. import a\n", "w/i.ts": "import x from './j';\nimport '../w/k/';\n", "w/j.jsx": "", "w/k/index.js": "import './no'"}
    files = spark.createDataFrame([("r", f, t.encode(), "h") for f, t in texts.items()], "repo_id string, file string, content binary, file_hash string")
    scanned = scan_files(files)
    got = sorted((r.source, r.target, r.type, r.file) for r in raw_edges(scanned).collect())
    assert got == sorted((e["source"], e["target"], e["type"], f) for f, t in texts.items() for e in parse_file(f, t.encode()).settled(texts).edges)
    assert ("module::w/i.ts", "module::w/j.jsx", "IMPORTS", "w/i.ts") in got and ("a.py::m", "p/r.py::go", "CALLS", "a.py") in got


def test_shared_nodes_belong_to_the_first_file(spark):
    rows = [("r", f"{k}.py", b"def f():\n    raise E(config.K)\n", "h") for k in "cab"]
    files = spark.createDataFrame(rows, "repo_id string, file string, content binary, file_hash string")
    got = {(n.label, n.file) for n in emitted_nodes(scan_files(files)).collect() if n.label in ("Exception", "Config")}
    assert got == {("Exception", "a.py"), ("Config", "a.py")}


def test_script_grammar():
    text = """import d, { e } from './d';
import type { T } from "./t";
export * from './not-an-import';
const lazy = import('./later');
export interface Shape<K extends Map<string, Array<{ a: number }>>> extends Base<{ x: 1 }> { area(): number }
type Fn<A> = (a: A) => Promise<
  Record<string, A>
>
type U = 'a' | 'b';
abstract class Circle<T> extends Round<{ r: T }> implements Shape<Map<string, Array<{ a: number }>>> {
  constructor(private r: T) { super(r); }
  area(): number { return compute(this.r); }
}
const Named = class Inner { };
export default async function main(a: Map<string, { b: () => void }> = make()): Promise<Array<{ c: number }>> {
  const re = /function lost\\(\\) \\{/g, s = 'function gone() {', q = `${inner(`${x.y?.(1)}`)} function none() {}`;
  await client.get<Foo<Bar<string>>>(a), new Thing(b), a.b(c).d(e);
  return items.map((i) => i / 2);
}
function over(a: string): void;
function over(a: any): void { first(a); }
function over(a: any) { second(a); }
var one = 1, two = (x) => called(x), three = async y => { other(y) }, four = function named() { four4() }
const value = wrap(() => 5);
let typed: (a: string) => void = (a) => { run(a); };
const View = () => (<Panel kind={f(1)}>text <Inner.Part/> {a < B} don't</Panel>);
"""
    got = script_source.parse("m/a.tsx", text, {"m/d.ts", "m/t.tsx", "m/later.ts", "m/not-an-import.ts"})
    names = lambda label: [n["name"] for n in got.nodes if n["label"] == label]
    assert names("Class") == ["Shape", "Fn", "U", "Circle", "Inner"]
    assert names("Function") == ["main", "over", "two", "three", "four", "typed", "View"]
    assert sorted(targets(got, "IMPORTS")) == ["module::m/d.ts", "module::m/t.tsx"]
    calls = {(e["source"].split("::")[1], e["target"].removeprefix("ts_call::")) for e in got.edges if e["type"] == "CALLS"}
    assert calls == {("main", "make"), ("main", "inner"), ("main", "x.y"), ("main", "client.get"), ("main", "a.b"), ("main", "items.map"), ("over", "first"), ("over", "second"), ("two", "called"), ("three", "other"), ("four", "four4"), ("typed", "run"), ("View", "Panel"), ("View", "f"), ("View", "Inner.Part")}
    code = {n["name"]: n.get("source_code") for n in got.nodes}
    assert code["Fn"] == "type Fn<A> = (a: A) => Promise<\n  Record<string, A>\n>" and code["U"] == "type U = 'a' | 'b';"
    assert code["Circle"].startswith("class Circle<T>") and code["Circle"].endswith("compute(this.r); }\n}")
    assert code["main"].startswith("async function main") and code["main"].endswith("i / 2);\n}")
    assert {n["name"]: n["line"] for n in got.nodes}["Circle"] == 10


def test_long_script_takes_linear_time():
    line = "export const f{0} = async (a: Map<string, Array<number>>) => {{ const r = await client.get<Foo<Bar>>(`/x/${{a.b(c())}}`); return g{0}(r); }};\n"
    took = []
    for n in (2000, 8000):
        text = "".join(line.format(k) for k in range(n))
        begin = time.process_time()
        got = script_source.scan("a.ts", text)
        took.append(time.process_time() - begin)
        assert len(got.nodes) == n + 1 and len(targets(got)) == 4 * n
    assert took[1] < 12 * took[0]


def test_skipped_folders(spark, tmp_path):
    for name in ("env/a.py", ".eggs/b.py", "src/c.py", "environment/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert [f for f, _ in listed_files(spark, str(tmp_path))] == ["environment/d.py", "src/c.py"]

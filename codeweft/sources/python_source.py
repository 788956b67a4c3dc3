"""Python files to nodes and raw edges, on the standard syntax tree.

Nothing here follows the depth of a chain of calls or attributes by recursion,
and a chain is looked at once, so long and deep files take linear time.
"""

from __future__ import annotations

import ast
import posixpath
import re
import warnings
from collections import defaultdict
from collections.abc import Collection

from codeweft.sources.emit import Parsed, entity_id, module_id, module_name

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_paths(dotted: str, file: str) -> list[str]:
    """The files that a dotted module name may be; leading dots climb from
    ``file``."""
    bare = dotted.lstrip(".")
    dots = len(dotted) - len(bare)
    base = ""
    if dots:
        base = posixpath.dirname(file)
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
    path = posixpath.join(base, *bare.split(".")) if bare else base
    return [f"{path}/__init__.py" if path else "__init__.py", f"{path}.py", path]


def scan(file: str, text: str, file_hash: str | None = None, extended: bool = False) -> Parsed:
    """Nodes and edges of one file; imports are lookups. A file that doesn't
    parse still gives its module, and the error. ``extended`` also keeps
    decorated classes and reads by ``os.environ.get``."""
    out = Parsed(file)
    module = out.node("Module", module_id(file), module_name(file), line=1, file_hash=file_hash)
    text = text.removeprefix("﻿")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return out.failed(problem)
    names = _imports(tree, out, module)
    # Lines as the tokenizer counts them: a form feed, for one, ends none.
    lines = re.split("\r\n|\r|\n", text)
    for item in tree.body:
        if isinstance(item, ast.ClassDef) and (extended or not item.decorator_list):
            _class(item, out, module, names)
    for item in tree.body:
        if isinstance(item, _DEFS):
            _function(item, None, out, module, names, lines, extended)
        elif isinstance(item, ast.ClassDef) and (extended or not item.decorator_list):
            for inner in item.body:
                if isinstance(inner, _DEFS):
                    _function(inner, entity_id(file, item.name), out, module, names, lines, extended)
    return out


def parse(file: str, text: str, known: Collection[str], file_hash: str | None = None, extended: bool = False) -> Parsed:
    """``scan`` with imports settled; ``known`` holds all files of the
    repository."""
    return scan(file, text, file_hash, extended).settled(known)


def _imports(tree: ast.Module, out: Parsed, module: str) -> dict[str, list[int]]:
    """Lookups of each name that an import binds, the one that counts first;
    IMPORTS edges to files of the repository, to submodules rather than to the
    package they come from."""
    bound: dict[str, list[list[int]]] = defaultdict(list)
    for item in ast.walk(tree):
        if isinstance(item, ast.Import):
            for alias in item.names:
                k = out.lookup(module_paths(alias.name, out.file))
                bound[alias.asname or alias.name.rsplit(".", 1)[-1]].append([k])
                out.edge(module, None, "IMPORTS", [(k, "module::", "")])
        elif isinstance(item, ast.ImportFrom):
            package = "." * item.level + (item.module or "")
            parent = out.lookup(module_paths(package, out.file))
            join = "" if package.endswith(".") else "."
            submodules = []
            for alias in item.names:
                if alias.name == "*":
                    continue
                sub = out.lookup(module_paths(f"{package}{join}{alias.name}", out.file))
                submodules.append(sub)
                bound[alias.asname or alias.name].append([sub, parent])
            submodules = list(dict.fromkeys(submodules))
            for sub in submodules:
                out.edge(module, None, "IMPORTS", [(sub, "module::", "")])
            out.edge(module, None, "IMPORTS", [(parent, "module::", "")], unless=submodules)
    # The last import that is found binds a name.
    return {name: [k for ks in reversed(several) for k in ks] for name, several in bound.items()}


def docstring(body: list[ast.stmt]) -> str | None:
    """The first string that stands alone in the body."""
    for item in body:
        if isinstance(item, ast.Expr) and isinstance(item.value, ast.Constant) and isinstance(item.value.value, str):
            return item.value.value.strip("\"' \n\t")
    return None


def _class(item: ast.ClassDef, out: Parsed, module: str, names: dict[str, list[int]]) -> None:
    ident = out.node("Class", entity_id(out.file, item.name), item.name, line=item.lineno, docstring=docstring(item.body))
    out.edge(module, ident, "CONTAINS")
    for base in item.bases:
        if isinstance(base, ast.Name):
            owner, name = base.id, base.id
        elif isinstance(base, ast.Attribute):
            owner, name = base.value.id if isinstance(base.value, ast.Name) else "", base.attr
        else:
            continue
        out.edge(ident, entity_id(out.file, name), "INHERITS", [(k, "", f"::{name}") for k in names.get(owner, ())])


def _raised(part: ast.Raise, lines: list[str]) -> str:
    """The text of what is raised, up to its first bracket; nothing for what
    stands in brackets or isn't a name, an attribute or a call."""
    exc = part.exc
    if not isinstance(exc, (ast.Name, ast.Attribute, ast.Call)):
        return ""
    # Columns count bytes.
    line = lambda k: lines[k - 1].encode()
    ahead = line(part.lineno)[part.col_offset : exc.col_offset if exc.lineno == part.lineno else None]
    if b"(" in ahead:
        return ""
    said = []
    for k in range(exc.lineno, exc.end_lineno + 1):
        piece = line(k)[exc.col_offset if k == exc.lineno else 0 : exc.end_col_offset if k == exc.end_lineno else None]
        said.append(piece.split(b"(")[0])
        if b"(" in piece:
            break
    return b"\n".join(said).decode(errors="replace").strip()


def _function(item: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None, out: Parsed, module: str, names: dict[str, list[int]], lines: list[str], extended: bool) -> None:
    source = "\n".join(lines[item.lineno - 1 : item.end_lineno])
    ident = out.node("Function", entity_id(out.file, item.name), item.name, line=item.lineno, docstring=docstring(item.body), source_code=source)
    out.edge(owner or module, ident, "CONTAINS")
    if owner:
        out.edge(owner, ident, "HAS_METHOD")
    # Calls, raises and reads of nested functions count for the outer one.
    for part in (p for statement in item.body for p in ast.walk(statement)):
        if isinstance(part, ast.Call):
            _call(part, ident, out, names, extended)
        elif isinstance(part, ast.Raise) and part.exc is not None:
            if name := _raised(part, lines):
                out.edge(ident, out.node("Exception", f"exception::{name}", name), "RAISES")
        elif isinstance(part, ast.Attribute) and isinstance(part.value, ast.Name) and part.value.id == "config":
            out.edge(ident, out.node("Config", f"config::config.{part.attr}", f"config.{part.attr}"), "READS")


def _reads_environment(func: ast.Attribute, extended: bool) -> bool:
    value = func.value
    if func.attr == "getenv":
        return isinstance(value, ast.Name) and value.id == "os"
    return extended and func.attr == "get" and isinstance(value, ast.Attribute) and value.attr == "environ" and isinstance(value.value, ast.Name) and value.value.id == "os"


def _call(part: ast.Call, ident: str, out: Parsed, names: dict[str, list[int]], extended: bool) -> None:
    func = part.func
    if isinstance(func, ast.Attribute):
        if _reads_environment(func, extended):
            for arg in part.args:
                if isinstance(arg, ast.Constant) and isinstance(arg.value, str):
                    out.edge(ident, out.node("Config", f"config::env.{arg.value}", f"env.{arg.value}"), "READS")
        # Imports bind names without dots, so only a plain name can be one.
        owner = func.value.id if isinstance(func.value, ast.Name) else ""
        if owner in names and owner not in ("self", "cls"):
            out.edge(ident, None, "CALLS", [(k, "", f"::{func.attr}") for k in names[owner]], raw_callee=f"{owner}.{func.attr}")
    elif isinstance(func, ast.Name):
        # A bare imported name keeps the module's own id in front, which names
        # no node; only calls within the file resolve.
        out.edge(ident, entity_id(out.file, func.id), "CALLS", [(k, "module::", f"::{func.id}") for k in names.get(func.id, ())], raw_callee=func.id)

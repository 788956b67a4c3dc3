"""What parsers produce: nodes and raw edges of one file, in emit order.

A parser doesn't know which other files there are. What an import may stand
for is a lookup, a list of paths in order of preference; an edge whose target
depends on imports carries its choices: the first one whose lookup names a file
of the repository gives the target. So a file is parsed once, and imports are
settled afterwards, by a join (``plans.ingest``) or from a list (``settled``).
"""

from __future__ import annotations

from collections.abc import Collection, Iterable
from dataclasses import dataclass, field

#: Shared by the many edges that depend on no import; never changed.
_NONE: list = []


def entity_id(file: str, name: str) -> str:
    return f"{file}::{name}"


def module_id(file: str) -> str:
    return f"module::{file}"


def module_name(file: str) -> str:
    name = file.replace("/", ".")
    for suffix in (".py", ".ts", ".tsx"):
        name = name.removesuffix(suffix)
    return name


@dataclass
class Parsed:
    """Rows of one file."""

    file: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    error: str | None = None
    lookups: list[list[str]] = field(default_factory=list)
    _places: dict[tuple[str, ...], int] = field(default_factory=dict, repr=False)

    def node(self, label: str, ident: str, name: str, **more) -> str:
        self.nodes.append({"label": label, "id": ident, "name": name, "file": self.file, **more})
        return ident

    def edge(self, source: str, target: str | None, kind: str, choices: Iterable[tuple[int, str, str]] = (), unless: Iterable[int] = (), **props: str) -> None:
        """``choices``: (lookup, what stands before its file, what stands
        behind); ``target`` is taken where none is found, and the edge falls
        away if that is None. It also falls away if a lookup of ``unless`` is
        found."""
        chosen = [{"lookup": k, "before": before, "behind": behind} for k, before, behind in choices] if choices else _NONE
        self.edges.append({"source": source, "target": target, "type": kind, "props": props, "choices": chosen, "unless": unless or _NONE})

    def lookup(self, paths: Iterable[str]) -> int:
        """The place of a lookup; the same paths have the same place."""
        key = tuple(paths)
        if key not in self._places:
            self._places[key] = len(self.lookups)
            self.lookups.append(list(key))
        return self._places[key]

    def failed(self, problem: BaseException) -> Parsed:
        """The module alone, and the error."""
        self.nodes, self.edges, self.lookups = [n for n in self.nodes if n["label"] == "Module"][:1], [], []
        self.error = f"{type(problem).__name__}: {problem}"[:1000]
        return self

    def settled(self, known: Collection[str]) -> Parsed:
        """With targets in place of choices; ``known`` holds the files that
        imports can name."""
        found = [next((path for path in paths if path in known), None) for paths in self.lookups]
        out = Parsed(self.file, self.nodes, [], self.error)
        for e in self.edges:
            target = next((f"{c['before']}{found[c['lookup']]}{c['behind']}" for c in e["choices"] if found[c["lookup"]] is not None), e["target"])
            if target is not None and all(found[k] is None for k in e["unless"]):
                out.edge(e["source"], target, e["type"], **e["props"])
        return out

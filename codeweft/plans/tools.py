"""Tools over a graph, each ``dict -> dict``; the engine's extension surface."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from codeweft.operators import inspect, traverse
from codeweft.operators.vector import Embedder, HashingEmbedder, retrieve
from codeweft.schema import Graph
from codeweft.sources.files import file_content

ROWS = 200
#: Paths of one depth that a call chain enumerates; beyond, it says so.
MOST_PATHS = 100_000


def unfenced(text: str) -> str:
    """What is inside the first code fence, or all of it without one."""
    found = re.search(r"```[A-Za-z]*\s*\n?(.*?)```", text, re.S)
    return (found[1] if found else text).strip()


#: Parts of a parsed plan that only read what is inside the query.
_READS = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedWith UnresolvedHaving Union Except Intersect "
    "UnresolvedRelation UnresolvedInlineTable OneRowRelation UnresolvedSubqueryColumnAliases WithWindowDefinition Generate LateralJoin Pivot Unpivot Window".split()
)
_CALLS_OUT = re.compile(r"\b(java_method|reflect|try_reflect)\b", re.I)


def _listed(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _refused(plan, names: frozenset[str]) -> str | None:
    """What the plan does besides reading ``names``; None if nothing. The
    names of a WITH are readable inside it only."""
    kind = plan.nodeName()
    if kind not in _READS:
        return kind
    if kind == "UnresolvedRelation":
        name = ".".join(_listed(plan.multipartIdentifier()))
        return None if name.lower() in names else f"relation {name}"
    if kind == "UnresolvedWith":
        for relation in _listed(plan.cteRelations()):
            if found := _refused(relation._2(), names):
                return found
            names = names | {relation._1().lower()}
        return _refused(plan.child(), names)
    for inner in (*_listed(plan.children()), *_listed(plan.subqueries())):
        if found := _refused(inner, names):
            return found
    return None


def guarded(spark: SparkSession, sql: str, views: tuple[str, ...] = ("nodes", "edges")) -> str:
    """``sql`` if it parses as one query that reads ``views`` only, else an
    error. It is the parsed plan that is judged, not the words."""
    sql = sql.rstrip().rstrip(";")
    if _CALLS_OUT.search(sql):
        raise ValueError("functions that call Java methods are not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise ValueError(f"the query doesn't parse: {str(error).strip().splitlines()[0]}") from error
    found = _refused(plan, frozenset(views))
    if found:
        raise ValueError(f"only a single SELECT over {' and '.join(views)} is allowed, not {found}")
    return sql


def isolated(graph: Graph) -> SparkSession:
    """A new session in which ``nodes`` and ``edges`` are the graph's."""
    spark = graph.nodes.sparkSession.newSession()
    of_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, rows in (("nodes", graph.nodes), ("edges", graph.edges)):
        of_rows(spark._jsparkSession, rows._jdf.logicalPlan()).createOrReplaceTempView(name)
    return spark


@dataclass
class Toolbox:
    """Tools bound to a graph. ``generate`` turns a prompt into text (a model);
    without one, the tools that need it say so."""

    graph: Graph
    files: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)
    generate: Callable[[str], str] | None = None

    def registry(self) -> dict[str, Callable[[dict], dict]]:
        return {f.__name__: f for f in (self.graph_rag_search, self.run_query, self.list_by_pattern, self.trace_impact, self.get_call_chain, self.get_file_content, self.suggest_fix)}

    def _own(self, args: dict) -> Graph:
        return self.graph.within(args["repo_id"]) if args.get("repo_id") else self.graph

    def graph_rag_search(self, args: dict) -> dict:
        if not args.get("query"):
            return {"error": "query is needed"}
        got = retrieve(self.graph, args["query"], self.embedder, int(args.get("top_k", 3)), int(args.get("hops", 2)), args.get("repo_id") or None)
        return {"context": got.context, "seeds": got.seeds, "metrics": got.metrics, "truncated": got.truncated}

    def run_query(self, args: dict) -> dict:
        """A question to SQL, run read-only over the repository's own views;
        after an error it is asked for once more."""
        if self.generate is None:
            return {"error": "no generator is configured"}
        own, problem, sql = self._own(args), "", ""
        spark = isolated(own)
        for _ in range(2):
            sql = unfenced(self.generate(query_prompt(args.get("intent", ""), own, problem)))
            try:
                rows = spark.sql(guarded(spark, sql)).limit(ROWS + 1).collect()
                return {"sql": sql, "rows": [r.asDict(recursive=True) for r in rows[:ROWS]], "truncated": len(rows) > ROWS}
            except Exception as error:  # noqa: BLE001  what went wrong goes into the next prompt
                problem = str(error).split("\n")[0]
        return {"error": problem, "sql": sql}

    def list_by_pattern(self, args: dict) -> dict:
        preset = inspect.PRESETS.get(args.get("pattern", ""))
        if preset is None:
            return {"error": f"unknown pattern; there are {', '.join(sorted(inspect.PRESETS))}"}
        return {"pattern": args["pattern"], "results": [r.asDict() for r in preset(self._own(args)).collect()]}

    def _target(self, args: dict) -> DataFrame | None:
        if not args.get("node_id"):
            return None
        found = traverse.find_node(self.graph.nodes, args["node_id"], args.get("repo_id") or None)
        return None if found.isEmpty() else found

    def trace_impact(self, args: dict) -> dict:
        target = self._target(args)
        if target is None:
            return {"error": f"no node is named {args.get('node_id')!r}"}
        own = self._own(args)
        out: dict = {"id": target.first().id, "truncated": False}
        for branch, rows in traverse.impact_branches(own, target).items():
            ids = [r.id for r in rows.select("id").orderBy("id").limit(ROWS + 1).collect()]
            out[branch] = ids[:ROWS]
            out["truncated"] |= len(ids) > ROWS
        return out

    def get_call_chain(self, args: dict) -> dict:
        direction = args.get("direction", "downstream")
        if direction not in ("downstream", "upstream"):
            return {"error": "direction is downstream or upstream"}
        target = self._target(args)
        if target is None:
            return {"error": f"no node is named {args.get('node_id')!r}"}
        try:
            depth = traverse.check_depth(args.get("depth", 4))
        except ValueError as error:
            return {"error": str(error)}
        try:
            paths = traverse.call_chains(self._own(args), target, depth, direction == "upstream", MOST_PATHS).orderBy("depth", "node_ids").limit(ROWS + 1).collect()
        except ValueError as error:
            return {"error": str(error)}
        return {"chain": [r.asDict() for r in paths[:ROWS]], "truncated": len(paths) > ROWS}

    def get_file_content(self, args: dict) -> dict:
        if self.files is None:
            return {"error": "no files are attached"}
        return file_content(self.files, args.get("repo_id", ""), args.get("file_path", ""))

    def suggest_fix(self, args: dict) -> dict:
        if self.generate is None:
            return {"error": "no generator is configured"}
        return {"suggestion": self.generate(f"Suggest a fix.\nIssue: {args.get('issue', '')}\nCode:\n{args.get('code', '')}")}


def query_prompt(intent: str, graph: Graph, problem: str = "") -> str:
    tables = "\n".join(f"{name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)})" for name, df in (("nodes", graph.nodes), ("edges", graph.edges)))
    return f"Write one SQL SELECT.\nTables:\n{tables}\nQuestion: {intent}" + (f"\nThe last attempt failed: {problem}" if problem else "")


def highlighted(calls: list[dict]) -> list[str]:
    """Names that a run touched: from arguments, seeds and chains."""
    found: list[str] = []
    for call in calls:
        for key in ("node_id", "file_path", "query"):
            if call["args"].get(key):
                found.append(str(call["args"][key]).rsplit("::", 1)[-1])
        result = call.get("result") or {}
        for seed in result.get("seeds", ()):
            found += [seed["name"], str(seed.get("file") or "").rsplit("/", 1)[-1]]
        for path in result.get("chain", ()):
            found += path["node_ids"]
    return [x for x in dict.fromkeys(found) if x]



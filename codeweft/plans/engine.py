"""The engine's surface: repositories, indexing, graph questions and chats over
Parquet tables in one folder."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from datetime import datetime
from typing import TypeVar
from urllib.parse import quote

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import inspect
from codeweft.operators.resolve import resolve_edges
from codeweft.operators.sync import stale_edges
from codeweft.operators.vector import Embedder, HashingEmbedder
from codeweft.plans import ingest, sessions, tracker
from codeweft.plans.agent import Answer, run_agent
from codeweft.plans.snapshots import Conflict, Manifests, every
from codeweft.plans.tools import Toolbox
from codeweft.schema import NODES, RAW_EDGES, Graph, problems
from codeweft.sources.files import read_files, repo_name, resolve_repo

T = TypeVar("T")
EVENTS = "repo_id string, seq bigint, op string, stage string, percent int, detail string, error string, at timestamp"
RESYNCS = "repo_id string, run string, batch bigint, counts map<string,bigint>, at timestamp"
VERSIONS = "repo_id string, number bigint, version string"
_LOGS = {"repos": (sessions.REPOS, "repo_id"), "chats": (sessions.CHATS, "chat_id"), "messages": (sessions.MESSAGES, "msg_id")}
_RECORDS = {"events": EVENTS, "resyncs": RESYNCS}
_GRAPH = {"nodes": NODES, "raw_edges": RAW_EDGES}
#: New files of a log that are put together with what was before them.
COMPACT_AT = 32
#: Bytes of a file of a log that is put together.
FILE_BYTES = 128 << 20
#: Times that a change is worked out again when another one came first.
TRIES = 3
#: Milliseconds after which files of a version that was never named may go.
ABANDONED = 24 * 3600 * 1000
#: Stale edges that an update lists; more are told by a flag.
LISTED = 200


def _retried(work: Callable[[], T]) -> T:
    """``work`` anew while other changes come first."""
    for _ in range(TRIES - 1):
        try:
            return work()
        except Conflict:
            pass
    return work()


class Engine:
    """Repositories, chats, messages and events are logs that are only ever
    added to: of each key the last record counts, and one that says ``gone``
    takes it away, so writers at the same time lose nothing of each other's.
    ``compact`` puts many small files of a log together.

    A repository's nodes and raw edges are files of one version. A change
    writes the next version of both and names it in one manifest, so nobody
    sees the nodes of one and the edges of another. A change that was worked
    out from a version which isn't the last any more is worked out anew. The
    version before the last stays for those who read it. Other repositories'
    files are not touched."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder or HashingEmbedder()
        self._guard, self._turns = threading.Lock(), {}

    # -- storage

    def _log_files(self, name: str) -> tuple[int, dict, dict[str, int]]:
        """The last manifest of a log, and its files that are not put together
        yet, or were by that manifest, with their sizes."""
        number, told = Manifests(self.spark, f"{self.root}/manifests/logs/{name}").last()
        fs, top = self._folder(f"logs/{name}")
        there = [s for s in fs.listStatus(top) if s.isFile()] if fs.exists(top) else []
        return number, told, {s.getPath().getName(): s.getLen() for s in there if s.getPath().getName().endswith(".parquet")}

    def _folder(self, path: str):
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return top.getFileSystem(self.spark._jsc.hadoopConfiguration()), top

    def _delete(self, *paths: str) -> None:
        for path in paths:
            fs, target = self._folder(path)
            fs.delete(target, True)

    def _records(self, name: str, told: dict, files: dict[str, int]) -> DataFrame:
        """What the last manifest put together, and the files after it."""
        schema = _RECORDS.get(name) or f"{_LOGS[name][0]}, rank bigint, gone boolean"
        paths = [f"{self.root}/logs/{name}/{part}" for part in ([told["base"]] if told else []) + sorted(set(files) - set(told.get("covers", ())))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self, name: str) -> DataFrame:
        _, told, files = self._log_files(name)
        return self._records(name, told, files)

    def _append(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        stamped = rows.withColumns({"rank": F.lit(time.time_ns()), "gone": F.lit(gone)})
        (stamped if gone else stamped.coalesce(1)).write.mode("append").parquet(f"{self.root}/logs/{name}")

    def compact(self, at_least: int = COMPACT_AT) -> list[str]:
        """Put logs together that have ``at_least`` new files; their names. A
        manifest tells at once which files that were; they go when the log is
        put together the next time, as somebody may read them now. Of what is
        gone only the key stays, for records that arrive late."""
        done = []
        for name in (*_LOGS, *_RECORDS):
            number, told, files = self._log_files(name)
            fresh = set(files) - set(told.get("covers", ()))
            if len(fresh) < at_least or not fresh:
                continue
            rows = self._records(name, told, files)
            if name in _LOGS:
                key, columns = _LOGS[name][1], rows.columns
                last = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "rank").alias("last"))
                rows = last.select(*[F.when(F.lit(c in (key, "rank", "gone")) | ~F.col("last.gone"), F.col(f"last.{c}")).alias(c) for c in columns])
            base = f"base-{uuid.uuid4().hex}"
            size = told.get("bytes", 0) + sum(files[f] for f in fresh)
            rows.coalesce(size // FILE_BYTES + 1).write.parquet(f"{self.root}/logs/{name}/{base}")
            fs, top = self._folder(f"logs/{name}/{base}")
            made = {"base": base, "before": told.get("base"), "covers": sorted(files), "bytes": fs.getContentSummary(top).getLength()}
            try:
                Manifests(self.spark, f"{self.root}/manifests/logs/{name}").add(number, made)
            except Conflict:  # somebody else has just put it together
                self._delete(f"logs/{name}/{base}")
                continue
            self._delete(*[f"logs/{name}/{f}" for f in (*told.get("covers", ()), told.get("before")) if f])
            done.append(name)
        return done

    def _manifests(self, repo_id: str) -> Manifests:
        return Manifests(self.spark, f"{self.root}/manifests/graph/{repo_id}")

    def _versions(self) -> DataFrame:
        """``repo_id, version`` of each repository that has any."""
        named = every(self.spark, f"{self.root}/manifests/graph", VERSIONS)
        return named.groupBy("repo_id").agg(F.max_by("version", "number").alias("version")).where("version IS NOT NULL")

    def _graph_rows(self, name: str, held: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.root}/{name}/{repo_id}/{version}" for repo_id, version in held]
        return self.spark.read.schema(_GRAPH[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _GRAPH[name])

    def _held(self, repo_id: str | None) -> list[tuple[str, str]]:
        if repo_id is None:
            return [(r.repo_id, r.version) for r in self._versions().collect()]  # one for each repository
        version = self._manifests(repo_id).last()[1].get("version")
        return [(repo_id, version)] if version else []

    def _own(self, repo_id: str) -> tuple[int, DataFrame, DataFrame]:
        """The number of a repository's last manifest, its nodes and its raw
        edges, both of that one version."""
        number, told = self._manifests(repo_id).last()
        held = [(repo_id, told["version"])] if told.get("version") else []
        return number, *[self._graph_rows(name, held) for name in _GRAPH]

    def table(self, name: str, repo_id: str | None = None) -> DataFrame:
        """The rows of a table as they are now; of nodes and raw edges also
        those of one repository, without reading others."""
        if name in _GRAPH:
            return self._graph_rows(name, self._held(repo_id))
        if name in _RECORDS:
            return self._log(name)
        key, log = _LOGS[name][1], self._log(name)
        columns = [c for c in log.columns if c not in ("rank", "gone")]
        last = log.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns, "gone"), "rank").alias("last"))
        return last.where("NOT last.gone").select(*[f"last.{c}" for c in columns])

    def _name(self, repo_id: str, version: str | None, after: int) -> None:
        """Make a version the one after manifest ``after``, or none. The one
        before the last goes, as do files that were never named and that nobody
        can still be writing."""
        manifests = self._manifests(repo_id)
        was = manifests.told(after) if after else {}
        manifests.add(after, {"repo_id": repo_id, "version": version, "before": was.get("version")})
        stay = {version, was.get("version")} if version else set()
        known = {was.get("version"), was.get("before")}
        for name in _GRAPH:
            fs, top = self._folder(f"{name}/{repo_id}")
            for status in fs.listStatus(top) if fs.exists(top) else []:
                part, age = status.getPath().getName(), time.time() * 1000 - status.getModificationTime()
                if part not in stay and (part in known or age > ABANDONED):
                    fs.delete(status.getPath(), True)

    def _store(self, repo_id: str, nodes: DataFrame, raw: DataFrame, after: int) -> None:
        """Write both, check the nodes' keys, and only then name them."""
        version = uuid.uuid4().hex
        try:
            for name, rows in (("nodes", nodes), ("raw_edges", raw)):
                rows.write.parquet(f"{self.root}/{name}/{repo_id}/{version}")
            found = problems(self._graph_rows("nodes", [(repo_id, version)])).limit(5).collect()
            if found:
                raise ValueError(f"nodes break the schema: {[(r.label, r.id, r.n) for r in found]}")
            self._name(repo_id, version, after)
        except Exception:
            if self._manifests(repo_id).last()[1].get("version") != version:
                self._delete(*[f"{name}/{repo_id}/{version}" for name in _GRAPH])
            raise

    def _gone(self, repo_id: str) -> None:
        """No version counts any more, whoever else is at work."""
        _retried(lambda: self._name(repo_id, None, self._manifests(repo_id).last()[0]))

    def _event(self, repo_id: str, op: str, stage: str | None = None, error: str | None = None) -> None:
        now = datetime.now()
        row = self.spark.createDataFrame([(repo_id, time.time_ns() // 1000, op, stage, None, None, error, now)], EVENTS)
        row.write.mode("append").parquet(f"{self.root}/logs/events")

    # -- repositories

    def add_repo(self, source: str, wait: bool = True) -> str:
        """The id of the repository of ``source``; indexed when it is new,
        behind the caller's back without ``wait``."""
        known = sessions.find_repo_by_source(self.table("repos"), source).first()
        if known:
            return known.repo_id
        row, ident = sessions.new_repo(self.spark, source, repo_name(source))
        self._append("repos", row)
        self._event(ident, "init")
        job = self.submit("index", ident)
        if wait:
            job.result()
        return ident

    def submit(self, kind: str, repo_id: str) -> Future:
        """Start ``index``, ``rebuild`` or ``resync`` of a repository and come
        back at once. ``index_status`` tells how far it is; ``result()`` waits,
        and raises what went wrong. Jobs of one repository run one after the
        other, those of others beside it."""
        work = {"index": self.index, "rebuild": self.rebuild, "resync": self.resync}[kind]
        self._repo(repo_id)
        done: Future = Future()

        def run() -> None:
            try:
                done.set_result(work(repo_id))
            except BaseException as problem:  # noqa: BLE001  the caller asks for it
                done.set_exception(problem)

        InheritableThread(target=run, name=f"{kind}-{repo_id}", daemon=True).start()
        return done

    def _turn(self, repo_id: str) -> threading.RLock:
        with self._guard:
            return self._turns.setdefault(repo_id, threading.RLock())

    def _repo(self, repo_id: str) -> DataFrame:
        row = self.table("repos").where(F.col("repo_id") == repo_id)
        if row.isEmpty():
            raise KeyError(repo_id)
        return row

    def _source(self, repo_id: str) -> str:
        return str(resolve_repo(self._repo(repo_id).first().source))

    def _status(self, repo_id: str, status: str, synced: datetime | None = None) -> None:
        self._append("repos", sessions.update_repo_status(self._repo(repo_id), repo_id, status, synced))

    def _tracked(self, repo_id: str, work: Callable[[], None]) -> None:
        with self._turn(repo_id):
            self._status(repo_id, "indexing")
            self._event(repo_id, "start")
            self._event(repo_id, "update", "parsing")
            try:
                work()
            except Exception as error:
                self._event(repo_id, "fail", error=str(error).split("\n")[0])
                self._status(repo_id, "error")
                raise
            self._event(repo_id, "finish")
            self._status(repo_id, "ready", sessions.utcnow())
            self.compact()

    def index(self, repo_id: str) -> None:
        """Parse everything anew."""

        def work() -> None:
            after = self._manifests(repo_id).last()[0]
            nodes, raw, _ = ingest.ingest(self.spark, self._source(repo_id), repo_id, self.embedder)
            self._event(repo_id, "complete", "parsing")
            self._store(repo_id, nodes, raw, after)

        self._tracked(repo_id, lambda: _retried(work))

    rebuild = index

    def resync(self, repo_id: str) -> dict[str, int]:
        """Parse what changed; how many files were added, changed, deleted.
        Where nothing did, the stored version stays."""
        counts: dict[str, int] = {}

        def work() -> None:
            after, *own = self._own(repo_id)
            nodes, raw, diff = ingest.ingest_changes(self.spark, self._source(repo_id), repo_id, *own, self.embedder)
            counts.clear()
            counts.update({r.status: r["count"] for r in diff.groupBy("status").count().collect()})
            self._event(repo_id, "complete", "parsing")
            if set(counts) - {"unchanged"}:
                self._store(repo_id, nodes, raw, after)

        self._tracked(repo_id, lambda: _retried(work))
        return counts

    def resync_once(self, repo_id: str, run: str, batch: int) -> dict[str, int] | None:
        """``resync`` for micro-batch ``batch`` of the stream ``run``; None if
        that batch was done for the repository already, or the repository is
        gone."""
        mine = (F.col("repo_id") == repo_id) & (F.col("run") == run) & (F.col("batch") == batch)
        with self._turn(repo_id):
            if not self._log("resyncs").where(mine).isEmpty() or self.table("repos").where(F.col("repo_id") == repo_id).isEmpty():
                return None
            counts = self.resync(repo_id)
            row = self.spark.createDataFrame([(repo_id, run, batch, counts, datetime.now())], RESYNCS)
            row.write.mode("append").parquet(f"{self.root}/logs/resyncs")
            return counts

    def resyncs(self, repo_id: str | None = None) -> DataFrame:
        """What streams of notices have done: ``repo_id, run, batch, counts, at``."""
        rows = self._log("resyncs")
        return rows if repo_id is None else rows.where(F.col("repo_id") == repo_id)

    def update_file(self, repo_id: str, file: str) -> dict:
        """One file again: ``status`` is skipped, deleted or updated, with
        counts, and edges of other files that now lead nowhere."""

        def work() -> dict:
            after, *own = self._own(repo_id)
            nodes, raw, told = ingest.update_file(self.spark, self._source(repo_id), repo_id, file, *own, self.embedder)
            if told["status"] != "skipped":
                self._store(repo_id, nodes, raw, after)
            return told

        with self._turn(repo_id):
            told = _retried(work)
        if told["status"] == "updated":
            _, nodes, raw = self._own(repo_id)
            stale = stale_edges(nodes, raw, file, repo_id).select("source", "target", "type").limit(LISTED + 1).collect()
            told |= {"stale_edges": [r.asDict() for r in stale[:LISTED]], "truncated": len(stale) > LISTED}
        return told

    def delete_repo(self, repo_id: str) -> None:
        chats = self.table("chats").where(F.col("repo_id") == repo_id)
        self._append("messages", self.table("messages").join(chats.select("chat_id"), "chat_id", "left_semi").select(*self.table("messages").columns), gone=True)
        self._append("chats", chats, gone=True)
        self._gone(repo_id)
        self._append("repos", self.table("repos").where(F.col("repo_id") == repo_id), gone=True)

    def clear(self) -> None:
        """All nodes and edges of all repositories go; repositories, chats and
        messages stay."""
        for row in self._versions().collect():  # one for each repository
            self._gone(row.repo_id)

    def list_repos(self) -> DataFrame:
        rows = tracker.with_live_status(self.table("repos"), tracker.fold(self.table("events")))
        return sessions.list_repos(rows.withColumn("dot_color", tracker.dot_color(F.col("status"))))

    def index_status(self, repo_id: str) -> DataFrame:
        """The stages of the repository's last run; without one, all done or
        all pending, by its stored status."""
        mine = self.table("events").where(F.col("repo_id") == repo_id)
        return tracker.untracked(self._repo(repo_id)) if mine.isEmpty() else tracker.fold(mine)

    # -- graph

    def graph(self, repo_id: str | None = None) -> Graph:
        held = self._held(repo_id)
        nodes = self._graph_rows("nodes", held)
        return Graph(nodes, resolve_edges(nodes, self._graph_rows("raw_edges", held)))

    def stats(self, repo_id: str) -> dict:
        return inspect.repo_stats(self.graph(repo_id), repo_id).first().asDict()

    def preview(self, repo_id: str, limit: int = 60, highlighted: list[str] = ()) -> dict:
        own = self.graph(repo_id)
        return {"nodes": [r.asDict() for r in inspect.preview_nodes(own, limit, highlighted).collect()], "edges": [r.asDict() for r in inspect.preview_edges(own, limit).collect()]}

    def query_url(self, repo_id: str, base: str = "codeweft://query") -> dict:
        """A link that holds the query of a repository's nodes."""
        self._repo(repo_id)
        sql = f"SELECT * FROM nodes WHERE repo_id = '{repo_id}' LIMIT 100"
        return {"url": f"{base}?sql={quote(sql)}", "repo_id": repo_id}

    def health(self) -> dict:
        """Whether the session runs and the folder can be read."""
        try:
            self.table("repos").isEmpty()
            store = True
        except Exception:  # noqa: BLE001  any failure means that it can't be read
            store = False
        return {"status": "online" if store else "degraded", "spark": not self.spark.sparkContext._jsc.sc().isStopped(), "store": store}

    def tools(self, repo_id: str, generate: Callable[[str], str] | None = None) -> Toolbox:
        return Toolbox(self.graph(repo_id), read_files(self.spark, self._source(repo_id), repo_id), self.embedder, generate)

    # -- chats

    def create_chat(self, repo_id: str) -> str:
        self._repo(repo_id)
        row, ident = sessions.new_chat(self.spark, repo_id)
        self._append("chats", row)
        return ident

    def _chat(self, chat_id: str) -> DataFrame:
        row = self.table("chats").where(F.col("chat_id") == chat_id)
        if row.isEmpty():
            raise KeyError(chat_id)
        return row

    def get_chat(self, chat_id: str) -> dict:
        return sessions.chats_with_repo(self._chat(chat_id), self.table("repos")).first().asDict()

    def list_chats(self, repo_id: str | None = None) -> DataFrame:
        chats = self.table("chats") if repo_id is None else self.table("chats").where(F.col("repo_id") == repo_id)
        return sessions.chats_with_repo(chats, self.table("repos")).orderBy(F.desc("created_at"), "chat_id")

    def update_chat(self, chat_id: str, title: str | None = None, repo_id: str | None = None) -> None:
        """Set the title, the repository, or both; an empty one stays."""
        chat = self._chat(chat_id)
        if title:
            chat = sessions.set_title(chat, chat_id, title)
        if repo_id:
            chat = sessions.set_repo(chat, chat_id, repo_id)
        if title or repo_id:
            self._append("chats", chat)

    def delete_chat(self, chat_id: str) -> None:
        """The chat and its messages go; an unknown one changes nothing."""
        self._append("messages", self.table("messages").where(F.col("chat_id") == chat_id), gone=True)
        self._append("chats", self.table("chats").where(F.col("chat_id") == chat_id), gone=True)

    def messages(self, chat_id: str) -> DataFrame:
        return sessions.list_messages(self.table("messages"), chat_id)

    def ask(self, chat_id: str, question: str, model: Callable[[str], str]) -> Answer:
        """Save the question, title a new chat after it, answer it and save
        the answer."""
        chat = self._chat(chat_id).first()
        self._append("messages", sessions.new_message(self.spark, chat_id, "user", question))
        if self.table("messages").where(F.col("chat_id") == chat_id).count() == 1:
            title = self.spark.createDataFrame([(question,)], "q string").select(sessions.chat_title(F.col("q"))).first()[0]
            self.update_chat(chat_id, title)
        got = run_agent(question, self.tools(chat.repo_id, model), model, chat.repo_id)
        trace = [(t["tool"], t["args"]) for t in got.trace]
        self._append("messages", sessions.new_message(self.spark, chat_id, "assistant", got.answer, "agent", trace, got.is_partial, got.highlighted_nodes))
        return got

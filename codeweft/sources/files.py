"""Source trees as tables of files."""

from __future__ import annotations

import functools
import os
import re
import shutil
import subprocess
from collections import deque
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.runtime import settled, ship

#: What is parsed, what becomes a module only, what is skipped.
PYTHON = (".py",)
SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
DOCUMENTS = (".json", ".yaml", ".yml", ".md", ".html", ".css")
SKIPPED = ("__pycache__", ".git", ".venv", "venv", "env", "node_modules", ".eggs", "build", "dist")


def is_url(source: str) -> bool:
    return source.startswith(("https://", "http://", "git@"))


def repo_name(source: str) -> str:
    """Owner and name of a URL, without the suffix ``.git``."""
    parts = [p for p in re.split(r"[/:]", re.sub(r"\.git$", "", source.rstrip("/"))) if p]
    return "_".join(parts[-2:])


def resolve_repo(source: str, into: str = "data/repos", force: bool = False) -> Path:
    """A local directory for a path or URL; a URL is cloned once, or again
    with ``force``. On a cluster ``into`` has to be a folder that the
    executors see as well: they read the files."""
    if not is_url(source):
        path = Path(source).expanduser().resolve()
        if not path.is_dir():
            raise NotADirectoryError(f"no directory at {path}")
        return path
    target = Path(into) / repo_name(source)
    if target.exists() and not force:
        return target
    if target.exists():
        shutil.rmtree(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    subprocess.run(["git", "clone", "--depth", "1", source, str(target)], check=True)
    return target


def _wanted(name: str) -> bool:
    return name.endswith((*PYTHON, *SCRIPT, *DOCUMENTS))


def _entries(folder: str) -> Iterator[tuple[str, str, bool]]:
    """``name, uri, whether a folder`` of what lies in a folder. One that is
    gone, or may not be read, has nothing in it; links to folders aren't
    followed, so no tree is endless."""
    fs, path = pafs.FileSystem.from_uri(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    try:
        infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    except PermissionError:
        return
    for info in infos:
        inside = info.type == pafs.FileType.Directory
        if (inside and not (local and os.path.islink(info.path))) or info.type == pafs.FileType.File:
            yield info.base_name, f"{folder.rstrip('/')}/{info.base_name}", inside


def _listing(folders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's share of a round: the folders it was given and those inside
    them, until ``folders`` are listed; folders that are left are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, todo = 0, deque()
        for batch in batches:
            todo.extend(zip(batch.column("file").to_pylist(), batch.column("uri").to_pylist()))
        given = len(todo)
        while todo and seen < max(folders, given):
            seen += 1
            inside, folder = todo.popleft()
            names = []
            for name, uri, is_folder in _entries(folder):
                if not is_folder and _wanted(name):
                    names.append((inside + name, uri, False))
                elif is_folder and name not in SKIPPED:
                    todo.append((f"{inside}{name}/", uri))
            yield _batch(names)
        yield _batch([(inside, folder, True) for inside, folder in todo])

    return run


def _batch(rows: list[tuple[str, str, bool]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()))], ["file", "uri", "folder"])


#: Folders that a task lists in one round before it hands the rest on.
FOLDERS = 500


def file_names(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """``file, uri`` of every source and document file under ``root``, listed
    in tasks: a round lists a frontier of folders and some levels below them,
    and what is left is the next frontier, dealt out anew. Names stay in a
    table; the driver learns the number of folders to come alone. Skipped
    directories aren't entered. Spark's own lister isn't used: it hides every
    name that begins with ``_`` or ``.``, and with them each package's
    ``__init__.py``."""
    ship(spark)
    scheme, _, rest = root.partition(":")
    if "/" in scheme or not rest or scheme == "file":
        root = str(Path(re.sub(r"^file:/*", "/", root)).absolute())
    frontier, left, found = spark.createDataFrame([("", root)], "file string, uri string"), 1, []
    while left:
        dealt = frontier.repartition(left // folders + 1)
        listed = settled(dealt.mapInArrow(_listing(folders), "file string, uri string, folder boolean"))
        found.append(listed.where("NOT folder").select("file", "uri"))
        frontier = listed.where("folder").select("file", "uri")
        left = frontier.count()
    return functools.reduce(DataFrame.unionByName, found)


def listed_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """``file_names`` in order, for trees whose names the driver can hold."""
    return [(r.file, r.uri) for r in file_names(spark, root).orderBy("file").collect()]


def read_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """``repo_id, file, file_hash, content`` of every source and document file
    under ``root``, listed and read in tasks. Full and incremental runs share
    this one listing."""
    return file_rows(file_names(spark, root), repo_id)


def file_rows(names: DataFrame, repo_id: str) -> DataFrame:
    """``repo_id, file, file_hash, content`` of the files ``names(file, uri)``."""
    parts = names.count() // 50 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, uri in zip(batch.column("file").to_pylist(), batch.column("uri").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path) as stream:
                    yield pa.RecordBatch.from_pydict({"file": [file], "content": pa.array([stream.read()], pa.binary())})

    raw = names.select("file", "uri").repartition(parts).mapInArrow(run, "file string, content binary")
    return raw.select(F.lit(repo_id).alias("repo_id"), "file", F.sha2("content", 256).alias("file_hash"), "content")


def file_content(files: DataFrame, repo_id: str, file: str) -> dict:
    """``content, file_path, lines`` or ``error`` of one file of a repository;
    only files that were listed can be asked for."""
    if file.startswith("/") or ".." in Path(file).parts:
        return {"error": "the path lies outside the repository", "file_path": file}
    row = files.where((F.col("repo_id") == repo_id) & (F.col("file") == file)).select(F.col("content").cast("string")).first()
    if row is None:
        return {"error": "no such file", "file_path": file}
    return {"content": row[0], "file_path": file, "lines": len(row[0].splitlines())}

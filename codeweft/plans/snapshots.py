"""Which version of some tables counts: one small file for each change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Manifests that stay behind the last one, for readers that listed them.
KEPT = 8


class Conflict(RuntimeError):
    """Somebody else's change was named first."""


class Manifests:
    """Files ``<folder>/<number>.json`` that appear whole or not at all, each
    number once: of two writers that saw the same last one, the second gets a
    ``Conflict`` and nothing of its change is seen. This rests on a rename that
    doesn't overwrite, which HDFS and local folders have; an object store needs
    a file system client that offers it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._top = self._hadoop.Path(self.folder)
        self._fs = self._top.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        there = self._fs.listStatus(self._top) if self._fs.exists(self._top) else []
        names = [status.getPath().getName() for status in there]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def last(self) -> tuple[int, dict]:
        """The last manifest and its number; 0 and nothing if there is none."""
        numbers = self._numbers()
        return (numbers[-1], self.told(numbers[-1])) if numbers else (0, {})

    def told(self, number: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(self._path(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, after: int, told: dict) -> int:
        """Name what follows manifest ``after``; its number."""
        fresh, draft = self._hadoop.Path(self._path(after + 1)), self._hadoop.Path(f"{self.folder}/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({**told, "number": after + 1}).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        # Only numbers that nobody can still write may go: a writer that saw
        # ``after`` long ago has to find its number taken.
        if max(self._numbers(), default=0) != after:
            self._fs.delete(draft, False)
            raise Conflict(f"{self.folder} is past {after}")
        try:
            context.rename(draft, fresh, nothing)
        except Exception as problem:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(problem):
                raise Conflict(f"{self.folder} has {after + 1} already") from problem
            raise
        for number in self._numbers()[: -KEPT - 1]:
            self._fs.delete(self._hadoop.Path(self._path(number)), False)
        return after + 1


def every(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All manifests in and below ``folder`` as rows, among them the last of
    each of its folders."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(folder)

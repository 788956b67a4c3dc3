"""Tables in the folder that driver and executors share.

An operator that reads a derived table twice, or iterates over it, writes it
here as Parquet: lineage is cut, a lost executor costs nothing that was
written, and the planner knows the table's real size, so that a join turns
into a broadcast only below ``spark.sql.autoBroadcastJoinThreshold``. A write
lets go of its shuffle files when it is done, and a table goes after its last
read (``discard``), so what lies on disk follows the step at hand and not the
number of steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``. Where that is unset, a local
    session uses its warehouse folder; a cluster has to name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside let go of their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, path: str) -> None:
    with passing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._scratch_path = path
    return held


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` returned and nothing reads again."""
    for table in tables:
        if table is not None:
            remove(table.sparkSession, table._scratch_path)


def drop_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped[key]``.

    ``dropped`` is written first, so its size is known: below the broadcast
    threshold the texts of ``docs`` do not move. Rows with a null key stay;
    of rows that share a key all go or all stay.
    """
    gone = materialise(dropped.select(dropped[key].alias("__gone_id")).distinct(), "dropped")
    return docs.join(gone, docs[key] == gone["__gone_id"], "left_anti")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are worked out once for each row: the
    optimizer copies no expression across a generator, so what uses them
    later doesn't repeat them."""
    held = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__once"))
    return held.select(*df.columns, *[F.col(f"__once.{k}").alias(k) for k in columns])

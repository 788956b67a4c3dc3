"""Getting this package to the Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at once, where the session doesn't say:
#: texts are long, and the JVM holds a batch outside its heap.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so
    that Python stages can import it wherever they run; hold batches small."""
    sc = spark.sparkContext
    if sc.getConf().get(_ROWS) is None and spark.conf.get(_ROWS) == "10000":  # nobody chose it
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if getattr(sc, "_codeweft_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # Spark serves the file from the driver, so it has to stay until the end.
    target = Path(tempfile.mkdtemp(prefix="codeweft-")) / "codeweft.zip"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._codeweft_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A
    local session without one uses its warehouse folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_writes = threading.Lock()


@contextmanager
def _passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside let go of their shuffle files when they end. Jobs write beside
    each other: the first sets the session's setting, the last puts it back."""
    with _writes:
        held = getattr(spark, "_codeweft_writes", None) or (0, spark.conf.get(_CLEANUP))
        spark._codeweft_writes = (held[0] + 1, held[1])
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writes:
            n, before = spark._codeweft_writes
            spark._codeweft_writes = (n - 1, before) if n > 1 else None
            if n == 1:
                spark.conf.set(_CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that what reads it several times
    doesn't make it anew and the planner knows its size; what was shuffled for it
    goes when it is written. The folder of an application goes when its driver
    ends."""
    spark = df.sparkSession
    top = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-settled"
    if not getattr(spark.sparkContext, "_codeweft_settled", False):
        spark.sparkContext._codeweft_settled = True
        atexit.register(_quietly, _remove, spark, top)
    path = f"{top}/{uuid.uuid4().hex}"
    with _passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _quietly(call, *args) -> None:
    try:
        call(*args)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass

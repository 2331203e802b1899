"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


#: Spark's switch for taking a step's shuffle files away as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that stand, in the order of their writing.
_written: list[str] = []
#: Seconds between two collections of the driver's heap, and when the last one was.
RELEASE_S, _released = 3.0, [0.0]
#: The same for the executors' heaps.
SHRINK_S, _shrunk = 8.0, [0.0]
#: Rows that a Python worker gets at a time where ``lean`` holds; Spark's 10,000 texts take some 30 MB and more in each process, several times over.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all of Spark is on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back; also where it stands. It goes when the process ends, or by ``remove``."""
    return write_parts([df], label)


def write_parts(parts: Iterable[DataFrame], label: str) -> tuple[DataFrame, str]:
    """``write`` of the rows of all ``parts`` (one at least) to one table, part by part: the shuffles of one are gone when the next one's come."""
    path = None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            path, schema = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", df.schema
            atexit.register(remove, spark, path)
            _written.append(path)
        with unshuffled(spark):
            df.write.mode("append").parquet(path)
        release(spark)
    return spark.read.schema(schema).parquet(path), path


@contextlib.contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go as each run ends: what the cleaner takes may stay on while the next step fills the disk."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    return write(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has the driver let go of what no plan needs any more: shuffle files and broadcasts of finished steps, and the heap that they took.

    Spark's cleaner waits for a collection of the driver's heap, which is rare while the heap is free; until then the files stay on the executors' disks.
    """
    if time.monotonic() - _released[0] < RELEASE_S:
        return
    _released[0] = time.monotonic()
    gc.collect()
    if getattr(spark.sparkContext, "_jvm", None) is not None:
        spark.sparkContext._jvm.System.gc()
        shrink(spark)


def lean(spark: SparkSession) -> None:
    """For a stage after others in the same executors: they give back what they grew by, and texts go to Python in small batches from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    _shrunk[0] = time.monotonic() - SHRINK_S
    shrink(spark)


def shrink(spark: SparkSession) -> None:
    """Has the executors collect their heaps, a task a core, which gives back what finished steps made them grow by.

    Else a heap keeps its greatest size, and Python workers and buffers outside of it need their memory besides.
    """
    if time.monotonic() - _shrunk[0] < SHRINK_S or spark.sparkContext.master.startswith("local["):
        return
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()
    _shrunk[0] = time.monotonic()


def mark() -> int:
    """A place in the order of writing, for ``sweep``."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: str) -> None:
    """Removes the tables written since ``mark`` gave ``since``, but for ``keep``: what was worked out from them must stand by itself."""
    for path in _written[since:]:
        if path != keep:
            remove(spark, path)
    _written[since:] = [keep]

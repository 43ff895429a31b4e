"""Tables in the folder that driver and executors share.

A job that needs an intermediate result more than once writes it here instead
of caching it: the files survive the loss of any executor.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .textarrays import release


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="blocksmith-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Held while a table is written: the shuffle files of a query go when it ends, and Arrow batches stay small.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Seconds between two calls of ``relieve`` that do something, and part of the JVM's largest heap from which it collects garbage.
PAUSE, SHARE = 10, 0.5
_next = [0.0]


def relieve(spark: SparkSession, now: bool = False) -> None:
    """Give memory that the driver has freed back to the system, Python's and the JVM's; takes a twentieth of the time at most.

    A long row of plans leaves the heap larger than what lives in it, and the
    allocator keeps what compiled code and its compilers have freed.
    """
    began = time.monotonic()
    if began < _next[0] and not now:
        return
    release()
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # a JVM without this command
        pass
    ended = time.monotonic()
    _next[0] = ended + max(PAUSE, 20 * (ended - began))


class Workspace:
    """Named Parquet tables under a fresh folder of the shared directory.

    Results are lazy and read these tables, so only the caller knows when they may go:
    ``clear`` deletes the folders of all workspaces made so far.
    """

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        with _settings(self.spark):
            df.write.option("compression", codec).parquet(self.path(name))
        relieve(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, keep: tuple[Workspace, ...] = ()) -> None:
    """Delete the folders of this session's workspaces but ``keep``; results that still read them can't be used any more."""
    mine = [x for x in Workspace.made if x.spark is spark and x not in keep]
    Workspace.made[:] = [x for x in Workspace.made if x not in mine]
    for work in mine:
        work.close()

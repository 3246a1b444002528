"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of intermediate tables by owner, the present owner's last; what has no owner is never released.
OWNERS: list[list[str]] = [[]]
#: Settings while an intermediate table is written: a batch for Python holds at most about so many bytes, and its
#: shuffle files go when it has ended, not when the driver happens to collect its garbage.
WRITE_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: What a Python worker remembers from one task to the next, by module: the names of cached functions.
REMEMBERED = {"pestle.llm.bpe": ("encoder",)}


class Owner:
    """Within ``with owner:`` intermediate tables belong to it, and :func:`release` deletes its tables only."""

    def __init__(self):
        self.folders: list[str] = []

    def __enter__(self) -> Owner:
        OWNERS.append(self.folders)
        return self

    def __exit__(self, *error) -> None:
        OWNERS.pop()


def shared_dir(spark: SparkSession, keep: bool = False) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir``.

    Unless ``keep`` is set, :func:`release` deletes it.

    Only where that setting is unset (local tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="pestle-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/pestle-{uuid.uuid4().hex}"
    if not keep:
        OWNERS[-1].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the present owner's intermediate tables; results that still read them must have been written."""
    folders = OWNERS[-1]
    while len(OWNERS) > 1 and folders:
        remove(spark, folders.pop())


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Within it the session has the settings ``conf``; afterwards those it had before."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back(forget: bool) -> None:
    """Return what this Python worker has freed to the system; ``forget``: and what it remembers of other tasks.

    Workers serve one stage after the other, and what they hold counts for the executor in all of them.
    """
    if forget:
        for module, names in REMEMBERED.items():
            for f in names if module in sys.modules else ():
                getattr(sys.modules[module], f).cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only GNU's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, forget: bool = True) -> Callable:
    """``run`` (for mapInArrow) in a worker that holds nothing of earlier tasks, and keeps nothing afterwards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            give_back(forget)
        try:
            yield from run(batches)
        finally:
            give_back(forget)

    return task


def trim_driver(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed of native memory to the system.

    Each of its hundreds of threads may allocate in an arena of its own, and the C library keeps what is freed there.
    JVMs that have no such command go on as they are.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        of = jvm.java.lang.Class.forName
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        types, args = array(jvm.java.lang.Class, len(names)), array(jvm.java.lang.Object, len(names))
        for i, name in enumerate(names):
            types[i] = of(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface's method, as the class behind it is not open to callers.
        invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession, keep)}/{name}"
    with settings(df.sparkSession, WRITE_CONF):
        df.write.parquet(path)
    trim_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written down, after which the owner's other intermediate tables are deleted."""
    out = written(df, name, keep=True)
    release(df.sparkSession)
    OWNERS[-1].append(out.written_to.rpartition("/")[0])
    return out


#: Logical operators whose rows come in the same order each time they are computed.
STEADY = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD"}


def steady(df: DataFrame) -> DataFrame:
    """``df`` itself where it only reads, selects and filters; anything else is written down, so that each
    reading gives the same rows in the same order."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in STEADY or not node.deterministic():
            return written(df, "steady")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

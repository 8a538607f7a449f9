"""Tables between the steps of a plan, in the folder that the driver and all executors share.

A step that several others read is written once. What reads it plans over plain columns instead of
the expressions that made them, a lost executor costs a reread, and :func:`release` frees the space;
:func:`discard` frees that of steps whose last reader is stored. The shuffle files of a write go when it ends.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Steps of one plan that are written at the same time: each holds a plan, its code and its threads in the driver.
AT_ONCE = 2
_written: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[str, int] = {}
_before: dict[str, str | None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphaxis-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the write that made them; the last of several writes puts the setting back."""
    app = spark.sparkContext.applicationId
    with _lock:
        if not _writing.get(app):
            _before[app] = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _writing[app] = _writing.get(app, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writing[app] -= 1
            if not _writing[app]:
                was = _before.pop(app)
                spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read back; a step that already is stored stays as it is."""
    if df in _paths:
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/graphaxis-step-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    _trim(spark)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: met by sorting, never gathered by the driver.

    Keys of one table are alike, so megabytes of files or shuffled rows are hundreds in memory, and
    a threshold on the former lets the latter be broadcast.
    """
    return df.hint("merge")


def all_stored(*steps: DataFrame) -> list[DataFrame]:
    """Steps that don't read each other, written together."""
    if steps:
        shared_folder(steps[0].sparkSession)  # named once, before the threads ask
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(stored, steps))


def discard(*steps: DataFrame) -> None:
    """Delete stored steps that nothing reads any more, and collect what their plans left in the driver."""
    gone = [path for step in steps if (path := _paths.pop(step, None))]
    sessions = {_written[path] for path in gone if path in _written}
    for path in gone:
        _delete(path)
    for spark in sessions:
        _collect(spark)


def settled(df: DataFrame) -> DataFrame:
    """``df`` stored, and what its plan left in the driver collected before the next is made."""
    step = stored(df)
    _collect(df.sparkSession)
    return step


def _collect(spark: SparkSession) -> None:
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> bool:
    """Return to the system what planning and compiling have freed: the driver's allocator keeps it, hundreds of MB in a query.

    False where the JVM or its allocator has no such command.
    """
    jvm = spark.sparkContext._jvm

    def array(kind: str, *items: object) -> object:
        made = spark.sparkContext._gateway.new_array(getattr(jvm.java.lang, kind), len(items))
        for i, item in enumerate(items):
            made[i] = item
        return made

    try:
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        known = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is in a closed module
        invoke = known.getMethod("invoke", array("Class", *map(jvm.java.lang.Class.forName, kinds)))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(beans, array("Object", command, "systemTrimNativeHeap", array("Object"), array("String")))
    except Py4JError:
        return False
    return True


def release() -> None:
    """Delete every step written so far; whoever calls has taken the results that read them."""
    for path in list(_written):
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session ended first: the folder's owner clears it
        return


atexit.register(release)

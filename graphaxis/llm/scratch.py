"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor then costs a
reread of a file and never a recomputation of the corpus, and nothing depends on one machine. The
shuffle files of a write go when it ends, and a table goes when its last reader has run.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session that names none (tests) gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphaxis-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, label: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and return the table read back.

    ``arrow_rows``: rows of an Arrow batch while it is written, for rows of fixed width, whose bytes
    need no measuring row by row. Settings are put back.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/graphaxis-{label}-{uuid.uuid4().hex}"
    settings = {_CLEAN: "true"} | ({_ROWS: str(arrow_rows), _BYTES: str((1 << 31) - 1)} if arrow_rows else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)):
            _delete(path)


def release() -> None:
    """Delete all tables written so far; the caller has stored every result that reads them."""
    for path in list(_written):
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session ended first: the folder's owner clears it
        return


atexit.register(release)

"""Incremental extraction: new source files become observations as they appear.

Extraction keeps no state between files, so it runs unchanged on a stream of them; a consumer
replaces a file's facts by path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.operators.extract.facts import observations
from graphaxis.sources.discovery import MAX_FILE_BYTES, generated, language

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_observations(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming table of observations of the source files below ``folder``."""
    raw = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    path = F.col("path")
    kept = raw.where(language(path).isNotNull() & ~generated(path))
    text = F.when(F.col("length") <= MAX_FILE_BYTES, F.col("content").cast("string"))
    return observations(kept.select(F.xxhash64(path).alias("ord"), path, text.alias("content")))

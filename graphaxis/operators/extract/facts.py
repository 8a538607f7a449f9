"""Extraction as an operator: source files in, typed facts and gaps out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphaxis.functions import safety
from graphaxis.operators.extract.scan import MAX_KEYS, line_starts, observe, position
from graphaxis.sources.discovery import MAX_FILE_BYTES

_SCHEMA = (
    "file_ord long, path string, nth long, status string, exact boolean, domain_kind string, keys array<string>, prefix string, suffix string, "
    "pattern_kind string, reason string, origin string, start_line int, start_column int, end_line int, end_column int"
)


def observations(files: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """One row for each observation, and one of ``status`` (``ok``, ``PARSE_FAILURE``, ``UNREADABLE``) a file.

    ``files``: ``ord``, ``path``, ``content`` (null: could not be read).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for ord, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or len(text.encode()) > MAX_FILE_BYTES:
                    rows.append((ord, path, -1, "UNREADABLE", *[None] * 12))
                    continue
                found, failed = observe(text, max_keys)
                starts = line_starts(text)
                rows.append((ord, path, -1, "PARSE_FAILURE" if failed else "ok", *[None] * 12))
                for n, o in enumerate(found):
                    d = o.domain
                    rows.append((ord, path, n, "ok", o.exact, d.kind, list(d.keys), d.prefix, d.suffix, d.pattern_kind, d.reason, d.origin, *position(starts, o.at), *position(starts, o.end)))
            table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow_schema())
            yield from table.to_batches()

    return files.select("ord", "path", "content").mapInArrow(run, _SCHEMA)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _SCHEMA.split(", "))])


def facts(observed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References with demand, dynamic lookups, and gaps; unsafe keys never appear."""
    o = observed.where("nth >= 0")
    id = F.concat(F.lit("source-file-"), (F.col("file_ord") + 1).cast("string"), F.lit("-"))
    at = [F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column")).alias("start"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("end")]
    location = F.struct(safety.safe_path(F.col("path")).alias("file"), *at)
    name = F.when(F.col("exact"), safety.environment_key(F.get("keys", F.lit(0))))
    direct = o.withColumn("name", name).where("name is not null")
    references = direct.select(
        F.concat(id, F.lit("reference-"), (F.col("nth") + 1).cast("string")).alias("id"), F.struct(F.lit("env").alias("namespace"), F.col("name")).alias("key"),
        F.lit("direct-read").alias("demand"), F.lit("read").alias("operation"), location.alias("location"), "file_ord", "nth",
    )
    rest = o.withColumn("name", name).where("not exact or name is null")
    safe_keys = F.forall("keys", lambda k: safety.environment_key(k).isNotNull()) & (F.size("keys") > 0)
    fixed = lambda c: (F.col(c) == "") | safety.environment_key(F.col(c)).isNotNull()
    stays = F.when(F.col("exact"), False).when(F.col("domain_kind") == "finite", safe_keys).when(F.col("domain_kind") == "pattern", fixed("prefix") & fixed("suffix")).otherwise(True)
    none = F.array().cast("array<string>")
    lookups = rest.withColumn("stays", stays).select(
        F.concat(id, F.lit("dynamic-"), (F.col("nth") + 1).cast("string")).alias("id"),
        F.when(F.col("stays"), F.col("domain_kind")).otherwise("unbounded").alias("kind"),
        F.when(F.col("stays"), F.col("keys")).otherwise(none).alias("keys"),
        F.when(F.col("stays") & (F.col("domain_kind") == "pattern"), F.struct(F.col("pattern_kind").alias("kind"), F.nullif("prefix", F.lit("")).alias("prefix"), F.nullif("suffix", F.lit("")).alias("suffix"))).alias("pattern"),
        F.when(~F.col("stays"), "opaque").when(F.col("domain_kind") == "unbounded", F.col("reason")).alias("reason"), "origin", location.alias("location"), "file_ord", "nth",
    )
    gaps = observed.where("nth < 0 and status <> 'ok'").select("file_ord", safety.safe_path(F.col("path")).alias("path"), F.lit("demand").alias("domain"), F.col("status").alias("reason"))
    return references, lookups, gaps

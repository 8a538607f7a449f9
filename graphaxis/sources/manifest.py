"""Workspace manifests: JSON with comments, and conflicts between repository roots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_MANIFEST_BYTES = 1 << 20


def strip_json_comments(text: str) -> str:
    """JSON without byte-order mark, comments and trailing commas; strings stay as they are."""
    text = text.removeprefix("﻿")
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            while i < n and text[i] not in "\r\n":
                i += 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise ValueError("unterminated comment")
            out.append(" ")
            i = end + 2
        else:
            if c in "]}":
                k = len(out) - 1
                while k >= 0 and not out[k].strip():
                    k -= 1
                if k >= 0 and out[k] == ",":
                    out[k] = ""
            out.append(c)
            i += 1
    return "".join(out)


def parse_manifest(text: str) -> dict:
    if len(text.encode()) > MAX_MANIFEST_BYTES:
        raise ValueError("MANIFEST_TOO_LARGE")
    return json.loads(strip_json_comments(text))


def root_conflicts(roots: DataFrame) -> DataFrame:
    """Pairs of repositories of which one root equals or contains the other.

    Ancestors are exploded and joined by equality: no range join over all pairs.
    """
    parts = F.split(F.regexp_replace("root", "/+$", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inner = roots.select(F.col("id").alias("inner_id"), F.array_join(parts, "/").alias("inner_root"), F.explode(up).alias("ancestor"))
    outer = roots.select(F.col("id").alias("outer_id"), F.array_join(parts, "/").alias("outer_root"))
    met = inner.join(outer, F.col("ancestor") == F.col("outer_root")).where("inner_id <> outer_id")
    code = F.when(F.col("inner_root") == F.col("outer_root"), "duplicate-repository-root").otherwise("ambiguous-repository-root")
    return met.where((F.col("inner_root") != F.col("outer_root")) | (F.col("inner_id") > F.col("outer_id"))).select("outer_id", "inner_id", code.alias("code"))

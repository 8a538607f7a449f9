"""Validation of dynamic lookups (C1): finite, pattern and unbounded key domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P

MAX_FINITE_KEYS = 64
_NAMES = "array<string>"


def _names(keys: Column) -> Column:
    return F.transform(keys, lambda k: k["name"])


def validate(edges: DataFrame, candidates: DataFrame, pattern_domains: DataFrame, max_finite: int = MAX_FINITE_KEYS) -> DataFrame:
    """Edges with ``kind`` after validation, ``issue``, ``expanded`` and ``likely`` key names.

    A failed edge becomes unbounded without keys; ``reason`` says why.
    """
    none = F.array().cast(_NAMES)
    e = edges.select("ord", "id", "reference_id", "scope", "origin", "pattern_constraint", "domain", F.coalesce(_names(F.col("likely_keys")), none).alias("given"))
    pattern = F.col("domain.pattern")
    p = e.where("domain.kind = 'pattern'").select("id", "scope", pattern.alias("pattern"), "pattern_constraint")
    # Destinations in reach that the pattern matches.
    known = candidates.where("destination.name is not null").select(F.col("scope").alias("b_scope"), "destination").distinct()
    same = (F.col("scope.id") == F.col("b_scope.id")) & (F.col("scope.phase") == F.col("b_scope.phase")) & (F.col("scope.channel") == F.col("b_scope.channel"))
    bound = p.join(known, same).where(P.scope_covers(F.col("b_scope"), F.col("scope")) & P.pattern_matches(F.col("pattern"), F.col("destination")))
    bound = bound.groupBy("id").agg(F.collect_set("destination.name").alias("bound"))
    # The model's domain for the pattern; different key sets conflict.
    d = pattern_domains.where("constraint = 'adapter-proven'").select(F.col("ord").alias("d_ord"), F.col("pattern_id").alias("d_pattern"), F.col("selector").alias("d_selector"), _names(F.col("keys")).alias("d_keys"))
    model = p.where("pattern_constraint = 'adapter-proven'").join(d, F.col("pattern.pattern_id") == F.col("d_pattern")).where(P.selector_covers(F.col("d_selector"), F.col("scope")))
    model = model.groupBy("id").agg(F.min_by("d_keys", "d_ord").alias("model"), F.count_distinct(F.to_json(F.array_sort(F.array_distinct("d_keys")))).alias("n_models"))
    v = e.join(bound, "id", "left").join(model, "id", "left")
    keys, given, likely = F.col("domain.keys"), F.col("given"), F.array_sort(F.array_distinct(F.concat(F.coalesce("bound", none), F.coalesce("model", none))))
    repeats = lambda x: F.size(F.array_distinct(x)) != F.size(x)
    text = lambda part: F.coalesce(F.length(pattern[part]) > 0, F.lit(False))
    valid = F.when(pattern["kind"] == "prefix", text("prefix")).when(pattern["kind"] == "suffix", text("suffix")).when(pattern["kind"] == "surrounded", text("prefix") & text("suffix")).otherwise(False)
    stray = F.exists(F.coalesce("model", none), lambda k: ~P.pattern_matches(pattern, F.struct(F.lit("env").alias("namespace"), k.alias("name"))))
    mismatch = repeats(F.coalesce("model", none)) | stray | repeats(given) | (F.size(F.array_except(given, likely)) > 0)
    kind = F.col("domain.kind")
    finite = F.when(F.size(keys) > max_finite, "DYNAMIC_OVER_BUDGET").when(repeats(keys), "DYNAMIC_FINITE_DUPLICATE").when(
        repeats(given) | (F.array_sort(given) != F.array_sort(keys)), "DYNAMIC_FINITE_LIKELY_MISMATCH"
    )
    patterned = F.when(~valid, "DYNAMIC_PATTERN_INVALID").when(F.col("n_models") > 1, "DYNAMIC_PATTERN_DOMAIN_CONFLICT").when(mismatch, "DYNAMIC_PATTERN_CANDIDATE_MISMATCH").when(F.size(likely) > max_finite, "DYNAMIC_OVER_BUDGET")
    issue = F.when(kind == "finite", finite).when(kind == "pattern", patterned).when(F.size(given) > 0, "DYNAMIC_UNBOUNDED_HAS_KEYS")
    v = v.withColumn("issue", issue).withColumn("kind", F.when(F.col("issue").isNotNull(), "unbounded").otherwise(kind))
    proven = (F.col("pattern_constraint") == "adapter-proven") & F.col("model").isNotNull()
    expanded = F.when(F.col("kind") == "finite", keys).when((F.col("kind") == "pattern") & proven, F.array_distinct("model")).otherwise(none)
    reason = F.when(F.col("issue") == "DYNAMIC_OVER_BUDGET", "over-budget").when(F.col("issue").isNotNull(), "opaque").otherwise(F.col("domain.reason"))
    return v.select(
        "ord", "id", "reference_id", "scope", "origin", "issue", "kind", reason.alias("reason"), expanded.alias("expanded"),
        F.when(F.col("kind") == "finite", given).when(F.col("kind") == "pattern", likely).otherwise(none).alias("likely"),
    )

"""Coverage gaps against scopes and keys, without a nested loop over the gaps that name units.

Gaps that list execution units are exploded and meet scopes by an equi-join on the unit. The others
(wildcards) meet every scope; they are broadcast while few, and joined on phase otherwise, each
wildcard gap being spread over the phases that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P

#: So many wildcard gaps may be broadcast.
BROADCAST_GAPS = 5_000


def affecting(rows: DataFrame, gaps: DataFrame, id: str, key: bool) -> DataFrame:
    """J9 (``key`` false) and J10: pairs of ``id`` and gap, for ``rows`` of ``id``, ``scope``, ``key``."""
    g = gaps.select(F.col("ord").alias("gap_ord"), F.col("id").alias("gap_id"), F.col("potentially_affects").alias("selector"), "key_domain")
    units = F.col("selector.execution_unit_ids")
    named = g.where(units.isNotNull()).withColumn("unit", F.explode(F.array_distinct(units)))
    wild = g.where(units.isNull())
    matches = P.selector_may_affect(F.col("selector"), F.col("scope"))
    if key:
        matches = matches & P.gap_affects_key(F.col("key_domain"), F.col("key"))
    columns = [id, "gap_ord", "gap_id"]
    by_unit = rows.join(named, F.col("scope.id") == F.col("unit")).where(matches).select(columns)
    if wild.limit(BROADCAST_GAPS + 1).count() <= BROADCAST_GAPS:
        met = rows.join(F.broadcast(wild), matches)
    else:
        phases = rows.select(F.col("scope.phase").alias("p")).distinct()
        spread = wild.join(F.broadcast(phases), F.col("selector.phases").isNull() | F.array_contains("selector.phases", F.col("p")))  # phases are a closed vocabulary
        met = rows.join(spread, F.col("scope.phase") == F.col("p")).where(matches)
    return by_unit.unionByName(met.select(columns))


def gap_ids(pairs: DataFrame, id: str) -> DataFrame:
    """Per ``id`` the distinct gap ids in declared order."""
    ordered = F.array_sort(F.collect_set(F.struct("gap_ord", "gap_id")))
    return pairs.groupBy(id).agg(F.array_distinct(F.transform(ordered, lambda x: x["gap_id"])).alias("gap_ids"))


def scopes_of(parts: list[DataFrame]) -> DataFrame:
    """A2: distinct scopes of ``parts`` (each ``scope`` and ``ord``), in the order of the parts.

    A scope with an unknown part is nobody's equal and stays a row of its own.
    """
    rows = None
    for rank, part in enumerate(parts):
        one = part.select(F.col("scope"), F.lit(rank).alias("part"), F.col("ord").cast("long").alias("ord"))
        rows = one if rows is None else rows.unionByName(one)
    # Hashed first: few scopes are left to be keyed and sorted.
    known = F.coalesce(P.known_scope(F.col("scope")) & (F.col("scope.stage.kind") != "unknown"), F.lit(False))
    rows = rows.groupBy("scope", "part", F.when(~known, F.col("ord")).alias("own")).agg(F.min("ord").alias("ord"))
    text = F.to_json(F.struct("part", "ord", "scope"))
    keyed = rows.withColumn("scope_id", F.coalesce(P.scope_key(F.col("scope")), F.concat(F.lit("unknown:"), text)))
    return keyed.groupBy("scope_id").agg(F.min_by("scope", F.struct("part", "ord")).alias("scope"), F.min(F.struct("part", "ord")).alias("seen"))


def scope_coverage(scopes: DataFrame, gaps: DataFrame) -> DataFrame:
    """``scope_id``, ``scope``, ``state``, ``gap_ids``."""
    found = gap_ids(affecting(scopes.select("scope_id", "scope"), gaps, "scope_id", False), "scope_id")
    state = F.when(F.col("gap_ids").isNull(), "complete").otherwise("incomplete")
    none = F.array().cast("array<string>")
    return scopes.join(found, "scope_id", "left").select("scope_id", "scope", state.alias("state"), F.coalesce("gap_ids", none).alias("gap_ids"))


def strong_scopes(scopes: DataFrame, closed: DataFrame, inputs: DataFrame, inventory: DataFrame) -> DataFrame:
    """The ``scope_id`` of scopes about which a closed model lets "missing" be final.

    Relational division: of a covering closed scope every expected input must have a complete,
    covering observation, every authority a snapshot, and no allowed mechanism may reach the scope.
    """
    if closed.isEmpty():  # the plan below is the largest of all, and would be made to find no scope
        return scopes.select("scope_id").where(F.lit(False))
    c = closed.where("closed").withColumn("closed_id", F.xxhash64(F.to_json(F.struct("*")))).where(
        (F.size("approved_roots") > 0) & (F.size("binding_roots") > 0) & (F.size("expected_inputs") > 0) & (F.size("authorities") > 0) & (F.col("outside_root_imports") == "out-of-scope")
    )
    units = F.coalesce(F.col("selector.execution_unit_ids"), F.array(F.lit("*")))
    spread = c.withColumn("unit", F.explode(units))
    s = scopes.select("scope_id", "scope").withColumn("unit", F.explode(F.array(F.col("scope.id"), F.lit("*"))))
    pairs = s.join(spread, "unit").where(P.selector_covers(F.col("selector"), F.col("scope"))).dropDuplicates(["scope_id", "closed_id"])
    reached = F.exists("mechanisms", lambda m: P.selector_may_affect(m, F.col("scope")))
    pairs = pairs.where(~F.coalesce(reached, F.lit(False))).select("scope_id", "scope", "closed_id", "expected_inputs", "authorities")
    need = pairs.select("scope_id", "scope", "closed_id", F.explode("expected_inputs").alias("x"))
    seen = inputs.where("state = 'complete'").select("input_id", "domain", F.col("selector").alias("observed"))
    hit = need.join(seen, (F.col("x.input_id") == F.col("input_id")) & (F.col("x.domain") == F.col("domain"))).where(P.selector_covers(F.col("observed"), F.col("scope")))
    hit = hit.select("scope_id", "closed_id", "x").distinct().withColumn("hit", F.lit(1))
    inputs_done = need.select("scope_id", "closed_id", "x").distinct().join(hit, ["scope_id", "closed_id", "x"], "left").groupBy("scope_id", "closed_id").agg(F.min(F.coalesce("hit", F.lit(0))).alias("ok"))
    asked = pairs.select("scope_id", "closed_id", F.explode("authorities").alias("a")).select("scope_id", "closed_id", "a.authority_id", F.col("a.inventory_input_id").alias("input_id"))
    held = inventory.select("authority_id", "input_id").where("input_id is not null").distinct().withColumn("held", F.lit(1))
    authorities = asked.join(held, ["authority_id", "input_id"], "left").groupBy("scope_id", "closed_id").agg(F.min(F.coalesce("held", F.lit(0))).alias("listed"))
    return inputs_done.join(authorities, ["scope_id", "closed_id"]).where("ok = 1 and listed = 1").select("scope_id").distinct()

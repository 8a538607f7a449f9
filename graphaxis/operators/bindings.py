"""Binding resolution as relations: slots, condition partitions, precedence winners.

``partitions`` has a row for each partition of a slot, ``selections`` one for each partition and
candidate. A slot is the candidates of one scope and destination; where an opaque part makes those
equal to nothing, a candidate is a slot of its own. Everything is grouped by partial aggregates and
equi-joins on the slot, so a crowded slot needs no task that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P
from graphaxis.plans.store import large, stored

#: More assignments of conditions than this are not enumerated.
MAX_ASSIGNMENTS = 256


@dataclass
class Resolved:
    partitions: DataFrame
    selections: DataFrame
    steps: tuple[DataFrame, ...] = ()  # stored, read by both


def slot_key(scope: Column, destination: Column, ord: Column) -> Column:
    """A3."""
    known = F.to_json(F.array(P.scope_key(scope), destination["namespace"], destination["name"]))
    opaque = P.scope_key(scope).isNull() | destination["name"].isNull()
    return F.when(opaque, F.concat(F.lit("opaque:"), ord.cast("string"))).otherwise(known)


def assignments(domains: Column) -> Column:
    """Every choice of one value or "another" (null) for each domain of (key, values)."""
    none = F.array(F.array()).cast("array<array<struct<key:string,value:string,values:array<string>>>>")

    def widen(done: Column, domain: Column) -> Column:
        choices = F.concat(domain["values"], F.array(F.lit(None).cast("string")))
        pick = lambda a: F.transform(choices, lambda v: F.concat(a, F.array(F.struct(domain["key"].alias("key"), v.alias("value"), domain["values"].alias("values")))))
        return F.flatten(F.transform(done, pick))

    return F.aggregate(domains, none, widen)


def assignment_condition(assignment: Column) -> Column:
    """The condition that says an assignment."""
    def clause(key: Column, operator: str, value: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(operator).alias("operator"), value.alias("value"))

    def say(x: Column) -> Column:
        others = F.transform(x["values"], lambda v: clause(x["key"], "not-equals", v))
        return F.when(x["value"].isNotNull(), F.array(clause(x["key"], "equals", x["value"]))).otherwise(others)

    clauses = F.flatten(F.transform(assignment, say))
    return F.struct(F.when(F.size(clauses) == 0, "always").otherwise("all").alias("kind"), clauses.alias("clauses"))


def condition_matches(condition: Column, assignment: Column) -> Column:
    """Does a condition hold under an assignment?"""
    def holds(clause: Column) -> Column:
        taken = F.get(F.filter(assignment, lambda x: x["key"] == clause["key"]), F.lit(0))["value"]
        same = F.coalesce(taken == clause["value"], F.lit(False))
        return F.when(clause["operator"] == "equals", same).otherwise(~same)

    return F.when(condition["kind"] == "always", True).when(condition["kind"] == "unknown", False).otherwise(F.forall(condition["clauses"], holds))


def conditions_cover_all(conditions: Column) -> Column:
    """U8: is some condition true under every assignment? False beyond the limit."""
    clauses = F.flatten(F.transform(F.filter(conditions, lambda c: c["kind"] == "all"), lambda c: c["clauses"]))
    keys = F.array_sort(F.array_distinct(F.transform(clauses, lambda c: c["key"])))
    values = lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(clauses, lambda c: c["key"] == k), lambda c: c["value"])))
    domains = F.transform(keys, lambda k: F.struct(k.alias("key"), values(k).alias("values")))
    many = F.aggregate(domains, F.lit(1.0), lambda n, d: n * (F.size(d["values"]) + 1)) > MAX_ASSIGNMENTS
    every = F.forall(assignments(domains), lambda a: F.exists(conditions, lambda c: condition_matches(c, a)))
    return F.when(F.exists(conditions, lambda c: c["kind"] == "unknown") | many, False).otherwise(every)


def precedence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """W1 for each group of ``keys`` over its applicable rows: ``outcome`` and ``top`` rank.

    A lone candidate wins whatever its rank; one without a comparable rank, or a tie at the top,
    makes all conflicting; a dynamic candidate, or none, leaves the group unresolved.
    """
    flagged = rows.withColumn("bad", (~F.col("comparable") | F.col("rank").isNull()).cast("int")).withColumn("dyn", (F.col("resolution") == "dynamic").cast("int"))
    by_rank = flagged.groupBy(*keys, "rank").agg(F.sum(F.col("applicable").cast("int")).alias("n"), F.max(F.when(F.col("applicable"), F.col("bad"))).alias("bad"), F.max(F.when(F.col("applicable"), F.col("dyn"))).alias("dyn"))
    live = F.col("n") > 0
    group = by_rank.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("bad").alias("bad"),
        F.max("dyn").alias("dyn"),
        F.max(F.when(live, F.col("rank"))).alias("top"),
        F.max_by(F.when(live, F.col("n")), F.when(live, F.col("rank"))).alias("n_top"),
    )
    outcome = (
        F.when((F.col("n") == 0) | (F.col("dyn") == 1), "unresolved")
        .when(F.col("n") == 1, "effective")
        .when((F.col("bad") == 1) | (F.col("n_top") > 1), "conflicting")
        .otherwise("effective")
    )
    return group.select(*keys, "top", F.col("n").alias("n_applicable"), outcome.alias("outcome"))


def selection_status() -> Column:
    alone_or_top = (F.col("n_applicable") == 1) | (F.col("rank") == F.col("top"))
    return (
        F.when(~F.col("applicable"), "inapplicable")
        .when(F.col("outcome") != "effective", F.col("outcome"))
        .when(F.coalesce(alone_or_top, F.lit(False)), "effective")
        .otherwise("shadowed")
    )


def resolve(candidates: DataFrame) -> Resolved:
    """All slots of ``candidates`` (schema ``CANDIDATE``)."""
    c = candidates.withColumn("slot", slot_key(F.col("scope"), F.col("destination"), F.col("ord")))
    c = c.withColumn("dims", P.dimensions_key(F.col("applies_when")))
    c = stored(c.select("slot", "ord", "id", "scope", "destination", "applies_when", "dims", "rank", "comparable", "resolution"))
    condition = F.col("applies_when.condition")
    slots = c.groupBy("slot").agg(
        F.min_by("scope", "ord").alias("scope"),
        F.min_by("destination", "ord").alias("destination"),
        F.min_by("applies_when", "ord").alias("first"),
        (F.min("dims") == F.max("dims")).alias("one_shape"),
        F.max((condition["kind"] == "unknown").cast("int")).alias("unknown"),
    )
    clauses = c.where(condition["kind"] == "all").select("slot", F.explode(condition["clauses"]).alias("x")).select("slot", "x.key", "x.value").distinct()
    counted = clauses.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list("value")).alias("values"))
    domains = counted.groupBy("slot").agg(F.exp(F.sum(F.log(F.col("k") + 1.0))).alias("size"), F.array_sort(F.collect_list(F.struct("key", "values"))).alias("domains"))
    known = slots.join(large(domains), "slot", "left").withColumn("finite", F.col("one_shape") & (F.col("unknown") == 0) & (F.coalesce("size", F.lit(1.0)) <= MAX_ASSIGNMENTS + 0.5))
    known = stored(known)
    slim = c.select("slot", F.col("id").alias("candidate_id"), "rank", "comparable", "resolution", "applies_when", "ord")
    a = _finite(known.where("finite"), slim)
    if known.where(~F.col("finite")).isEmpty():  # else every candidate is shuffled again to meet nothing
        return Resolved(a.partitions, a.selections, (c, known))
    b = _grouped(known.where(~F.col("finite")), slim)
    return Resolved(a.partitions.unionByName(b.partitions), a.selections.unionByName(b.selections), (c, known))


def _with_condition(selector: Column, condition: Column) -> Column:
    kept = [selector[k].alias(k) for k in ("execution_unit_ids", "phases", "stage", "channels")]
    return F.struct(*kept, condition.alias("condition"))


def _finish(parts: DataFrame, rows: DataFrame, outcome: DataFrame, finite: bool) -> Resolved:
    partitions = parts.join(large(outcome.select("slot", "part", "outcome")), ["slot", "part"])
    selections = rows.join(large(outcome), ["slot", "part"]).select("slot", "part", "candidate_id", selection_status().alias("status"))
    columns = ["slot", "part", "scope", "destination", "applies_when", "outcome"]
    return Resolved(partitions.select(*columns, F.lit(finite).alias("finite")), selections)


def _finite(known: DataFrame, slim: DataFrame) -> Resolved:
    """C2, finite mode: one partition for each assignment of the slot's conditions."""
    none = F.array().cast("array<struct<key:string,values:array<string>>>")
    parts = known.select("slot", "scope", "destination", "first", F.posexplode(assignments(F.coalesce("domains", none))).alias("part", "assignment"))
    parts = parts.withColumn("applies_when", _with_condition(F.col("first"), assignment_condition(F.col("assignment"))))
    rows = parts.select("slot", "part", "assignment").join(large(slim), "slot").withColumn("applicable", condition_matches(F.col("applies_when.condition"), F.col("assignment")))
    return _finish(parts, rows, precedence(rows, ["slot", "part"]), True)


def _grouped(known: DataFrame, slim: DataFrame) -> Resolved:
    """C2, selector groups (A4): equal selectors form a partition; any overlap leaves it open."""
    rows = known.select("slot", "scope", "destination").join(large(slim), "slot").withColumn("selector", P.selector_key(F.col("applies_when")))
    groups = rows.groupBy("slot", "selector").agg(F.min("ord").alias("at"), F.min_by("applies_when", "ord").alias("applies_when"), F.first("scope").alias("scope"), F.first("destination").alias("destination"))
    groups = groups.withColumn("part", F.row_number().over(W.partitionBy("slot").orderBy("at")) - 1)
    other = groups.select("slot", F.col("selector").alias("other"), F.col("applies_when").alias("theirs"))
    met = groups.join(large(other), "slot").where((F.col("selector") != F.col("other")) & P.selectors_overlap(F.col("theirs"), F.col("applies_when")))
    open_ended = met.select("slot", "part").distinct().withColumn("open", F.lit(True))
    members = rows.join(large(groups.select("slot", "selector", "part")), ["slot", "selector"]).withColumn("applicable", F.lit(True))
    outcome = precedence(members, ["slot", "part"]).join(large(open_ended), ["slot", "part"], "left").join(large(groups.select("slot", "part", F.col("applies_when.condition.kind").alias("kind"))), ["slot", "part"])
    outcome = outcome.withColumn("outcome", F.when(F.col("open").isNotNull() | (F.col("kind") == "unknown"), "unresolved").otherwise(F.col("outcome")))
    every = groups.select("slot", "part", F.col("selector").alias("own")).join(large(rows), "slot").withColumn("applicable", F.col("selector") == F.col("own"))
    return _finish(groups, every, outcome.select("slot", "part", "top", "n_applicable", "outcome"), False)


def status_for(wanted: DataFrame, partitions: DataFrame, id: str = "demand_id") -> DataFrame:
    """C3 for each row of ``wanted`` (``id``, ``scope``, ``key``): effective, conflicting, unresolved.

    Rows that no resolution covers are absent: their status is none.
    """
    p = partitions.select("slot", "part", F.col("scope").alias("r_scope"), F.col("destination").alias("r_key"), "applies_when", "outcome", "finite")
    w = wanted.select(id, "scope", "key")
    on = (
        (F.col("key.namespace") == F.col("r_key.namespace")) & (F.col("key.name") == F.col("r_key.name")) & (F.col("scope.id") == F.col("r_scope.id"))
        & (F.col("scope.phase") == F.col("r_scope.phase")) & (F.col("scope.channel") == F.col("r_scope.channel"))
    )
    met = w.join(large(p), on).where(P.scope_covers(F.col("r_scope"), F.col("scope")) & P.selector_may_affect(F.col("applies_when"), F.col("scope")))
    covers = P.selector_covers_strict(F.col("applies_when"), F.col("scope"))
    met = met.withColumn("covers", covers)
    relevant = F.col("covers")
    per_slot = met.groupBy(id, "slot").agg(
        F.max((~relevant).cast("int")).alias("partial"),
        F.max((relevant & (F.col("outcome") == "conflicting")).cast("int")).alias("conflicting"),
        F.max((relevant & (F.col("outcome") == "unresolved")).cast("int")).alias("unresolved"),
        F.max((relevant & (F.col("outcome") == "effective")).cast("int")).alias("effective"),
        F.max(F.col("finite").cast("int")).alias("finite"),
        F.collect_set(F.when(relevant & ~F.col("finite"), F.to_json("applies_when.condition"))).alias("conditions"),
    )
    said = F.transform("conditions", lambda c: F.from_json(c, "struct<kind:string,clauses:array<struct<key:string,operator:string,value:string>>>"))
    whole = F.when(F.col("finite") == 1, True).otherwise(conditions_cover_all(said))
    settled = (F.col("effective") == 1) & (F.col("conflicting") == 0) & (F.col("unresolved") == 0) & whole
    per_slot = per_slot.withColumn("settled", settled.cast("int")).withColumn("open", ((F.col("partial") == 1) | (F.col("unresolved") == 1) | ((F.col("effective") == 1) & ~settled)).cast("int"))
    total = per_slot.groupBy(id).agg(F.max("settled").alias("settled"), F.max("conflicting").alias("conflicting"), F.max("open").alias("open"))
    status = F.when(F.col("settled") == 1, "effective").when(F.col("conflicting") == 1, "conflicting").when(F.col("open") == 1, "unresolved").otherwise("none")
    return total.select(id, status.alias("status"))

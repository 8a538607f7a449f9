"""Reconciliation of demand, bindings and inventory into records with explicit uncertainty.

One declarative plan over all scopes at once: equi-joins on key, scope and resource with covering
predicates as residuals, partial aggregates for "any" and "first", and ordered CASE expressions for
each axis. Nothing is ever dropped by a limit: what is not known makes a record inconclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P
from graphaxis.operators import bindings, coverage, dynamics
from graphaxis.plans import schemas
from graphaxis.plans.store import all_stored, discard, large, stored

NONE = "array<string>"
DEMAND_RANK = {"present": 3, "finite-dynamic": 2, "pattern-dynamic": 1}
TARGET_RANK = {"deployable": 4, "consumer-derived": 3, "external-consumer-possible": 2, "internal-only": 1, "unknown-target": 0}


@dataclass
class Facts:
    """One table of each kind (``plans.schemas.FACTS``)."""

    references: DataFrame
    demand_edges: DataFrame
    dynamic_edges: DataFrame
    candidates: DataFrame
    inventory: DataFrame
    gaps: DataFrame
    inputs: DataFrame
    closed_scopes: DataFrame
    pattern_domains: DataFrame
    target_statuses: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **given: DataFrame) -> Facts:
        """The tables given, and empty ones for the rest."""
        return cls(**{f.name: given.get(f.name, spark.createDataFrame([], schemas.FACTS[f.name])) for f in fields(cls)})


#: Facts that demand, scopes and bindings read.
STORED = ("references", "demand_edges", "dynamic_edges", "candidates", "inventory", "gaps")


class Records:
    """The tables of records and the steps they share; each is made when it is first asked for.

    A report that reads no bindings resolves none, and one that reads no demand merges none.
    """

    def __init__(self, facts: Facts, max_finite: int = dynamics.MAX_FINITE_KEYS, resolved: bindings.Resolved | None = None):
        self._given, self._max_finite, self._known = facts, max_finite, resolved

    def _facts(self, *names: str) -> Facts:
        """The facts, those named stored: each feeds several joins."""
        kept = all_stored(*(getattr(self._given, n) for n in names))
        self._given = replace(self._given, **dict(zip(names, kept)))
        return self._given

    @cached_property
    def _dynamic(self) -> DataFrame:
        f = self._facts("candidates", "dynamic_edges")
        return stored(dynamics.validate(f.dynamic_edges, f.candidates, f.pattern_domains, self._max_finite))

    @cached_property
    def _wanted(self) -> DataFrame:
        return stored(demands(self._facts("references", "demand_edges"), self._dynamic))

    @cached_property
    def _resolved(self) -> bindings.Resolved:
        if self._known is not None:
            return bindings.Resolved(*all_stored(self._known.partitions, self._known.selections))
        return _settled(self._facts("candidates").candidates)

    @cached_property
    def scopes(self) -> DataFrame:
        f = self._facts(*STORED)
        listed = f.inventory.select(F.explode("declared_scopes").alias("scope"), F.struct("snapshot_ord", "ord").alias("at"))
        scopes = coverage.scopes_of([
            self._wanted.select("scope", F.col("o.ord").alias("ord")), self._dynamic.select("scope", "ord"), f.candidates.select("scope", "ord"),
            f.target_statuses.select("scope", "ord"), listed.select("scope", F.col("at.ord").alias("ord")),
        ])
        return stored(coverage.scope_coverage(scopes, f.gaps))

    @cached_property
    def demand(self) -> DataFrame:
        f = self._facts(*STORED)
        return demand_records(f, self._wanted, self._resolved, self._dynamic)

    def demand_of(self, namespace: str, name: str) -> DataFrame:
        """The demand records of one key: slots and demands hold one key each, so that no other meets them."""
        f = self._facts(*STORED)
        own = stored(f.candidates.where(_is("destination", namespace, name)))
        resolved = self._resolved if self._known is not None else _settled(own)
        return demand_records(replace(f, candidates=own), stored(demands(f, self._dynamic, (namespace, name))), resolved, self._dynamic)

    @cached_property
    def demand_coverage(self) -> DataFrame:
        """The coverage of all demand, which hangs on its gaps alone."""
        f = self._facts(*STORED)
        return with_coverage(self._wanted.select("demand_id"), demand_gaps(f, self._wanted)).select("coverage")

    @cached_property
    def inventory(self) -> DataFrame:
        f = self._facts(*STORED)
        return inventory_records(f, self._wanted, self._resolved, self._dynamic)

    @cached_property
    def dynamic(self) -> DataFrame:
        f = self._facts("candidates", "dynamic_edges", "gaps")
        scopes = coverage.scopes_of([self._dynamic.select("scope", "ord")])
        return dynamic_records(f, self._dynamic, stored(coverage.scope_coverage(scopes, f.gaps)))

    def union(self) -> DataFrame:
        """All records in one table."""
        return self.demand.unionByName(self.inventory, True).unionByName(self.dynamic, True)


def _ranked(value: Column, ranks: dict[str, int]) -> Column:
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), lambda k, _: k == value)), F.lit(0))


def _unranked(rank: Column, ranks: dict[str, int]) -> Column:
    back = None
    for name, n in ranks.items():
        back = F.when(rank == n, name) if back is None else back.when(rank == n, name)
    return back


def _is(key: str, namespace: str, name: str) -> Column:
    return (F.col(f"{key}.namespace") == namespace) & (F.col(f"{key}.name") == name)


def demands(facts: Facts, dynamic: DataFrame, of: tuple[str, str] | None = None) -> DataFrame:
    """Demands merged by scope and key (those of one key, if given); opaque ones stay apart."""
    refs = facts.references.where("demand in ('direct-read', 'eager-validation') and key.name is not null").select(F.col("id").alias("reference_id"), "key")
    direct = facts.demand_edges.join(large(refs), "reference_id").select(
        F.struct(F.lit(0).alias("part"), "ord", F.lit(0).alias("pos")).alias("o"), "scope", "key", F.lit("present").alias("demand"), "reference_id",
        F.when(F.col("origin") == "consumer-derived", "consumer-derived").otherwise("deployable").alias("target"),
    )
    keys = F.when(F.size("expanded") > 0, F.col("expanded")).otherwise(F.col("likely"))
    lookups = dynamic.where("kind <> 'unbounded'").select("ord", "scope", "reference_id", "kind", F.posexplode(keys).alias("pos", "name")).where("name is not null").select(
        F.struct(F.lit(1).alias("part"), "ord", "pos").alias("o"), "scope", F.struct(F.lit("env").alias("namespace"), F.col("name")).alias("key"),
        F.concat("kind", F.lit("-dynamic")).alias("demand"), "reference_id", F.lit("unknown-target").alias("target"),
    )
    rows = direct.unionByName(lookups)
    if of is not None:  # demands that merge have one key
        rows = rows.where(_is("key", *of))
    known = F.to_json(F.array(P.scope_key(F.col("scope")), F.col("key.namespace"), F.col("key.name")))
    rows = rows.withColumn("demand_id", F.when(P.scope_key(F.col("scope")).isNotNull(), known).otherwise(F.concat(F.lit("opaque:"), F.to_json("o"))))
    merged = rows.groupBy("demand_id").agg(
        F.min("o").alias("o"),
        F.min_by("scope", "o").alias("scope"),
        F.min_by("key", "o").alias("key"),
        F.max(_ranked(F.col("demand"), DEMAND_RANK)).alias("d"),
        F.max(_ranked(F.col("target"), TARGET_RANK)).alias("t"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o", "reference_id"))), lambda x: x["reference_id"])).alias("reference_ids"),
    )
    return merged.select("demand_id", "o", "scope", "key", _unranked(F.col("d"), DEMAND_RANK).alias("demand"), _unranked(F.col("t"), TARGET_RANK).alias("target"), "reference_ids")


def _same_slot(scope: str, key: str, other_scope: str, other_key: str) -> Column:
    c = F.col
    return (
        (c(f"{key}.namespace") == c(f"{other_key}.namespace")) & (c(f"{key}.name") == c(f"{other_key}.name")) & (c(f"{scope}.id") == c(f"{other_scope}.id"))
        & (c(f"{scope}.phase") == c(f"{other_scope}.phase")) & (c(f"{scope}.channel") == c(f"{other_scope}.channel"))
    )


def effective_selections(resolved: bindings.Resolved) -> DataFrame:
    """The winner of each effective partition, with what it applies to."""
    parts = resolved.partitions.where("outcome = 'effective'").select("slot", "part", F.col("scope").alias("r_scope"), F.col("destination").alias("r_key"), "applies_when")
    return parts.join(large(resolved.selections.where("status = 'effective'").select("slot", "part", "candidate_id")), ["slot", "part"])


def effective_for(wanted: DataFrame, winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per demand the number of distinct exact winners, their ids, and a lone winner."""
    met = wanted.select("demand_id", "scope", "key").join(large(winners), _same_slot("scope", "key", "r_scope", "r_key"))
    met = met.where(P.scope_covers(F.col("r_scope"), F.col("scope")) & P.selector_covers(F.col("applies_when"), F.col("scope")))
    exact = candidates.where("resolution = 'exact'").select(F.col("id").alias("candidate_id"), "resource", F.col("ord").alias("c_ord"))
    met = met.select("demand_id", "candidate_id").distinct().join(large(exact), "candidate_id")
    return met.groupBy("demand_id").agg(
        F.count(F.lit(1)).alias("n_effective"),
        F.transform(F.array_sort(F.collect_list(F.struct("c_ord", "candidate_id"))), lambda x: x["candidate_id"]).alias("candidate_ids"),
        F.min_by("resource", "c_ord").alias("resource"),
    )


def uncertain_ids(rows: DataFrame, dynamic: DataFrame, id: str) -> DataFrame:
    """Rows whose scope an unbounded lookup covers; environment keys only."""
    open_ended = dynamic.where("kind = 'unbounded'").select(F.col("scope").alias("u_scope")).distinct()
    same = (F.col("scope.id") == F.col("u_scope.id")) & (F.col("scope.phase") == F.col("u_scope.phase")) & (F.col("scope.channel") == F.col("u_scope.channel"))
    met = rows.where("key.namespace = 'env'").select(id, "scope").join(open_ended, same).where(P.scope_covers(F.col("u_scope"), F.col("scope")))
    return met.select(id).distinct().withColumn("uncertain", F.lit(True))


def with_target(rows: DataFrame, statuses: DataFrame, fallback: Column) -> DataFrame:
    """The first declared status of an equivalent scope, else the fallback."""
    if statuses.isEmpty():
        return rows.withColumn("target_discovery", fallback)
    first = statuses.withColumn("t_key", P.scope_key(F.col("scope"))).where("t_key is not null").groupBy("t_key").agg(F.min_by("status", "ord").alias("declared"))
    joined = rows.join(first, P.scope_key(F.col("scope")) == F.col("t_key"), "left")
    return joined.withColumn("target_discovery", F.coalesce("declared", fallback)).drop("t_key", "declared")


def disposition() -> Column:
    """C9."""
    shaky = (F.col("coverage") == "incomplete") | F.col("uncertain") | F.col("binding").isin("conflicting", "unresolved", "dynamic") | (F.col("inventory") == "unknown")
    look = F.col("inventory").isin("missing", "missing-under-declared-model", "inventory-listed-no-static-read") | (F.col("binding") == "no-static-evidence")
    return F.when(shaky, "inconclusive").when(look, "review").otherwise("informational")


def reasons(candidates: Column) -> Column:
    """C10, in fixed order."""
    parts = F.array(
        F.when(F.size("gap_ids") > 0, F.concat(F.lit("CORE_COVERAGE_INCOMPLETE:"), F.array_join("gap_ids", ","))),
        F.when(F.col("uncertain"), F.lit("CORE_DYNAMIC_UNCERTAINTY")),
        F.when(F.size(candidates) > 0, F.concat(F.lit("CORE_BINDING_CANDIDATE:"), F.array_join(candidates, ","))),
    )
    return F.filter(parts, lambda p: p.isNotNull())


def _first_match(inventory: DataFrame) -> DataFrame:
    """The first listing of each resource."""
    at = F.struct("snapshot_ord", "ord")
    return inventory.groupBy(F.col("resource.authority_id").alias("m_authority"), F.col("resource.canonical_id").alias("m_canonical")).agg(
        F.min_by("authority_id", at).alias("snapshot_authority"), F.min_by("as_of", at).alias("as_of")
    )


def demand_gaps(facts: Facts, wanted: DataFrame) -> DataFrame:
    """J10 for demand: per ``demand_id`` its gaps."""
    return coverage.gap_ids(coverage.affecting(wanted.select("demand_id", "scope", "key"), facts.gaps, "demand_id", True), "demand_id")


def with_coverage(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """``gap_ids``, and ``coverage`` that a gap leaves incomplete."""
    met = rows.join(large(gaps), "demand_id", "left").withColumn("gap_ids", F.coalesce("gap_ids", F.array().cast(NONE)))
    return met.withColumn("coverage", F.when(F.size("gap_ids") > 0, "incomplete").otherwise("complete"))


def demand_records(facts: Facts, wanted: DataFrame, resolved: bindings.Resolved, dynamic: DataFrame) -> DataFrame:
    none = F.array().cast(NONE)
    scopes = coverage.scopes_of([wanted.select("scope", F.col("o.ord").alias("ord"))])
    strong = coverage.strong_scopes(scopes, facts.closed_scopes, facts.inputs, facts.inventory)
    effective = effective_for(wanted, effective_selections(resolved), facts.candidates)
    status = bindings.status_for(wanted, resolved.partitions)
    reach = facts.candidates.select(F.col("scope").alias("c_scope"), F.col("destination").alias("c_key"), F.col("resolution").alias("c_resolution"))
    applicable = wanted.select("demand_id", "scope", "key").join(large(reach), _same_slot("scope", "key", "c_scope", "c_key")).where(P.scope_covers(F.col("c_scope"), F.col("scope")))
    applicable = applicable.groupBy("demand_id").agg(F.max((F.col("c_resolution") == "dynamic").cast("int")).alias("any_dynamic"))
    gaps = demand_gaps(facts, wanted)
    unsure = uncertain_ids(wanted, dynamic, "demand_id")
    # Stored before they meet, so that no plan holds all of them at once.
    effective, status, applicable, gaps, unsure, strong = all_stored(effective, status, applicable, gaps, unsure, strong)
    d = wanted
    for side in (effective, status, applicable, unsure):
        d = d.join(large(side), "demand_id", "left")
    d = with_coverage(d, gaps)
    d = d.withColumns({"uncertain": F.coalesce("uncertain", F.lit(False)), "n_effective": F.coalesce("n_effective", F.lit(0)), "candidate_ids": F.coalesce("candidate_ids", none)})
    s, n = F.coalesce("status", F.lit("none")), F.col("n_effective")
    # C4
    binding = (
        F.when(s == "effective", "exact-declared").when(s.isin("conflicting", "unresolved"), s).when(n == 1, "exact-declared").when(n > 1, "unresolved")
        .when(F.col("any_dynamic") == 1, "dynamic").when(F.col("any_dynamic") == 0, "possible").otherwise("no-static-evidence")
    )
    d = d.withColumn("binding", binding).withColumn("lone", F.when(n == 1, F.col("resource")))
    met = (effective, status, applicable, gaps, unsure)
    d, first = all_stored(d, _first_match(facts.inventory))
    discard(*met)
    # Without a lone winner a row matches nothing; its own id deals it out, where null would gather them all.
    own = F.when(F.col("lone").isNull(), F.col("demand_id")).otherwise(F.col("lone.canonical_id"))
    d = d.join(large(first), (F.col("lone.authority_id") == F.col("m_authority")) & (own == F.col("m_canonical")), "left")
    d = d.withColumn("scope_id", P.scope_key(F.col("scope"))).join(strong.withColumn("is_strong", F.lit(True)), "scope_id", "left")
    firm = F.coalesce("is_strong", F.lit(False)) & (F.col("coverage") == "complete") & ~F.col("uncertain")
    # C5
    inventory = (
        F.when(F.col("uncertain"), "unknown").when((n == 1) & F.col("lone").isNull(), "unknown").when((n == 1) & F.col("m_canonical").isNotNull(), "bound")
        .when((F.col("binding") == "exact-declared") & (n > 1), "unknown")
        .when(F.col("binding").isin("exact-declared", "no-static-evidence"), F.when(firm, "missing-under-declared-model").otherwise("missing"))
        .when(F.col("binding") == "possible", "unknown").otherwise("unbound")
    )
    d = d.withColumn("inventory", inventory).withColumn("disposition", disposition()).withColumn("reasons", reasons(F.col("candidate_ids")))
    d = with_target(d, facts.target_statuses, F.col("target"))
    return d.select(
        F.lit("demand").alias("kind"), "scope", "key", "reference_ids", "target_discovery", "demand", "binding", "inventory",
        F.col("snapshot_authority"), "as_of", "coverage", F.lit("none").alias("constraint"), "disposition", "reasons",
    )


def inventory_records(facts: Facts, wanted: DataFrame, resolved: bindings.Resolved, dynamic: DataFrame) -> DataFrame:
    """J5 to J8, C6, C7."""
    none = F.array().cast(NONE)
    winners = resolved.partitions.where("outcome = 'effective'").select("slot", "part").join(large(resolved.selections.where("status = 'effective'")), ["slot", "part"]).select("candidate_id").distinct()
    c = facts.candidates.join(large(winners), F.col("id") == F.col("candidate_id"), "left_semi").where("resource is not null").select(F.col("id").alias("candidate_id"), "scope", F.col("destination").alias("key"), "resource")
    c = stored(c)
    items = facts.inventory.select(F.col("authority_id").alias("snapshot_authority"), "as_of", F.col("resource").alias("item"), "declared_scopes")
    bound = c.join(large(items.drop("declared_scopes")), (F.col("resource.authority_id") == F.col("item.authority_id")) & (F.col("resource.canonical_id") == F.col("item.canonical_id")))
    w = wanted.select(F.col("scope").alias("d_scope"), F.col("key").alias("d_key"), F.col("demand").alias("d_demand"), F.col("o"))
    used = c.select("candidate_id", "scope", "key").join(large(w), _same_slot("scope", "key", "d_scope", "d_key")).where(P.scope_covers(F.col("scope"), F.col("d_scope")))
    used = used.groupBy("candidate_id").agg(F.min_by("d_demand", "o").alias("used"))
    gaps = coverage.gap_ids(coverage.affecting(c.select("candidate_id", "scope", "key"), facts.gaps, "candidate_id", True), "candidate_id")
    unsure = uncertain_ids(c, dynamic, "candidate_id")
    bound, used, gaps, unsure = all_stored(bound, used, gaps, unsure)
    discard(c)
    b = bound
    for side in (used, gaps, unsure):
        b = b.join(large(side), "candidate_id", "left")
    b = b.withColumns({"gap_ids": F.coalesce("gap_ids", none), "uncertain": F.coalesce("uncertain", F.lit(False))})
    b = b.withColumn("coverage", F.when(F.size("gap_ids") > 0, "incomplete").otherwise("complete"))
    blocked = (F.col("coverage") == "incomplete") | F.col("uncertain")
    unread = F.col("used").isNull()
    b = with_target(b, facts.target_statuses, F.lit("deployable"))
    b = b.select(
        F.lit("inventory").alias("kind"), "scope", "key", F.col("item").alias("resource"), "target_discovery", F.coalesce("used", F.lit("absent")).alias("demand"), F.lit("exact-declared").alias("binding"),
        F.when(blocked, "unknown").when(unread, "inventory-listed-no-static-read").otherwise("bound").alias("inventory"),
        "snapshot_authority", "as_of", "coverage", F.lit("none").alias("constraint"),
        F.when(blocked, "inconclusive").when(unread, "review").when(F.col("used") == "present", "informational").otherwise("review").alias("disposition"),
        reasons(F.array("candidate_id")).alias("reasons"),
    )
    taken = bound.select(F.col("snapshot_authority").alias("t_snapshot"), F.col("item.authority_id").alias("t_authority"), F.col("item.canonical_id").alias("t_canonical")).distinct()
    free = items.join(large(taken), (F.col("snapshot_authority") == F.col("t_snapshot")) & (F.col("item.authority_id") == F.col("t_authority")) & (F.col("item.canonical_id") == F.col("t_canonical")), "left_anti")
    free = free.withColumn("scope", F.explode_outer("declared_scopes"))
    u = free.select(
        F.lit("inventory").alias("kind"), "scope", F.lit(None).cast(schemas.KEY).alias("key"), F.col("item").alias("resource"),
        F.when(F.col("scope").isNull(), "unknown-target").otherwise("deployable").alias("target_discovery"), F.lit("absent").alias("demand"), F.lit("no-static-evidence").alias("binding"),
        F.lit("unbound").alias("inventory"), "snapshot_authority", "as_of", F.lit("complete").alias("coverage"), F.lit("none").alias("constraint"), F.lit("review").alias("disposition"),
        F.array(F.lit("CORE_INVENTORY_UNBOUND")).alias("reasons"),
    )
    return b.unionByName(u)


def dynamic_records(facts: Facts, dynamic: DataFrame, scopes: DataFrame) -> DataFrame:
    """C8."""
    none = F.array().cast(NONE)
    unbounded = F.col("kind") == "unbounded"
    known = scopes.select("scope_id", F.col("gap_ids").alias("scope_gaps"))
    d = dynamic.join(known, P.scope_key(F.col("scope")) == F.col("scope_id"), "left")
    d = d.withColumn("gap_ids", F.when(unbounded, none).otherwise(F.coalesce("scope_gaps", none))).withColumn("uncertain", unbounded)
    d = d.withColumn("coverage", F.when(unbounded | (F.size("gap_ids") > 0), "incomplete").otherwise("complete"))
    demand = F.when(F.col("kind") == "finite", "finite-dynamic").when(F.col("kind") == "pattern", "pattern-dynamic").when(F.col("origin") == "user-controlled", "unbounded-user-controlled").otherwise("unbounded-unknown")
    said = F.concat(reasons(none), F.when(F.col("issue").isNull(), none).otherwise(F.array(F.concat(F.lit("CORE_"), F.col("issue")))))
    d = with_target(d.withColumn("said", said), facts.target_statuses, F.lit("unknown-target"))
    return d.select(
        F.lit("dynamic").alias("kind"), F.col("id").alias("lookup_id"), F.col("reference_id"), "scope", "reason", F.col("likely").alias("likely_keys"), "target_discovery", demand.alias("demand"),
        F.when(unbounded, "dynamic").otherwise("possible").alias("binding"), F.lit("unknown").alias("inventory"), "coverage", F.lit("none").alias("constraint"),
        F.when(unbounded | F.col("issue").isNotNull(), "inconclusive").otherwise("review").alias("disposition"), F.col("said").alias("reasons"),
    )


def _settled(candidates: DataFrame) -> bindings.Resolved:
    """The bindings of ``candidates``, stored before they meet anything."""
    known = bindings.resolve(candidates)
    partitions, selections = all_stored(known.partitions, known.selections)
    discard(*known.steps)
    return bindings.Resolved(partitions, selections)


def reconcile(facts: Facts, max_finite: int = dynamics.MAX_FINITE_KEYS, resolved: bindings.Resolved | None = None) -> Records:
    return Records(facts, max_finite, resolved)

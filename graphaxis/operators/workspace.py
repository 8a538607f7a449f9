"""Deployments: which member repository owns which evidence, and what a workspace sums up to.

Members carry a deployment, a repository and an execution scope. Candidates and inventory items meet
members by equi-joins on the execution unit; a unit that no member has reaches members through the
selector instead. Everything carries ``deployment_id``, so one plan serves all deployments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P

#: Assignments beyond this clear a deployment's whole fan-out (never a part of it).
MAX_ASSIGNMENTS = 100_000
STATUS = {"invalid": 2, "incomplete": 1, "complete": 0}


def shared_keys(members: DataFrame, demand: DataFrame) -> DataFrame:
    """Keys that all (two or more) members of a deployment read: division by counting."""
    size = members.groupBy("deployment_id").agg(F.count_distinct("repository_id").alias("n")).where("n >= 2")
    reads = demand.groupBy("deployment_id", "key").agg(F.count_distinct("repository_id").alias("k"))
    return reads.join(size, "deployment_id").where("k = n").select("deployment_id", "key")


def candidate_members(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """``deployment_id``, ``repository_id``, ``candidate_id`` and ``relation``.

    ``assign`` where the candidate's scope covers the member's; ``uncertain`` where they overlap,
    where the selector may still reach the member, or where the unit is nobody's.
    """
    m = members.select("deployment_id", "repository_id", F.col("scope").alias("member"))
    c = candidates.select("deployment_id", F.col("id").alias("candidate_id"), "scope", "applies_when")
    met = m.join(c, (m["deployment_id"] == c["deployment_id"]) & (F.col("member.id") == F.col("scope.id"))).drop(c["deployment_id"])
    relation = P.relation_to_scope(F.col("scope"), F.col("member"))
    reached = P.selector_may_affect(F.col("applies_when"), F.col("member"))
    verdict = F.when(relation == "covers", "assign").when((relation == "overlaps") | reached, "uncertain")
    known = met.select("deployment_id", "repository_id", "candidate_id", verdict.alias("relation"))
    units = m.select("deployment_id", F.col("member.id").alias("unit")).distinct()
    stray = c.join(units, (c["deployment_id"] == units["deployment_id"]) & (F.col("scope.id") == F.col("unit")), "left_anti")
    far = m.join(stray, "deployment_id").where(reached).select("deployment_id", "repository_id", "candidate_id", F.lit("uncertain").alias("relation"))
    return known.where("relation is not null").unionByName(far)


def inventory_owners(members: DataFrame, items: DataFrame, exact: DataFrame) -> DataFrame:
    """``deployment_id``, ``repository_id``, ``item_id``, ``relation`` and ``reason``.

    ``exact``: the effective exact bindings by member (``deployment_id``, ``repository_id``,
    ``resource``). O1: an item without scopes that nobody binds leaves all uncertain; O2: its owners
    get it otherwise; O3: a declared unit of nobody leaves all uncertain; O4: a lone covering member
    gets it; O5: several do if each binds it, else all that match are uncertain.
    """
    m = members.select("deployment_id", "repository_id", F.col("scope").alias("member"))
    i = items.select("deployment_id", F.col("id").alias("item_id"), "resource", "declared_scopes")
    own = exact.select("deployment_id", "repository_id", F.col("resource.authority_id").alias("e_authority"), F.col("resource.canonical_id").alias("e_canonical")).distinct()
    bound = i.select("deployment_id", "item_id", F.col("resource.authority_id").alias("e_authority"), F.col("resource.canonical_id").alias("e_canonical")).join(own, ["deployment_id", "e_authority", "e_canonical"]).select("deployment_id", "item_id", "repository_id").withColumn("binds", F.lit(True))
    scoped = F.coalesce(F.size("declared_scopes") > 0, F.lit(False))
    free = i.where(~scoped).select("deployment_id", "item_id")
    owners = bound.select("deployment_id", "item_id").distinct()
    copies = free.join(bound, ["deployment_id", "item_id"]).select("deployment_id", "repository_id", "item_id", F.lit("assign").alias("relation"), F.lit("O2").alias("reason"))
    orphans = free.join(owners, ["deployment_id", "item_id"], "left_anti").join(m.select("deployment_id", "repository_id"), "deployment_id")
    orphans = orphans.select("deployment_id", "repository_id", "item_id", F.lit("uncertain").alias("relation"), F.lit("UNATTRIBUTED_INVENTORY").alias("reason"))
    said = i.where(scoped).select("deployment_id", "item_id", F.explode("declared_scopes").alias("scope"))
    units = m.select("deployment_id", F.col("member.id").alias("unit")).distinct()
    unknown = said.join(units.withColumnRenamed("deployment_id", "in_deployment"), (F.col("deployment_id") == F.col("in_deployment")) & (F.col("scope.id") == F.col("unit")), "left_anti").select("deployment_id", "item_id").distinct()
    everyone = unknown.join(m.select("deployment_id", "repository_id"), "deployment_id").select("deployment_id", "repository_id", "item_id", F.lit("uncertain").alias("relation"), F.lit("O3").alias("reason"))
    met = said.join(unknown, ["deployment_id", "item_id"], "left_anti").join(m.withColumnRenamed("deployment_id", "in_deployment"), (F.col("deployment_id") == F.col("in_deployment")) & (F.col("scope.id") == F.col("member.id"))).drop("in_deployment")
    rank = F.max(F.when(P.relation_to_scope(F.col("scope"), F.col("member")) == "covers", 2).when(P.relation_to_scope(F.col("scope"), F.col("member")) == "overlaps", 1).otherwise(0))
    per = met.groupBy("deployment_id", "item_id", "repository_id").agg(rank.alias("r")).where("r > 0").join(bound, ["deployment_id", "item_id", "repository_id"], "left")
    covers, binds = F.col("r") == 2, F.coalesce("binds", F.lit(False))
    total = per.groupBy("deployment_id", "item_id").agg(
        F.sum(covers.cast("int")).alias("n_cover"), F.sum((~covers).cast("int")).alias("n_overlap"), F.min(F.when(covers, binds.cast("int")).otherwise(1)).alias("all_bind")
    )
    sure = ((F.col("n_cover") == 1) & (F.col("n_overlap") == 0)) | ((F.col("n_cover") > 1) & (F.col("all_bind") == 1) & (F.col("n_overlap") == 0))
    placed = per.join(total, ["deployment_id", "item_id"]).select(
        "deployment_id", "repository_id", "item_id", F.when(sure, "assign").otherwise("uncertain").alias("relation"), F.when(sure & (F.col("n_cover") == 1), "O4").otherwise("O5").alias("reason")
    )
    return copies.unionByName(orphans).unionByName(everyone).unionByName(placed)


def within_fan_out(assigned: DataFrame, most: int = MAX_ASSIGNMENTS) -> DataFrame:
    """Deployments over the limit lose their whole fan-out, counted before it is used."""
    sizes = assigned.groupBy("deployment_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("deployment_id")
    return assigned.join(sizes, "deployment_id", "left_anti")


def admit(costs: DataFrame, budget: int) -> DataFrame:
    """By repository id, one that doesn't fit is skipped and the next may still be admitted.

    Sequential by nature; a workspace has at most 50,000 rows and is one group of its own.
    """
    def take(rows):
        left, out = budget, []
        for cost in rows.sort_values("repository_id")["cost"]:
            ok = cost <= left
            left -= cost if ok else 0
            out.append(bool(ok))
        return rows.sort_values("repository_id").assign(admitted=out)[["workspace_id", "repository_id", "cost", "admitted"]]

    return costs.groupBy("workspace_id").applyInPandas(take, "workspace_id string, repository_id string, cost long, admitted boolean")


def deployment_status(members: DataFrame) -> DataFrame:
    """The worst member state, and the first diagnostic in order."""
    rank = F.when(F.col("state") == "invalid", 2).when((F.col("state") == "incomplete") | (F.size("diagnostics") > 0), 1).otherwise(0)
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("diagnostics"))))
    out = members.groupBy("deployment_id").agg(F.max(rank).alias("r"), F.get(codes, F.lit(0)).alias("diagnostic"), F.count_distinct("repository_id").alias("n_members"))
    return out.select("deployment_id", _status(F.col("r")).alias("status"), "diagnostic", "n_members")


def _status(rank: Column) -> Column:
    return F.when(rank == 2, "invalid").when(rank == 1, "incomplete").otherwise("complete")


def summary(deployments: DataFrame) -> DataFrame:
    """One row of counts and the overall flag."""
    return deployments.agg(
        F.count(F.lit(1)).alias("n_deployments"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUS],
        F.coalesce(F.bool_or(F.col("status") != "complete"), F.lit(False)).alias("incomplete"),
    )


def rescoped(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Source facts of a repository, stamped with each member's scope."""
    return facts.drop("scope").join(members.select("deployment_id", "repository_id", "scope"), "repository_id")

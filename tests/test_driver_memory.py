"""Joins whose sides grow with the input never pass through the driver, whatever the broadcast threshold."""

from __future__ import annotations

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from graphaxis.plans import queries, store

SMALL = "/root/testdata/sf0.001"
#: Names of join keys of which there are as many as slots, candidates, demands, references or resources.
GROWING = re.compile(r"Broadcast\w*Join [^\n]*\b(slot|part|candidate_id|demand_id|reference_id|canonical_id|o_orderkey)#")


def gathered(spark, monkeypatch, name: str) -> list[str]:
    """The broadcast joins on growing keys, of all steps of a query and of its last plan."""
    plans: list[str] = []
    write = store.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    keep = lambda df: plan(df) or write(df)
    monkeypatch.setattr(store, "stored", keep)
    for module in (queries.bindings, queries.reconcile, queries.derive):
        monkeypatch.setattr(module, "stored", keep)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        plan(queries.QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("Join" in p for p in plans)
    return [line for p in plans for line in p.split("\n") if GROWING.search(line)]


@pytest.mark.parametrize("name", ["c2_partition_outcomes", "w1_a3_u6_binding_selections", "c4_c5_c9_demand_records", "j9_a2_scope_coverage", "a8_report_groups", "c13_sarif_results", "c1_c8_dynamic_records", "a13_incomplete", "g4_explain", "g3_sarif_log"])
def test_no_growing_side_is_broadcast(spark, monkeypatch, name):
    assert gathered(spark, monkeypatch, name) == []


def test_steps_leave_no_files_behind(spark):
    """A stored step is not written again, its shuffle files go with its write, and discard frees it."""
    clean = store._CLEAN
    spark.conf.set(clean, "false")
    rows = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    seen = []
    write = type(rows.write).parquet
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows.write), "parquet", lambda self, path: seen.append(spark.conf.get(clean)) or write(self, path))
        step = store.stored(rows)
        again = store.all_stored(step)[0]
    assert seen == ["true"] and again is step and step.count() == 7 and spark.conf.get(clean) == "false"
    path = store._paths[step].removeprefix("file:")
    assert os.path.isdir(path)
    store.discard(step)
    spark.conf.unset(clean)
    assert not os.path.exists(path)


def made(monkeypatch) -> list[str]:
    """Gets the names of the shared steps as they are planned."""
    seen: list[str] = []
    for module, name in ((queries.bindings, "resolve"), (queries.reconcile, "demands"), (queries.reconcile, "inventory_records"), (queries.reconcile, "demand_records")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, name=name, whole=whole, **b: seen.append(name) or whole(*a, **b))
    return seen


def test_lookups_need_no_bindings_and_no_demand(spark, monkeypatch):
    seen = made(monkeypatch)
    assert queries.QUERIES["c1_c8_dynamic_records"](spark, SMALL).count() == 25
    assert seen == []


def test_incompleteness_needs_no_bindings(spark, monkeypatch):
    seen = made(monkeypatch)
    assert [r.incomplete for r in queries.QUERIES["a13_incomplete"](spark, SMALL).collect()] == [True]
    assert seen == ["demands"]


def test_one_key_is_explained_by_its_own_facts(spark, monkeypatch):
    seen = made(monkeypatch)
    met = []
    whole = queries.bindings.resolve
    monkeypatch.setattr(queries.bindings, "resolve", lambda c: met.extend(c.select("destination.name").distinct().collect()) or whole(c))
    records = queries.derive.records(spark, SMALL)
    one = records.demand_of("env", "PART_70")
    assert [r.name for r in met] == ["PART_70"] and sorted(seen) == ["demand_records", "demands", "resolve"]
    assert sorted(map(str, one.collect())) == sorted(map(str, queries.report.explain(records.demand, "env:PART_70").collect())) != []


@pytest.mark.parametrize("name, scopes", [("a8_report_groups", 0), ("c13_sarif_results", 1)])
def test_reports_on_records_judge_no_scopes_but_those_of_lookups(spark, monkeypatch, name, scopes):
    judged = []
    whole = queries.reconcile.coverage.scope_coverage
    monkeypatch.setattr(queries.reconcile.coverage, "scope_coverage", lambda of, gaps: judged.append(of.count()) or whole(of, gaps))
    queries.QUERIES[name](spark, SMALL)
    assert len(judged) == scopes and all(n <= 5 for n in judged)


def test_few_plans_are_held_at_once(spark, monkeypatch):
    """Steps that don't read each other are written two at a time, however many there are."""
    now, most = [], []
    write = type(spark.range(1).write).parquet

    def watched(self, path):
        now.append(path)
        most.append(len(now))
        time.sleep(0.3)
        write(self, path)
        now.remove(path)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", watched)
    steps = store.all_stored(*(spark.range(n) for n in range(6)))
    assert [s.count() for s in steps] == list(range(6)) and max(most) <= 2


def test_discarded_steps_leave_no_garbage_in_the_driver(spark, monkeypatch):
    """What plans have left is collected when a step goes, and freed native memory is returned after each write."""
    run, trimmed = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), []
    whole = store._trim
    monkeypatch.setattr(store, "_trim", lambda spark: trimmed.append(whole(spark)))
    step = store.stored(spark.range(10))
    assert trimmed == [True]
    spark.sparkContext._jvm.java.util.ArrayList(16 << 20).trimToSize()  # 64 MB that nothing reads any more
    before = run.totalMemory() - run.freeMemory()
    store.discard(step)
    assert before - (run.totalMemory() - run.freeMemory()) > 60 << 20 and trimmed == [True, True]


def test_facts_that_are_absent_are_not_joined(spark):
    """Without closed models no scope is strong, and without declared statuses all have the fallback: no join finds that out."""
    reconcile = queries.reconcile
    f = reconcile.Facts.of(spark)
    scopes = f.candidates.select(f.candidates.id.alias("scope_id"), "scope")
    strong = reconcile.coverage.strong_scopes(scopes, f.closed_scopes, f.inputs, f.inventory)
    target = reconcile.with_target(scopes, f.target_statuses, F.lit("deployable"))
    assert strong.columns == ["scope_id"] and strong.count() == 0 and target.columns == ["scope_id", "scope", "target_discovery"]
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in (strong, target))


def test_results_are_counted_one_kind_after_another(spark, monkeypatch):
    """Each kind of record is made once the results of the one before are stored; what is returned joins nothing."""
    steps = []
    for name in ("demand_records", "inventory_records", "dynamic_records"):
        whole = getattr(queries.reconcile, name)
        monkeypatch.setattr(queries.reconcile, name, lambda *a, name=name, whole=whole: steps.append(name) or whole(*a))
    monkeypatch.setattr(queries, "settled", lambda df: steps.append("stored") or store.settled(df), raising=False)
    found = queries.QUERIES["c13_sarif_results"](spark, SMALL)
    assert steps == ["demand_records", "stored", "inventory_records", "stored", "dynamic_records", "stored"]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    r = queries.derive.records(spark, SMALL)
    whole = queries.report.sarif_results(r.demand, r.inventory, r.dynamic).groupBy("rule_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    assert found.dtypes == whole.dtypes and sorted(found.collect()) == sorted(whole.collect()) != []

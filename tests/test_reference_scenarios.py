"""Core scenarios on hand-built facts, and metamorphic checks."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from graphaxis.operators import bindings
from graphaxis.operators.reconcile import Facts, reconcile
from graphaxis.plans import schemas

ALWAYS = {"kind": "always", "clauses": []}
ALL = {"kind": "all", "values": []}


def stage(*values):
    return {"kind": "exact", "values": list(values)} if values else ALL


def scope(id="api", phase="runtime", stages=("production",), channel="environment", kind=None):
    return {"id": id, "component_id": id, "phase": phase, "stage": {"kind": kind, "values": []} if kind else stage(*stages), "channel": channel}


def selector(condition=ALWAYS, units=None, of=ALL):
    return {"execution_unit_ids": units, "phases": None, "stage": of, "channels": None, "condition": condition}


def branch(operator, value):
    return {"kind": "all", "clauses": [{"key": "BRANCH", "operator": operator, "value": value}]}


def env(name):
    return {"namespace": "env", "name": name}


def reference(name, ord=0):
    return {"ord": ord, "id": f"reference-{name}", "key": env(name), "demand": "direct-read", "operation": "read", "resolution": "literal", "confidence": "high", "location": None, "exposure": "server", "evidence": None}


def edge(name, ord=0, at=None):
    return {"ord": ord, "id": f"demand-{ord}", "reference_id": f"reference-{name}", "scope": at or scope(), "origin": "direct"}


def candidate(id, name, rank=1, comparable=True, resource=True, when=None, at=None, resolution="exact", ord=0, authority="authority-a"):
    return {
        "ord": ord, "id": id, "adapter_id": "adapter", "scope": at or scope(), "destination": env(name), "source_kind": "secret-manager",
        "resource": {"authority_id": authority, "canonical_id": f"res-{name}"} if resource else None, "applies_when": when or selector(), "rank": rank, "comparable": comparable, "resolution": resolution,
    }


def item(name, ord=0, authority="authority-a", scopes=None):
    return {"snapshot_ord": 0, "ord": ord, "input_id": "inventory", "authority_id": authority, "as_of": "2026-07-12T00:00:00.000Z", "resource": {"authority_id": authority, "canonical_id": f"res-{name}"}, "declared_scopes": scopes}


def gap(id="gap-1", affects=None, keys=None):
    domain = None if keys is None else {"kind": "keys", "keys": [env(k) for k in keys], "pattern": None}
    return {"ord": 0, "id": id, "domain": "demand", "input_id": "scan", "potentially_affects": affects or selector(), "key_domain": domain, "reason": "UNREADABLE"}


@pytest.fixture
def run(spark):
    def go(**rows):
        return reconcile(Facts.of(spark, **{k: spark.createDataFrame(v, schemas.FACTS[k]) for k, v in rows.items()}))

    return go


def one(df) -> Row:
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_typed_join_and_unread_inventory(run):
    r = run(references=[reference("A")], demand_edges=[edge("A")], candidates=[candidate("c-a", "A"), candidate("c-b", "B", ord=1)], inventory=[item("A"), item("B", 1), item("C", 2)])
    d = one(r.demand)
    assert (d.binding, d.inventory, d.coverage, d.disposition) == ("exact-declared", "bound", "complete", "informational")
    assert {(i.resource.canonical_id, i.inventory, i.disposition) for i in r.inventory.collect()} == {("res-A", "bound", "informational"), ("res-B", "inventory-listed-no-static-read", "review"), ("res-C", "unbound", "review")}


def test_precedence(spark):
    def statuses(*rows):
        out = bindings.resolve(spark.createDataFrame(list(rows), schemas.CANDIDATE))
        return {s.candidate_id: s.status for s in out.selections.collect()}, [p.outcome for p in out.partitions.collect()]

    assert statuses(candidate("a", "K", 2), candidate("b", "K", 1, ord=1)) == ({"a": "effective", "b": "shadowed"}, ["effective"])
    assert statuses(candidate("a", "K", 2), candidate("b", "K", 2, ord=1)) == ({"a": "conflicting", "b": "conflicting"}, ["conflicting"])
    assert statuses(candidate("a", "K", None, False)) == ({"a": "effective"}, ["effective"])
    assert statuses(candidate("a", "K", 2), candidate("b", "K", None, False, ord=1))[1] == ["conflicting"]
    assert statuses(candidate("a", "K", 3), candidate("b", "K", 1, ord=1), candidate("c", "K", 1, ord=2))[0]["a"] == "effective"
    assert statuses(candidate("a", "K", resolution="dynamic"))[1] == ["unresolved"]


def test_two_branches_cover_all(run):
    r = run(
        references=[reference("K")], demand_edges=[edge("K")],
        candidates=[candidate("a", "K", when=selector(branch("equals", "main"))), candidate("b", "K", when=selector(branch("not-equals", "main")), ord=1)], inventory=[item("K")],
    )
    d = one(r.demand)
    assert (d.binding, d.inventory, d.disposition) == ("exact-declared", "unknown", "inconclusive")


def test_one_branch_is_unresolved(run):
    d = one(run(references=[reference("K")], demand_edges=[edge("K")], candidates=[candidate("a", "K", when=selector(branch("equals", "main")))], inventory=[item("K")]).demand)
    assert (d.binding, d.disposition) == ("unresolved", "inconclusive")


def test_unknown_condition_is_unresolved(run):
    when = selector({"kind": "unknown", "clauses": None})
    d = one(run(references=[reference("K")], demand_edges=[edge("K")], candidates=[candidate("a", "K", when=when)], inventory=[item("K")]).demand)
    assert (d.binding, d.inventory) == ("unresolved", "unbound")


def test_overlapping_selectors_stay_open(run):
    narrow = selector(of=stage("production"))
    d = one(run(references=[reference("K")], demand_edges=[edge("K")], candidates=[candidate("a", "K"), candidate("b", "K", 5, when=narrow, ord=1)], inventory=[item("K")]).demand)
    assert d.binding == "unresolved"


def test_other_authority_does_not_join(run):
    d = one(run(references=[reference("K")], demand_edges=[edge("K")], candidates=[candidate("a", "K")], inventory=[item("K", authority="authority-b")]).demand)
    assert (d.binding, d.inventory, d.disposition) == ("exact-declared", "missing", "review")


def test_binding_without_resource_is_unknown(run):
    d = one(run(references=[reference("K")], demand_edges=[edge("K")], candidates=[candidate("a", "K", resource=False)]).demand)
    assert (d.binding, d.inventory, d.disposition) == ("exact-declared", "unknown", "inconclusive")


def test_scoped_and_keyed_gaps(run):
    rows = dict(references=[reference("K"), reference("L", 1)], demand_edges=[edge("K"), edge("L", 1)], candidates=[candidate("a", "K"), candidate("b", "L", ord=1)], inventory=[item("K"), item("L", 1)])
    r = run(**rows, gaps=[gap(keys=["K"])])
    assert {d.key.name: (d.coverage, d.disposition) for d in r.demand.collect()} == {"K": ("incomplete", "inconclusive"), "L": ("complete", "informational")}
    assert [s.state for s in r.scopes.collect()] == ["incomplete"]
    assert {d.coverage for d in run(**rows, gaps=[gap(affects=selector(units=["other"]))]).demand.collect()} == {"complete"}


def dynamic(kind, keys=(), likely=None, pattern=None, ord=0, origin="lexical", proven=None):
    return {
        "ord": ord, "id": f"dynamic-{ord}", "reference_id": f"r-{ord}", "scope": scope(), "domain": {"kind": kind, "keys": list(keys), "pattern": pattern, "reason": None}, "origin": origin,
        "pattern_constraint": proven, "likely_keys": [env(k) for k in (keys if likely is None else likely)],
    }


def test_finite_lookup_is_demand(run):
    r = run(dynamic_edges=[dynamic("finite", ["K", "L"])], candidates=[candidate("a", "K")], inventory=[item("K")])
    assert {d.key.name: (d.demand, d.binding, d.inventory) for d in r.demand.collect()} == {"K": ("finite-dynamic", "exact-declared", "bound"), "L": ("finite-dynamic", "no-static-evidence", "missing")}
    assert one(r.dynamic).disposition == "review"


def test_malformed_lookups_become_unbounded(run):
    for edge_, code in ((dynamic("finite", ["K", "K"]), "FINITE_DUPLICATE"), (dynamic("finite", ["K"], ["L"]), "FINITE_LIKELY_MISMATCH"), (dynamic("finite", [f"K{i}" for i in range(65)]), "OVER_BUDGET"), (dynamic("unbounded", likely=["K"]), "UNBOUNDED_HAS_KEYS")):
        r = run(dynamic_edges=[edge_], references=[reference("Z")], demand_edges=[edge("Z")])
        y = one(r.dynamic)
        assert y.disposition == "inconclusive" and y.reasons[-1] == f"CORE_DYNAMIC_{code}"
        assert one(r.demand).inventory == "unknown"


def test_pattern_takes_bindings_in_reach(run):
    pattern = {"kind": "prefix", "pattern_id": "p", "prefix": "DB_", "suffix": None}
    r = run(dynamic_edges=[dynamic("pattern", likely=[], pattern=pattern)], candidates=[candidate("a", "DB_URL"), candidate("b", "OTHER", ord=1)])
    d = one(r.demand)
    assert (d.key.name, d.demand) == ("DB_URL", "pattern-dynamic")


def test_conflicting_pattern_domains(run):
    pattern = {"kind": "prefix", "pattern_id": "p", "prefix": "DB_", "suffix": None}
    model = [{"ord": i, "pattern_id": "p", "selector": selector(), "keys": [env(k)], "constraint": "adapter-proven"} for i, k in enumerate(["DB_A", "DB_B"])]
    r = run(dynamic_edges=[dynamic("pattern", likely=[], pattern=pattern, proven="adapter-proven")], pattern_domains=model)
    assert one(r.dynamic).reasons[-1] == "CORE_DYNAMIC_PATTERN_DOMAIN_CONFLICT"
    one_model = run(dynamic_edges=[dynamic("pattern", likely=[], pattern=pattern, proven="adapter-proven")], pattern_domains=model[:1])
    assert [d.key.name for d in one_model.demand.collect()] == ["DB_A"]


def closed(**changes):
    row = {
        "selector": selector(), "closed": True, "approved_roots": ["src"], "binding_roots": ["deploy"], "expected_inputs": [{"input_id": "scan", "domain": "demand"}],
        "authorities": [{"authority_id": "authority-a", "inventory_input_id": "inventory"}], "mechanisms": [], "outside_root_imports": "out-of-scope",
    }
    return row | changes


@pytest.mark.parametrize("changes, want", [({}, "missing-under-declared-model"), ({"approved_roots": []}, "missing"), ({"closed": False}, "missing"), ({"mechanisms": [selector()]}, "missing"), ({"authorities": [{"authority_id": "other", "inventory_input_id": "x"}]}, "missing")])
def test_closed_model_makes_missing_final(run, changes, want):
    observed = [{"input_id": "scan", "domain": "demand", "state": "complete", "selector": selector()}]
    d = one(run(references=[reference("K")], demand_edges=[edge("K")], inventory=[item("Z")], closed_scopes=[closed(**changes)], inputs=observed).demand)
    assert (d.binding, d.inventory) == ("no-static-evidence", want)


def test_opaque_names_equal_nothing(run):
    opaque = reference("X") | {"key": env(None)}
    r = run(references=[opaque], demand_edges=[edge("X")], candidates=[candidate("a", None), candidate("b", None, ord=1)])
    assert r.demand.count() == 0
    assert {p.disposition for p in r.inventory.collect()} == set()


def test_unknown_scopes_are_never_covered(run):
    d = one(run(references=[reference("K")], demand_edges=[edge("K", at=scope(phase="unknown"))], candidates=[candidate("a", "K", at=scope(phase="unknown"))], inventory=[item("K")]).demand)
    assert d.binding == "no-static-evidence"


def test_order_of_rows_does_not_matter_and_gaps_never_firm_up(spark, run):
    rows = dict(references=[reference(k, i) for i, k in enumerate("KLM")], demand_edges=[edge(k, i) for i, k in enumerate("KLM")], candidates=[candidate(f"c{i}", k, i % 2, ord=i) for i, k in enumerate("KKLM")], inventory=[item("K"), item("L", 1)])
    view = lambda r: sorted((d.key.name, d.binding, d.inventory, d.disposition) for d in r.demand.collect())
    straight = view(run(**rows))
    assert straight == view(run(**{k: v[::-1] for k, v in rows.items()}))
    assert {d[3] for d in view(run(**rows, gaps=[gap()]))} == {"inconclusive"}

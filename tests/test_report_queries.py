"""Report queries over whole records, and the operator behind shared keys."""

from __future__ import annotations

from collections import Counter

import pytest

from graphaxis.plans import derive, queries

KEY = "struct<namespace: string, name: string>"
SCOPE = "struct<id: string, phase: string, stage: struct<kind: string, values: array<string>>, channel: string>"
COMMON = f"kind string, scope {SCOPE}, key {KEY}, demand string, binding string, inventory string, coverage string, disposition string, reasons array<string>"


@pytest.fixture
def records(spark, monkeypatch):
    at = lambda unit: (unit, "runtime", ("exact", ["A"]), None)
    row = lambda kind, unit, name, inventory, disposition: (kind, at(unit), name and ("env", name), "present", "exact-declared", inventory, "complete", disposition, [])
    demand = [(*row("demand", u, "P", "bound", d), ["ref"]) for u, d in (("U1", "informational"), ("U2", "informational"))]
    demand += [(*row("demand", "U1", "Q", "missing", "review"), ["ref"])]
    inventory = [(*row("inventory", u, n, i, d), (c,)) for u, n, i, d, c in (
        ("U1", "P", "unknown", "inconclusive", "p"), ("U2", "R", "inventory-listed-no-static-read", "review", "r"), ("U2", None, "unbound", "review", "s"))]
    dynamic = [("L1", "unbounded-user-controlled", at("U1"), "inconclusive"), ("L2", "finite-dynamic", at("U2"), "review")]

    class Made:
        pass

    made = Made()
    made.demand = spark.createDataFrame(demand, COMMON + ", reference_ids array<string>")
    made.inventory = spark.createDataFrame(inventory, COMMON + ", resource struct<canonical_id: string>")
    made.dynamic = spark.createDataFrame(dynamic, f"lookup_id string, demand string, scope {SCOPE}, disposition string")
    monkeypatch.setattr(derive, "records", lambda spark, sf_dir: made)


def test_sarif_results_come_from_all_records(spark, records):
    got = Counter({(r.rule_id, r.unit): r.n for r in queries.QUERIES["c13_sarif_results"](spark, "").collect()})
    assert got == {("SRI002", "U1"): 1, ("SRI003", "U1"): 1, ("SRI001", "U2"): 1, ("SRI005", "U1"): 1, ("SRI004", "U2"): 1}


def test_groups_hold_inventory_uses(spark, records):
    got = {r.group_key: (r.n_uses, r.n_scopes, r.shared, r.disposition) for r in queries.QUERIES["a8_report_groups"](spark, "").collect()}
    assert got == {"env:P": (3, 2, True, "inconclusive"), "env:Q": (1, 1, False, "review"), "env:R": (1, 0, False, "review")}


def test_shared_keys_query_calls_the_operator(spark, monkeypatch):
    called = []
    whole = queries.workspace.shared_keys
    monkeypatch.setattr(queries.workspace, "shared_keys", lambda *tables: called.append(1) or whole(*tables))
    sf_dir = "/root/testdata/sf0.001"
    got = {(r.deployment, r.name) for r in queries.QUERIES["a6_shared_keys"](spark, sf_dir).collect()}
    reads = {(r.part, r.nation, r.region) for r in derive.read(spark, sf_dir).where("part % 97 <> 0").collect()}
    nations = Counter(r.n_regionkey for r in derive.table(spark, sf_dir, "nation").collect())
    counts = Counter((region, part) for part, _, region in reads)
    assert called and got == {(f"REGION_{g}", f"PART_{p}") for (g, p), k in counts.items() if k == nations[g] >= 2}


def test_no_row_holds_the_whole_log(spark):
    """The lines in their order are one JSON document with all results, sorted; equal results stay apart."""
    import json

    from graphaxis.plans import report

    given = [("SRI001", "b", "U1"), ("SRI005", "a\n", "U1"), ("SRI002", 'q"', "U2"), ("SRI002", "a", "U9"), ("SRI001", "b", "U1"), ("SRI001", "b", None)]
    log = lambda rows: [r.text for r in report.sarif(spark.createDataFrame([(*r, "review") for r in rows], "rule_id string, subject string, unit string, disposition string")).orderBy("at").collect()]
    lines = log(given)
    assert len(lines) == len(given) + 2
    whole = json.loads("\n".join(lines))
    assert whole["version"] == "2.1.0" and whole["runs"][0]["tool"]["driver"]["name"] == report.TOOL and len(whole["runs"][0]["tool"]["driver"]["rules"]) == 5
    got = [(r["ruleId"], r["level"], r["message"]["text"]) for r in whole["runs"][0]["results"]]
    assert got == sorted((k, report.RULES[k][0], " ".join(x for x in said if x is not None)) for k, *said in given)
    assert json.loads("\n".join(log([])))["runs"][0]["results"] == []

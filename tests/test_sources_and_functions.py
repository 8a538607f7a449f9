"""Documents, discovery, manifests and safe values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphaxis.functions import safety
from graphaxis.sources import discovery, documents, manifest

SCOPE = {"id": "api", "componentId": "api", "phase": "runtime", "stage": {"kind": "exact", "values": ["prod"]}, "channel": "environment"}
SELECTOR = {"stage": {"kind": "all"}, "condition": {"kind": "always"}}


def candidate(id, **changes):
    return {
        "id": id, "scope": SCOPE, "destination": {"namespace": "env", "name": "KEY"}, "sourceKind": "secret-manager", "providerResourceId": {"authorityId": "a", "canonicalId": "r"},
        "appliesWhen": SELECTOR, "precedence": {"source": "x", "rank": 1, "comparable": True}, "resolution": "exact",
    } | changes


def parsed(spark, parse, *texts):
    out = parse(spark.createDataFrame([(f"d{i}", t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "path string, text string"))
    return out.facts.collect(), out.gaps.collect()


def test_binding_manifest_rows_and_quarantine(spark):
    rows = [candidate("a"), candidate("a"), candidate("b", scope=SCOPE | {"phase": "never"}), candidate("c", providerResourceId=None), candidate("d", precedence={"source": "x", "rank": None, "comparable": True})]
    facts, gaps = parsed(spark, documents.binding_manifests, {"schemaVersion": documents.BINDINGS, "inputId": "in", "adapterId": "ad", "candidates": rows}, "not json", {"schemaVersion": "other"})
    assert [(f.id, f.rank, f.destination.name) for f in facts] == [("a", 1, "KEY")]
    found = sorted((g.path, g.reason, g.potentially_affects is None) for g in gaps)
    assert found == [("d0", "DUPLICATE_ID", False), ("d0", "INVALID_ROW", False), ("d0", "INVALID_ROW", False), ("d0", "INVALID_ROW", True), ("d1", "INVALID_ROOT", True), ("d2", "INVALID_ROOT", True)]


def test_inventory_snapshot(spark):
    item = lambda authority, name: {"providerResourceId": {"authorityId": authority, "canonicalId": name}}
    good = {"schemaVersion": documents.INVENTORY, "inputId": "in", "authorityId": "a", "asOf": "2026-07-12T00:00:00Z", "items": [item("a", "x"), item("b", "y"), item("a", "x")]}
    facts, gaps = parsed(spark, documents.inventory_snapshots, good, good | {"asOf": "2026-13-45T00:00:00Z"})
    assert [(f.resource.canonical_id, f.as_of) for f in facts] == [("x", "2026-07-12T00:00:00.000Z")]
    assert sorted(g.reason for g in gaps) == ["DUPLICATE_RESOURCE", "INVALID_ROOT", "INVALID_ROW"]


def test_discovery_walk(spark, tmp_path):
    for name, text in {"a.ts": "x", "b.min.js": "x", "sub/c.tsx": "xx", "node_modules/d.js": "x", "e.py": "x", "skip/f.js": "x", "keep.log.js": "x", ".gitignore": "skip/\n*.log.js\n!keep.log.js\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    sources, skips = discovery.discover(spark, [str(tmp_path)])
    assert {(s.path, s.language) for s in sources.collect()} == {("a.ts", "ts"), ("sub/c.tsx", "tsx"), ("keep.log.js", "js")}
    codes = {s.path: s.code for s in skips.collect()}
    assert codes["b.min.js"] == "GENERATED" and codes["node_modules/"] == "EXCLUDED_DIRECTORY" and codes["e.py"] == "UNSUPPORTED_FILE" and codes["skip/"] == "IGNORED" and codes["link.ts"] == "SYMLINK"
    assert {s.code for s in discovery.gap_skips(skips).collect()} == {"GENERATED", "IGNORED", "SYMLINK"}


def test_budget_stops_and_never_samples(spark):
    files = spark.createDataFrame([("r", i, 10, None) for i in range(10)], "root_id string, ord long, bytes long, code string")
    codes = [r.code for r in discovery.within_budget(files, 100, 35).orderBy("ord").collect()]
    assert codes == [None] * 3 + ["BUDGET_EXCEEDED"] * 7


def test_rejected_files_are_not_in_the_budget(spark):
    files = spark.createDataFrame([("r", i, 10, "OVERSIZE" if i % 2 else None) for i in range(10)], "root_id string, ord long, bytes long, code string")
    codes = [r.code for r in discovery.within_budget(files, 100, 35).orderBy("ord").collect()]
    assert codes == [None, "OVERSIZE"] * 3 + ["BUDGET_EXCEEDED", "OVERSIZE"] * 2


def test_a_line_end_is_part_of_no_safe_value(spark):
    c = F.col("v")
    rows = spark.createDataFrame([(v + end,) for v in ("KEY", "a/b") for end in ("", "\n", "\r\n", "\u2028")], "v string")
    got = rows.select(safety.environment_key(c).alias("k"), safety.generic_identifier(c).alias("i"), safety.safe_path(c, F.lit("/r")).alias("r"), safety.safe_path(c).alias("p"), safety.diagnostic_code(c).alias("d")).collect()
    assert [r.k for r in got] == ["KEY"] + [None] * 7
    assert [r.i for r in got] == ["KEY", None, None, None, "a/b", None, None, None]
    assert [r.p == safety.OPAQUE_PATH for r in got] == [False, True, True, True] * 2
    assert {r.r for r in got} == {safety.OPAQUE_PATH} and got[0].d == "KEY" and got[1].d == safety.UNSAFE_DIAGNOSTIC
    under = spark.createDataFrame([("/r/src/a.ts",), ("/root/a",)], "v string").select(safety.safe_path(c, F.lit("/r/")).alias("p")).collect()
    assert [u.p for u in under] == ["src/a.ts", safety.OPAQUE_PATH]


def test_manifest_text_and_roots(spark):
    text = '﻿{ // roots\n "a": [1, 2, /* x */ ], "b": "// not a comment, ]",\n}'
    assert manifest.parse_manifest(text) == {"a": [1, 2], "b": "// not a comment, ]"}
    with pytest.raises(ValueError):
        manifest.strip_json_comments('{"a": 1 /* open')
    roots = spark.createDataFrame([("a", "/w/a"), ("b", "/w/a/b"), ("c", "/w/ab"), ("d", "/w/a/")], "id string, root string")
    assert {tuple(r) for r in manifest.root_conflicts(roots).collect()} == {("a", "b", "ambiguous-repository-root"), ("d", "b", "ambiguous-repository-root"), ("a", "d", "duplicate-repository-root")}


def test_safe_values(spark):
    mixed = "aB3xY9kLmQ7zR" + "tW2uPe5HsDfG"
    values = ["DATABASE_URL", "lower_key", "sk_" + "live_abc", "gh" + "p_abc", mixed, "0" * 30, "src/a.ts", "../a", ""]
    row = {r.v: r for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", safety.environment_key(F.col("v")).alias("k"), safety.is_secret_like(F.col("v")).alias("s"), safety.safe_path(F.col("v")).alias("p"), safety.redacted(F.col("v")).alias("r")).collect()}
    assert [v for v in values if row[v].k] == ["DATABASE_URL"]
    assert [v for v in values if row[v].s] == ["sk_" + "live_abc", "gh" + "p_abc", mixed]
    assert row["src/a.ts"].p == "src/a.ts" and row["../a"].p == safety.OPAQUE_PATH and row[mixed].r == safety.OPAQUE
    stamps = spark.createDataFrame([("2026-07-12T00:00:00Z",), ("2026-02-30T00:00:00Z",), ("x",)], "v string").select(safety.timestamp(F.col("v")).alias("t")).collect()
    assert [s.t for s in stamps] == ["2026-07-12T00:00:00.000Z", None, None]


def test_timestamps_keep_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2023-03-12T02:30:00Z",), ("2023-01-31T23:59:07.250Z",), ("2023-02-29T00:00:00Z",), ("2023-01-01T00:00:00",)], "t string")
        assert [r.t for r in rows.select(safety.timestamp(F.col("t")).alias("t")).collect()] == ["2023-03-12T02:30:00.000Z", "2023-01-31T23:59:07.250Z", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

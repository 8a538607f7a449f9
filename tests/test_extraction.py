"""Extraction scenarios, and facts that hold no unsafe text."""

from __future__ import annotations

import pytest

from graphaxis.operators.extract.facts import facts, observations
from graphaxis.operators.extract.scan import observe


def shape(text, most=100):
    return [(o.exact, o.domain.kind, o.domain.keys, o.domain.prefix, o.domain.suffix, o.domain.reason, o.domain.origin) for o in observe(text, most)[0]]


def exact(*names):
    return [(True, "finite", (n,), "", "", "", "lexical") for n in names]


USER = (False, "unbounded", (), "", "", "user-controlled", "user-controlled")
OPAQUE = (False, "unbounded", (), "", "", "opaque", "opaque")


@pytest.mark.parametrize(
    "text, want",
    [
        ("const url = process.env.DATABASE_URL;", exact("DATABASE_URL")),
        ('const e = process.env; const {A, B: c, ["C_" + "D"]: d} = e; e["R_" + "T"];', exact("A", "B", "C_D", "R_T")),
        ('process.env[f ? "X1" : "X2"]', [(False, "finite", ("X1", "X2"), "", "", "", "lexical")]),
        ("process.env[`SERVICE_${request.query.region}`]", [(False, "pattern", (), "SERVICE_", "", "", "user-controlled")]),
        ('process.env["BEFORE_" + request.query.key + "_AFTER"]', [(False, "pattern", (), "BEFORE_", "_AFTER", "", "user-controlled")]),
        ("export function f(key) { return process.env[key]; } process.env[request.query.key]; process.env[process.argv[2]]", [USER] * 3),
        ("function handler(key) { return process.env[key]; } export { handler };", [USER]),
        ("export default (key) => process.env[key];", [USER]),
        ("const g = k => process.env[k];", [OPAQUE]),
        ("Object.keys(process.env); for (const k in process.env) {} const x = {...process.env};", [OPAQUE] * 3),
        ("function a() { return process.env; } call(process.env); let e = process.env; o.x = process.env; const p = {env: process.env};", [OPAQUE] * 5),
        ('const M = {a: "AA", b: "BB"}; process.env[M[request.query.x]]', [(False, "finite", ("AA", "BB"), "", "", "", "user-controlled")]),
        ('import.meta.env?.X; Bun.env["Y"]; Deno.env.get("Z"); process?.env?.KEY; (process.env as any).CAST; process.env!.BANG', exact("X", "Y", "Z", "KEY", "CAST", "BANG")),
        ("const process = {env: {}}; process.env.NOPE", []),
        ("import process from 'x'; process.env.NOPE", []),
        ("const { A, ...rest } = process.env;", [*exact("A"), OPAQUE]),
        ("x = `${process.env.C}`; // process.env.COMMENT\n'process.env.STRING'", exact("C")),
    ],
)
def test_forms(text, want):
    assert shape(text) == want


def test_budget_and_failure():
    assert shape('process.env[a ? "K1" : b ? "K2" : "K3"]', 2) == [(False, "unbounded", (), "", "", "over-budget", "lexical")]
    assert observe("export const = ;")[1] and not observe("const a = 1;")[1]


def test_unsafe_keys_leave_no_text(spark):
    sentinel = "lower-" + "sentinel"
    files = [(0, "src/a.ts", f'process.env["{sentinel}"]; process.env.GOOD;'), (1, "src/b.ts", "export const = ;"), (2, "src/c.ts", None)]
    refs, lookups, gaps = facts(observations(spark.createDataFrame(files, "ord long, path string, content string")))
    assert [r.key.name for r in refs.collect()] == ["GOOD"]
    shown = lookups.collect()
    assert [(r.kind, r.reason) for r in shown] == [("unbounded", "opaque")] and sentinel not in str(shown)
    assert sorted(g.reason for g in gaps.collect()) == ["PARSE_FAILURE", "UNREADABLE"]

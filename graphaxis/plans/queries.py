"""One query per operator over derived facts, and DuckDB SQL written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P
from graphaxis.functions import safety
from graphaxis.operators import bindings, reconcile, workspace
from graphaxis.operators.extract.facts import observations
from graphaxis.plans import derive, report
from graphaxis.plans.store import large, settled
from graphaxis.sources import discovery, manifest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def flat_scope(scope: str = "scope") -> list[Column]:
    s = F.col(scope)
    stage = F.when(s["stage"]["kind"] == "exact", F.array_join(F.array_sort(s["stage"]["values"]), ",")).otherwise(s["stage"]["kind"])
    return [s["id"].alias("unit"), s["phase"].alias("phase"), stage.alias("stage")]


# --- SQL shared by the oracles -------------------------------------------------------------

_CANDIDATES = """
sold AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp, n_regionkey AS region,
    CASE WHEN l_suppkey % 17 = 0 THEN 'all' ELSE l_returnflag END AS stage,
    CASE WHEN l_linestatus = 'F' THEN 'build' ELSE 'runtime' END AS phase
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cand AS (SELECT *, 'cand-' || ((part * 100000 + supp) * 8 + CASE stage WHEN 'all' THEN 3 WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2
      + CASE phase WHEN 'build' THEN 0 ELSE 1 END) AS id,
    CASE WHEN part % 97 <> 0 THEN 'PART_' || part END AS name, 'REGION_' || region AS unit, supp % 7 AS rank,
    supp % 11 <> 0 AS comparable, supp % 13 = 0 AS dyn, CASE WHEN supp % 19 <> 0 THEN 'AUTH_' || region END AS authority,
    CASE WHEN part % 5 = 0 AND supp % 3 = 0 THEN 'eq' WHEN part % 5 = 0 AND supp % 3 = 1 THEN 'ne' ELSE 'always' END AS cond FROM sold)
"""
_SLOTS = _CANDIDATES + """,
slotted AS (SELECT *, CASE WHEN name IS NULL THEN id ELSE unit || '/' || phase || '/' || stage || '/' || name END AS slot FROM cand),
shaped AS (SELECT slot, bool_or(cond <> 'always') AS branched FROM slotted GROUP BY slot),
parts AS (SELECT slot, 'main' AS branch FROM shaped WHERE branched UNION ALL SELECT slot, 'other' FROM shaped WHERE branched
  UNION ALL SELECT slot, 'any' FROM shaped WHERE NOT branched),
used AS (SELECT s.*, branch, cond = 'always' OR (cond = 'eq' AND branch = 'main') OR (cond = 'ne' AND branch = 'other') AS applies
  FROM slotted s JOIN parts USING (slot)),
judged AS (SELECT slot, branch, count(*) FILTER (applies) AS n, coalesce(bool_or(dyn) FILTER (applies), false) AS any_dyn,
    coalesce(bool_or(NOT comparable) FILTER (applies), false) AS bad, max(rank) FILTER (applies) AS top FROM used GROUP BY slot, branch),
tied AS (SELECT slot, branch, count(*) AS n_top FROM used JOIN judged USING (slot, branch) WHERE applies AND rank = top GROUP BY slot, branch),
outcomes AS (SELECT slot, branch, n, top, CASE WHEN n = 0 OR any_dyn THEN 'unresolved' WHEN n = 1 THEN 'effective'
    WHEN bad OR n_top > 1 THEN 'conflicting' ELSE 'effective' END AS outcome FROM judged LEFT JOIN tied USING (slot, branch)),
chosen AS (SELECT u.slot, u.branch, u.id, u.unit, u.phase, u.stage, u.name, u.part, u.authority, u.dyn, CASE WHEN NOT applies THEN 'inapplicable' WHEN outcome <> 'effective' THEN outcome
    WHEN n = 1 OR rank = top THEN 'effective' ELSE 'shadowed' END AS status FROM used u JOIN outcomes USING (slot, branch))
"""
_DEMAND = """
reads AS (SELECT DISTINCT l_partkey AS part, n_regionkey AS region, l_returnflag AS stage,
    CASE WHEN l_linestatus = 'F' THEN 'build' ELSE 'runtime' END AS phase
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
direct AS (SELECT 'REGION_' || region AS unit, phase, stage, 'PART_' || part AS name, 3 AS d,
    CASE WHEN part % 4 = 0 THEN 3 ELSE 4 END AS t, 'ref-' || part AS ref FROM reads WHERE part % 97 <> 0 AND part % 23 <> 0),
ev AS (SELECT DISTINCT user_id % 5 AS region, event_type, length(event_type) AS n FROM events),
kinds AS (SELECT *, 'REGION_' || region AS unit, CASE WHEN n % 3 = 2 AND region = 3 THEN 'unbounded' WHEN n % 3 = 1 THEN 'pattern' ELSE 'finite' END AS kind FROM ev),
reach AS (SELECT k.region AS region, event_type, list(DISTINCT name) AS names FROM kinds k JOIN cand c ON c.unit = k.unit AND c.phase = 'runtime' AND c.stage IN ('A', 'all')
    AND starts_with(name, 'PART_1' || (k.region + 2)) WHERE kind = 'pattern' GROUP BY ALL),
valid AS (SELECT k.*, coalesce(len(names), 0) > 64 AS over, CASE WHEN kind = 'finite' THEN ['PART_' || (region * 10 + n * 100 + 1), 'PART_' || (region * 10 + n * 100 + 2), 'PART_' || (region * 10 + n * 100 + 3)]
    WHEN kind = 'pattern' AND coalesce(len(names), 0) <= 64 THEN coalesce(names, []) ELSE [] END AS keys FROM kinds k LEFT JOIN reach USING (region, event_type)),
looked AS (SELECT unit, 'runtime' AS phase, 'A' AS stage, unnest(keys) AS name, CASE kind WHEN 'finite' THEN 2 ELSE 1 END AS d, 0 AS t, 'dref-' || event_type AS ref FROM valid),
wanted AS (SELECT unit, phase, stage, name, max(d) AS d, max(t) AS t, count(DISTINCT ref) AS n_refs FROM (FROM direct UNION ALL FROM looked) GROUP BY ALL),
gap AS (SELECT 'gap-' || n_nationkey AS id, 'REGION_' || n_regionkey AS unit, 'PART_' || (n_nationkey % 9 + 1) AS prefix, n_nationkey AS o FROM nation WHERE n_nationkey % 6 = 0),
open_units AS (SELECT DISTINCT unit FROM valid WHERE kind = 'unbounded' OR over)
"""


# --- Predicates ----------------------------------------------------------------------------

_STAGES = [("all", []), ("unknown", []), ("exact", ["A"]), ("exact", ["A", "N"]), ("exact", ["N", "R"]), ("exact", []), ("exact", ["A", "A"])]


def _stage_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(i, (k, v)) for i, (k, v) in enumerate(_STAGES)], f"{name}_id int, {name} struct<kind:string,values:array<string>>")


_STAGE_VALUES = ", ".join(f"({i}, '{k}', [{', '.join(repr(x) for x in v)}]::VARCHAR[])" for i, (k, v) in enumerate(_STAGES))


@query(f"""
WITH s(i, k, v) AS (VALUES {_STAGE_VALUES})
SELECT a.i AS a_id, b.i AS b_id,
  CASE WHEN a.k = 'unknown' OR b.k = 'unknown' THEN false WHEN a.k = 'all' THEN true WHEN b.k = 'all' THEN false ELSE list_has_all(a.v, b.v) END AS covers,
  CASE WHEN a.k IN ('all', 'unknown') OR b.k IN ('all', 'unknown') THEN true ELSE list_has_any(a.v, b.v) END AS overlaps
FROM s a, s b
""")
def p3_p4_stage_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _stage_table(spark, "a"), _stage_table(spark, "b")
    return a.crossJoin(b).select("a_id", "b_id", P.stage_covers(F.col("a"), F.col("b")).alias("covers"), P.stages_overlap(F.col("a"), F.col("b")).alias("overlaps"))  # 7 x 7 rows of a truth table


# Prefixes of well-known credentials.
_SECRET_PREFIXES = """
    regexp_matches(w, '^sk_(live|test)_', 'i') OR regexp_matches(w, '^rk_(live|test)_', 'i') OR regexp_matches(w, '^pk_(live|test)_', 'i')
    OR regexp_matches(w, '^gh[pousr]_') OR regexp_matches(w, '^github_pat_', 'i') OR regexp_matches(w, '^glpat-', 'i') OR regexp_matches(w, '^xox[abprs]-', 'i')
    OR regexp_matches(w, '^AKIA[0-9A-Z]{16}$') OR regexp_matches(w, '^ASIA[0-9A-Z]{16}$') OR regexp_matches(w, '^AIza[0-9A-Za-z_-]{20,}$')
    OR regexp_matches(w, '^ya29\\.[0-9A-Za-z_-]{10,}$') OR regexp_matches(w, '^npm_[0-9A-Za-z]{20,}$') OR regexp_matches(w, '^eyJ[0-9A-Za-z_-]{10,}\\.')"""
_MIXED = """(length(z) >= 24 AND regexp_matches(z, '[a-z]') AND regexp_matches(z, '[A-Z]') AND regexp_matches(z, '[0-9]')
      AND (SELECT entropy(x) FROM (SELECT unnest(string_split(z, '')) AS x)) >= 3.5)"""


@query("""
WITH t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> ''),
c AS (SELECT w, regexp_replace(w, '[._:@/-]', '', 'g') AS z FROM t),
e AS (SELECT w, """ + _SECRET_PREFIXES + """
    OR (length(z) >= 24 AND regexp_matches(z, '[a-z]') AND regexp_matches(z, '[A-Z]') AND regexp_matches(z, '[0-9]')
      AND (SELECT entropy(x) FROM (SELECT unnest(string_split(z, '')) AS x)) >= 3.5) AS secret FROM c)
SELECT w AS token, secret, CASE WHEN NOT secret AND regexp_matches(w, '^[A-Z_][A-Z0-9_]{0,255}$') THEN w END AS env_key,
  CASE WHEN NOT secret AND regexp_matches(w, '^[A-Za-z0-9][A-Za-z0-9._:@/-]{0,255}$') THEN w END AS identifier FROM e
""")
def v1_v2_v4_safe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = derive.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\\s+")).alias("token")).where("token <> ''").distinct()
    t = F.col("token")
    return words.select("token", safety.is_secret_like(t).alias("secret"), safety.environment_key(t).alias("env_key"), safety.generic_identifier(t).alias("identifier"))


@query("""
SELECT w AS token, round((SELECT entropy(x) FROM (SELECT unnest(string_split(w, '')) AS x)), 6) AS entropy
FROM (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE regexp_matches(w, '^[!-~]+$'))
""")
def v5_shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = derive.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\\s+")).alias("token")).where(F.col("token").rlike("^[!-~]+$")).distinct()
    return words.select("token", F.round(safety.shannon_entropy(F.col("token")), 6).alias("entropy"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages),
t AS (SELECT page_id, w, regexp_replace(w, '[._:@/-]', '', 'g') AS z FROM (SELECT page_id, unnest(string_split(p, '/')) AS w FROM p)),
bad AS (SELECT DISTINCT page_id FROM t WHERE NOT regexp_matches(w, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') OR """ + _SECRET_PREFIXES + " OR " + _MIXED + """)
SELECT page_id, p AS path, CASE WHEN page_id IN (FROM bad) THEN '<opaque-path>' ELSE p END AS safe FROM p
""")
def v6_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return derive.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), safety.safe_path(path).alias("safe"))


# --- Bindings ------------------------------------------------------------------------------


@query(f"WITH {_SLOTS} SELECT id AS candidate_id, branch, status FROM chosen")
def w1_a3_u6_binding_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = bindings.resolve(derive.kept(derive.candidates(spark, sf_dir)))
    clause = F.get(F.col("applies_when.condition.clauses"), F.lit(0))
    branch = F.when(clause.isNull(), "any").when(clause["operator"] == "equals", "main").otherwise("other")
    parts = resolved.partitions.select("slot", "part", branch.alias("branch"))
    return parts.join(large(resolved.selections), ["slot", "part"]).select("candidate_id", "branch", "status")


@query(f"WITH {_SLOTS} SELECT outcome, branch, count(*) AS n FROM outcomes GROUP BY ALL")
def c2_partition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = bindings.resolve(derive.kept(derive.candidates(spark, sf_dir)))
    clause = F.get(F.col("applies_when.condition.clauses"), F.lit(0))
    branch = F.when(clause.isNull(), "any").when(clause["operator"] == "equals", "main").otherwise("other")
    return resolved.partitions.groupBy("outcome", branch.alias("branch")).agg(F.count(F.lit(1)).alias("n"))


# --- Records -------------------------------------------------------------------------------

_DEMAND_RECORDS = f"""
WITH {_SLOTS}, {_DEMAND},
met AS (SELECT w.unit, w.phase, w.stage, w.name, slot FROM wanted w JOIN (SELECT DISTINCT slot, unit, phase, stage, name FROM slotted WHERE name IS NOT NULL) s
    ON w.unit = s.unit AND w.phase = s.phase AND w.name = s.name AND s.stage IN (w.stage, 'all')),
slot_state AS (SELECT slot, bool_and(outcome = 'effective') AS settled, bool_or(outcome = 'conflicting') AS conflict,
    bool_or(outcome = 'unresolved') OR (bool_or(outcome = 'effective') AND NOT bool_and(outcome = 'effective')) AS open FROM outcomes GROUP BY slot),
state AS (SELECT unit, phase, stage, name, bool_or(settled) AS settled, bool_or(conflict) AS conflict, bool_or(open) AS open FROM met JOIN slot_state USING (slot) GROUP BY ALL),
eff AS (SELECT m.unit, m.phase, m.stage, m.name, count(DISTINCT id) AS n_eff, min(id) AS one FROM met m JOIN chosen c USING (slot)
    WHERE c.status = 'effective' AND NOT c.dyn GROUP BY ALL),
lone AS (SELECT e.*, (SELECT any_value(authority) FROM cand WHERE id = one) AS authority FROM eff e),
listed AS (SELECT 'PART_' || p_partkey AS name, 'AUTH_' || r AS authority FROM part, range(5) t(r) WHERE p_size % 10 <> 0),
g AS (SELECT w.unit, w.phase, w.stage, w.name, string_agg(id, ',' ORDER BY o) AS gaps FROM wanted w JOIN (SELECT id, unit, prefix, o FROM gap) x
    ON w.unit = x.unit AND starts_with(w.name, x.prefix) GROUP BY ALL),
a AS (SELECT w.*, settled, conflict, open, coalesce(n_eff, 0) AS n_eff, l.authority, one, i.name IS NOT NULL AS is_listed,
    concat_ws(',', gaps, CASE WHEN w.phase = 'build' AND w.stage = 'R' AND w.name IN ('PART_7', 'PART_77', 'PART_177') THEN 'gap-wild' END) AS gaps,
    w.phase = 'runtime' AND w.stage = 'A' AND w.unit IN (SELECT unit FROM open_units) AS unsure
  FROM wanted w LEFT JOIN state USING (unit, phase, stage, name) LEFT JOIN lone l USING (unit, phase, stage, name)
  LEFT JOIN listed i ON i.name = w.name AND i.authority = l.authority AND n_eff = 1 LEFT JOIN g USING (unit, phase, stage, name)),
b AS (SELECT *, CASE WHEN settled THEN 'exact-declared' WHEN conflict THEN 'conflicting' WHEN open THEN 'unresolved' WHEN n_eff = 1 THEN 'exact-declared'
    WHEN n_eff > 1 THEN 'unresolved' ELSE 'no-static-evidence' END AS binding, CASE WHEN gaps = '' THEN 'complete' ELSE 'incomplete' END AS coverage FROM a),
c AS (SELECT *, CASE WHEN unsure THEN 'unknown' WHEN n_eff = 1 AND authority IS NULL THEN 'unknown' WHEN n_eff = 1 AND is_listed THEN 'bound'
    WHEN binding = 'exact-declared' AND n_eff > 1 THEN 'unknown' WHEN binding IN ('exact-declared', 'no-static-evidence') THEN 'missing' ELSE 'unbound' END AS inventory FROM b)
SELECT unit, phase, stage, name, CAST(n_refs AS BIGINT) AS n_refs, CASE d WHEN 3 THEN 'present' WHEN 2 THEN 'finite-dynamic' ELSE 'pattern-dynamic' END AS demand,
  CASE t WHEN 4 THEN 'deployable' WHEN 3 THEN 'consumer-derived' ELSE 'unknown-target' END AS target_discovery, binding, inventory, coverage,
  CASE WHEN coverage = 'incomplete' OR unsure OR binding IN ('conflicting', 'unresolved') OR inventory = 'unknown' THEN 'inconclusive'
    WHEN inventory = 'missing' OR binding = 'no-static-evidence' THEN 'review' ELSE 'informational' END AS disposition,
  CASE WHEN gaps = '' THEN NULL ELSE gaps END AS gap_ids FROM c
"""


def _gap_list() -> Column:
    said = F.get(F.filter("reasons", lambda r: F.startswith(r, F.lit("CORE_COVERAGE_INCOMPLETE:"))), F.lit(0))
    return F.regexp_replace(said, "^CORE_COVERAGE_INCOMPLETE:", "")


@query(_DEMAND_RECORDS)
def c4_c5_c9_demand_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derive.records(spark, sf_dir).demand
    return r.select(
        *flat_scope(), F.col("key.name").alias("name"), F.size("reference_ids").cast("long").alias("n_refs"), "demand", "target_discovery",
        "binding", "inventory", "coverage", "disposition", _gap_list().alias("gap_ids"),
    )


_INVENTORY_RECORDS = f"""
WITH {_SLOTS}, {_DEMAND},
winners AS (SELECT DISTINCT id, unit, phase, stage, name, part, authority FROM chosen WHERE status = 'effective' AND authority IS NOT NULL),
listed AS (SELECT p_partkey AS part, 'AUTH_' || r AS authority, 'REGION_' || r AS unit FROM part, range(5) t(r) WHERE p_size % 10 <> 0),
bound AS (SELECT w.id, w.unit, w.phase, w.stage, w.name, w.part, w.authority FROM winners w JOIN listed l ON w.part = l.part AND w.authority = l.authority),
firsts AS (SELECT b.id, max(w.d) AS best, bool_or(true) AS seen FROM bound b JOIN wanted w ON b.unit = w.unit AND b.phase = w.phase AND b.name = w.name AND b.stage IN (w.stage, 'all') GROUP BY b.id),
blocked AS (SELECT b.id FROM bound b JOIN gap g ON b.unit = g.unit AND starts_with(b.name, g.prefix)
  UNION SELECT id FROM bound WHERE phase = 'build' AND stage IN ('R', 'all') AND name IN ('PART_7', 'PART_77', 'PART_177')
  UNION SELECT id FROM bound WHERE phase = 'runtime' AND stage = 'A' AND unit IN (SELECT unit FROM open_units))
SELECT id AS candidate_id, 'PART_' || part AS resource, CASE WHEN id IN (FROM blocked) THEN 'unknown' WHEN seen THEN 'bound' ELSE 'inventory-listed-no-static-read' END AS inventory,
  CASE WHEN id IN (FROM blocked) THEN 'inconclusive' ELSE NULL END AS blocked, name, unit, CASE WHEN id IN (FROM blocked) THEN 'inconclusive' WHEN seen AND best = 3 THEN 'informational' ELSE 'review' END AS disposition
FROM bound LEFT JOIN firsts USING (id)
UNION ALL
SELECT NULL, 'PART_' || part, 'unbound', NULL, NULL, CASE WHEN part % 50 = 0 THEN unit END, 'review' FROM listed l WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.part = l.part AND b.authority = l.authority)
"""


@query(f"SELECT candidate_id, resource, inventory, blocked FROM ({_INVENTORY_RECORDS})")
def c6_c7_inventory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derive.records(spark, sf_dir).inventory
    said = F.get(F.filter("reasons", lambda x: F.startswith(x, F.lit("CORE_BINDING_CANDIDATE:"))), F.lit(0))
    blocked = F.when(F.col("disposition") == "inconclusive", F.col("disposition"))
    return r.select(F.regexp_replace(said, "^CORE_BINDING_CANDIDATE:", "").alias("candidate_id"), F.col("resource.canonical_id").alias("resource"), "inventory", blocked.alias("blocked"))


@query(f"""
WITH {_CANDIDATES}, {_DEMAND}
SELECT 'dynamic-' || region || '-' || event_type AS lookup_id, CASE WHEN kind = 'unbounded' OR over THEN 'unbounded-' || CASE WHEN n % 2 = 0 THEN 'user-controlled' ELSE 'unknown' END
    ELSE kind || '-dynamic' END AS demand, CASE WHEN kind = 'unbounded' OR over THEN 'dynamic' ELSE 'possible' END AS binding,
  CASE WHEN kind = 'unbounded' OR over OR EXISTS (SELECT 1 FROM gap g WHERE g.unit = v.unit) THEN 'incomplete' ELSE 'complete' END AS coverage,
  CASE WHEN kind = 'unbounded' OR over THEN 'inconclusive' ELSE 'review' END AS disposition, CAST(len(keys) AS BIGINT) AS n_keys FROM valid v
""")
def c1_c8_dynamic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derive.records(spark, sf_dir).dynamic
    return r.select("lookup_id", "demand", "binding", "coverage", "disposition", F.size("likely_keys").cast("long").alias("n_keys"))


@query(f"""
WITH {_CANDIDATES}, {_DEMAND},
scopes AS (SELECT DISTINCT unit, phase, stage FROM wanted UNION SELECT DISTINCT unit, phase, stage FROM cand UNION SELECT DISTINCT unit, 'runtime', 'A' FROM valid
  UNION SELECT 'REGION_' || r, 'runtime', 'A' FROM part, range(5) t(r) WHERE p_size % 10 <> 0 AND p_partkey % 50 = 0),
hit AS (SELECT s.*, id, o FROM scopes s JOIN gap USING (unit) UNION ALL SELECT *, 'gap-wild', 1000 FROM scopes WHERE phase = 'build' AND stage IN ('R', 'all'))
SELECT unit, phase, stage, CASE WHEN count(id) > 0 THEN 'incomplete' ELSE 'complete' END AS state, string_agg(id, ',' ORDER BY o) AS gap_ids
FROM scopes LEFT JOIN hit USING (unit, phase, stage) GROUP BY ALL
""")
def j9_a2_scope_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derive.records(spark, sf_dir).scopes
    return r.select(*flat_scope(), "state", F.when(F.size("gap_ids") > 0, F.array_join("gap_ids", ",")).alias("gap_ids"))


@query("""
WITH reads AS (SELECT DISTINCT l_partkey AS part, n_nationkey AS nation, n_regionkey AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_partkey % 97 <> 0),
members AS (SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1)
SELECT 'REGION_' || region AS deployment, 'PART_' || part AS name FROM reads JOIN members USING (region) GROUP BY region, part, n HAVING count(DISTINCT nation) = n AND n >= 2
""")
def a6_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that every member of a deployment reads (relational division by counting)."""
    deployment = lambda region: F.concat(F.lit("REGION_"), F.col(region).cast("string")).alias("deployment_id")
    members = derive.table(spark, sf_dir, "nation").select(deployment("n_regionkey"), F.col("n_nationkey").alias("repository_id"))
    demand = derive.read(spark, sf_dir).where("part % 97 <> 0").select(deployment("region"), F.col("nation").alias("repository_id"), derive.key(F.col("part")).alias("key"))
    return workspace.shared_keys(members, demand).select(F.col("deployment_id").alias("deployment"), F.col("key.name").alias("name"))


# --- Reports -------------------------------------------------------------------------------


@query(f"""
WITH d AS ({_DEMAND_RECORDS}), i AS ({_INVENTORY_RECORDS}),
u AS (SELECT name, unit || '/' || phase || '/' || stage AS place, disposition FROM d WHERE name IS NOT NULL
  UNION ALL SELECT name, NULL, disposition FROM i WHERE name IS NOT NULL)
SELECT 'env:' || name AS group_key, count(*) AS n_uses, count(DISTINCT place) AS n_scopes, count(DISTINCT place) > 1 AS shared,
  CASE max(CASE disposition WHEN 'inconclusive' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) WHEN 2 THEN 'inconclusive' WHEN 1 THEN 'review' ELSE 'informational' END AS disposition
FROM u GROUP BY name
UNION ALL SELECT 'opaque:' || candidate_id, 1, 0, false, disposition FROM i WHERE name IS NULL AND candidate_id IS NOT NULL
""")
def a8_report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all uses by key, shared over scopes, with their worst disposition; opaque keys form one each."""
    r = derive.records(spark, sf_dir)
    return report.groups(r.demand, r.inventory).select("group_key", "n_uses", "n_scopes", "shared", "disposition")


_SARIF = f"""
WITH d AS ({_DEMAND_RECORDS}), i AS ({_INVENTORY_RECORDS}),
y AS (WITH {_CANDIDATES}, {_DEMAND} SELECT unit, kind = 'unbounded' OR over AS unbounded, n % 2 = 0 AS by_user FROM valid),
r AS (SELECT CASE WHEN inventory = 'missing' THEN 'SRI002' ELSE 'SRI003' END AS rule_id, unit FROM d WHERE inventory = 'missing' OR disposition = 'inconclusive'
  UNION ALL SELECT CASE WHEN inventory = 'inventory-listed-no-static-read' THEN 'SRI001' ELSE 'SRI003' END, unit FROM i
    WHERE inventory = 'inventory-listed-no-static-read' OR disposition = 'inconclusive'
  UNION ALL SELECT CASE WHEN unbounded AND by_user THEN 'SRI005' ELSE 'SRI004' END, unit FROM y)
"""


@query(f"{_SARIF} SELECT rule_id, unit, count(*) AS n FROM r GROUP BY ALL")
def c13_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all records, dynamic lookups included."""
    r = derive.records(spark, sf_dir)
    # One kind after another, so that no plan of the driver holds all records and none is left to whoever reads the result.
    kinds = (lambda: report.demand_results(r.demand), lambda: report.inventory_results(r.inventory), lambda: report.lookup_results(r.dynamic))
    d, i, y = [settled(make().groupBy("rule_id", "unit").agg(F.count(F.lit(1)).alias("n"))) for make in kinds]
    return d.unionByName(i).unionByName(y).groupBy("rule_id", "unit").agg(F.sum("n").alias("n"))


@query(f"""{_SARIF} SELECT rule_id, CASE rule_id WHEN 'SRI005' THEN 'error' WHEN 'SRI001' THEN 'note' ELSE 'warning' END AS level, count(*) AS n FROM r GROUP BY ALL""")
def g3_sarif_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the sink writes, read back: results by rule and level."""
    r = derive.records(spark, sf_dir)
    log = report.sarif(report.sarif_results(r.demand, r.inventory, r.dynamic))
    line = F.regexp_replace("text", "^,", "")
    result = log.where("at.part = 1").select(F.from_json(line, "struct<ruleId:string,level:string>").alias("x"))
    return result.groupBy(F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH d AS ({_DEMAND_RECORDS}), i AS ({_INVENTORY_RECORDS}),
u AS (SELECT name, 'demand' AS kind FROM d WHERE name IS NOT NULL UNION ALL SELECT name, 'inventory' FROM i WHERE name IS NOT NULL)
SELECT name, count(*) AS n_uses, count(*) FILTER (kind = 'demand') AS n_demand FROM u GROUP BY name
""")
def g1_nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their uses nested, as the JSON report has them; opaque ones are left to a8."""
    r = derive.records(spark, sf_dir)
    found = report.nested(r.demand, r.inventory).where("name <> '<opaque>'")
    return found.select("name", F.size("uses").cast("long").alias("n_uses"), F.size(F.filter("uses", lambda u: u["kind"] == "demand")).cast("long").alias("n_demand"))


@query(f"""
SELECT unit, phase, stage, binding, inventory, coverage, disposition FROM ({_DEMAND_RECORDS}) WHERE name = 'PART_7'
""")
def g4_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand records of one key."""
    r = derive.records(spark, sf_dir)
    return report.explain(r.demand_of("env", "PART_7"), "env:PART_7").select(*flat_scope(), "binding", "inventory", "coverage", "disposition")


@query(f"""
WITH d AS ({_DEMAND_RECORDS})
SELECT bool_or(coverage = 'incomplete') AS incomplete FROM d
""")
def a13_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any scope or demand leaves the whole incomplete."""
    r = derive.records(spark, sf_dir)
    return report.incomplete(r.scopes, r.demand_coverage)


# --- Sources -------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '/a.ts' WHEN 1 THEN '/b.min.js' WHEN 2 THEN '/node_modules/c.JS' WHEN 3 THEN '/d.d.ts' ELSE '/e.py' END AS path FROM pages)
SELECT page_id, path, CASE WHEN page_id % 5 = 2 THEN 'EXCLUDED_DIRECTORY' WHEN page_id % 5 IN (1, 3) THEN 'GENERATED' WHEN page_id % 5 = 4 THEN 'UNSUPPORTED_FILE' END AS code,
  CASE page_id % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'js' WHEN 2 THEN 'js' WHEN 3 THEN 'ts' END AS language FROM p
""")
def s2_s3_s5_file_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    name = F.when(n == 0, "/a.ts").when(n == 1, "/b.min.js").when(n == 2, "/node_modules/c.JS").when(n == 3, "/d.d.ts").otherwise("/e.py")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), name)
    listing = derive.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.lit(1).alias("bytes"), F.lit(1).alias("depth"), F.lit("file").alias("kind"), F.lit(False).alias("ignored"))
    return discovery.classify(listing).select("page_id", "path", "code", "language")


@query("""
WITH o AS (SELECT p_partkey % 5 AS root, p_partkey AS ord, p_size * 1000 AS bytes, p_partkey % 7 <> 0 AS good FROM part),
s AS (SELECT *, count(*) FILTER (good) OVER w AS n, coalesce(sum(bytes) FILTER (good) OVER w, 0) AS b FROM o WINDOW w AS (PARTITION BY root ORDER BY ord))
SELECT 'root-' || root AS root_id, count(*) FILTER (good AND n <= 300 AND b <= 5000000) AS n_in, count(*) FILTER (good AND NOT (n <= 300 AND b <= 5000000)) AS n_out,
  count(*) FILTER (NOT good) AS n_rejected FROM s GROUP BY root
""")
def b1_discovery_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file over the budget stops its root; rejected files don't count; nothing is sampled."""
    n = F.col("p_partkey")
    files = derive.table(spark, sf_dir, "part").select(
        F.concat(F.lit("root-"), (n % 5).cast("string")).alias("root_id"), n.alias("ord"), (F.col("p_size") * 1000).cast("long").alias("bytes"), F.when(n % 7 == 0, "GENERATED").alias("code")
    )
    judged = discovery.within_budget(files, 300, 5_000_000)
    return judged.groupBy("root_id").agg(F.count_if(F.col("code").isNull()).alias("n_in"), F.count_if(F.col("code") == "BUDGET_EXCEEDED").alias("n_out"), F.count_if(F.col("code") == "GENERATED").alias("n_rejected"))


@query("""
SELECT 'r' || a.o_custkey AS outer_id, 'r' || b.o_custkey AS inner_id, 'ambiguous-repository-root' AS code
FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 10 = 0) a JOIN (SELECT DISTINCT o_custkey FROM orders) b ON b.o_custkey // 10 = a.o_custkey // 10 AND b.o_custkey % 10 <> 0
""")
def d7_root_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots /w/<tens> and /w/<tens>/<unit>: every tenth repository contains its nine neighbours."""
    c = F.col("o_custkey")
    tens = F.concat(F.lit("/w/"), F.floor(c / 10).cast("string"))
    root = F.when(c % 10 == 0, tens).otherwise(F.concat(tens, F.lit("/"), (c % 10).cast("string")))
    roots = derive.table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.concat(F.lit("r"), c.cast("string")).alias("id"), root.alias("root"))
    return manifest.root_conflicts(roots)


# --- Workspaces ----------------------------------------------------------------------------


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deployment; a member for each region but the last, reading at run time in stage A."""
    region = derive.table(spark, sf_dir, "region").where("r_regionkey < 4")
    return region.select(F.lit("all").alias("deployment_id"), F.concat(F.lit("repo-"), F.col("r_regionkey").cast("string")).alias("repository_id"), derive.scope(F.col("r_regionkey"), F.lit("runtime"), derive.stage("exact", F.lit("A"))).alias("scope"))


@query(f"""
WITH {_CANDIDATES}
SELECT 'repo-' || region AS repository_id, CASE WHEN phase = 'runtime' AND stage IN ('A', 'all') THEN 'assign' ELSE 'uncertain' END AS relation, count(*) AS n FROM cand WHERE region < 4 GROUP BY ALL
UNION ALL SELECT 'repo-' || r, 'stray', count(*) FROM cand, range(4) t(r) WHERE region = 4 GROUP BY r
""")
def j16_candidate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = derive.kept(derive.candidates(spark, sf_dir).withColumn("deployment_id", F.lit("all")))
    found = workspace.candidate_members(derive.kept(_members(spark, sf_dir)), candidates).join(candidates.select(F.col("id").alias("candidate_id"), F.col("scope.id").alias("unit")), "candidate_id")
    relation = F.when(F.col("unit") == "REGION_4", "stray").otherwise(F.col("relation"))
    return found.groupBy("repository_id", relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH listed AS (SELECT p_partkey AS part, r FROM part, range(5) t(r) WHERE p_size % 10 <> 0),
bound AS (SELECT part, r, m FROM listed, range(4) t(m) WHERE part % 7 = m)
SELECT 'repo-' || m AS repository_id, 'assign' AS relation, 'O2' AS reason, count(*) AS n FROM bound WHERE part % 50 <> 0 GROUP BY m
UNION ALL SELECT 'repo-' || m, 'uncertain', 'UNATTRIBUTED_INVENTORY', count(*) FROM listed, range(4) t(m) WHERE part % 50 <> 0 AND part % 7 > 3 GROUP BY m
UNION ALL SELECT 'repo-' || r, 'assign', 'O4', count(*) FROM listed WHERE part % 50 = 0 AND r < 4 GROUP BY r
UNION ALL SELECT 'repo-' || m, 'uncertain', 'O3', count(*) FROM listed, range(4) t(m) WHERE part % 50 = 0 AND r = 4 GROUP BY m
""")
def j18_inventory_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh part is bound by one member; the others have no owner unless they declare one."""
    items = derive.inventory(spark, sf_dir).withColumn("deployment_id", F.lit("all")).withColumn("id", F.concat_ws("/", "resource.authority_id", "resource.canonical_id"))
    items = derive.kept(items)
    part = F.regexp_extract("resource.canonical_id", "_(\\d+)$", 1).cast("long")
    exact = items.where(part % 7 < 4).select("deployment_id", F.concat(F.lit("repo-"), (part % 7).cast("string")).alias("repository_id"), "resource")
    found = workspace.inventory_owners(derive.kept(_members(spark, sf_dir)), items, exact)
    return found.groupBy("repository_id", "relation", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE c AS (SELECT p_brand AS workspace_id, printf('repo-%08d', p_partkey) AS repository_id, CAST(floor(p_retailprice) AS BIGINT) AS cost,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
t AS (SELECT workspace_id, repository_id, cost, i, cost <= 50000 AS admitted, CASE WHEN cost <= 50000 THEN 50000 - cost ELSE 50000 END AS rest FROM c WHERE i = 1
  UNION ALL SELECT c.workspace_id, c.repository_id, c.cost, c.i, c.cost <= rest, CASE WHEN c.cost <= rest THEN rest - c.cost ELSE rest END
  FROM t JOIN c ON c.workspace_id = t.workspace_id AND c.i = t.i + 1)
SELECT workspace_id, repository_id, cost, admitted FROM t
""")
def b3_greedy_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as repositories with their price as cost, admitted while the budget lasts."""
    costs = derive.table(spark, sf_dir, "part").select(F.col("p_brand").alias("workspace_id"), F.format_string("repo-%08d", "p_partkey").alias("repository_id"), F.floor("p_retailprice").cast("long").alias("cost"))
    return workspace.admit(costs, 50_000)


@query()
def x1_extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text made of part names; every form of read occurs."""
    part = derive.table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    name = F.concat(F.lit("PART_"), n.cast("string"))
    text = (
        F.when(n % 6 == 0, F.concat(F.lit("const v = process.env."), name, F.lit(";")))
        .when(n % 6 == 1, F.concat(F.lit("const e = process.env; const {"), name, F.lit(": x} = e; e['Q_' + 'R'];")))
        .when(n % 6 == 2, F.concat(F.lit("process.env[`"), name, F.lit("_${request.query.k}`]")))
        .when(n % 6 == 3, F.concat(F.lit("export function f(k) { return process.env[k]; } // "), name))
        .when(n % 6 == 4, F.concat(F.lit("process.env[f ? '"), name, F.lit("' : 'OTHER'];")))
        .otherwise("export const = ;")
    )
    files = part.select(n.alias("ord"), F.concat(F.lit("src/f"), n.cast("string"), F.lit(".ts")).alias("path"), text.alias("content"))
    seen = observations(files)
    return seen.select("file_ord", "nth", "status", "exact", "domain_kind", F.array_join("keys", ",").alias("keys"), "prefix", "suffix", "origin")

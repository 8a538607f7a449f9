"""Truth of the predicates and gates over whole tables: each order is a pair of scopes or selectors.

Keys of a row choose its operands from short lists, so no rows are joined; the SQL states the rules
apart from the Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.functions import predicates as P
from graphaxis.functions import safety
from graphaxis.plans import derive
from graphaxis.plans.queries import _MIXED, _SECRET_PREFIXES, query

_UNITS, _PHASES, _CHANNELS = ["U0", "U1"], ["build", "runtime", "unknown"], ["process", "file", "unknown"]
_STAGE_KINDS = ["all", "unknown", "exact", "exact", "exact", "exact", "exact"]
_STAGE_VALUES = [[], [], ["A"], ["A", "N"], ["N", "A"], [], ["A", "A"]]
_UNIT_SETS = [None, ["U0"], ["U0", "U1"], ["U1"], []]
_PHASE_SETS = [None, ["build"], ["build", "runtime"]]
_CHANNEL_SETS = [None, ["process"]]
_CONDITIONS = ["always", "unknown", "all"]


def _literal(value: object) -> Column:
    if value is None:
        return F.lit(None).cast("array<string>")
    return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value)


def _one_of(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(_literal, values)), (index % len(values) + 1).cast("int"))


def _per(key: Column, divisor: int) -> Column:
    return F.floor(key / divisor)


def _stage(n: Column) -> Column:
    return F.struct(_one_of(_STAGE_KINDS, n).alias("kind"), _one_of(_STAGE_VALUES, n).alias("values"))


def _scope(n: Column) -> Column:
    return F.struct(
        _one_of(_UNITS, n).alias("id"),
        _one_of(_PHASES, _per(n, 2)).alias("phase"),
        _one_of(_CHANNELS, _per(n, 6)).alias("channel"),
        _stage(_per(n, 18)).alias("stage"),
    )


def _condition(n: Column) -> Column:
    """A clause on one of two keys, with one of two operators and of two values; every fourth has another."""
    def clause(m: Column) -> Column:
        return F.struct(
            F.concat(F.lit("k"), m % 2).alias("key"),
            F.when(_per(m, 2) % 2 == 0, "equals").otherwise("not-equals").alias("operator"),
            F.concat(F.lit("v"), _per(m, 4) % 2).alias("value"),
        )

    clauses = F.when(n % 4 == 0, F.array(clause(n), clause(n + 3))).otherwise(F.array(clause(n)))
    return F.struct(_one_of(_CONDITIONS, n).alias("kind"), clauses.alias("clauses"))


def _selector(n: Column) -> Column:
    return F.struct(
        _one_of(_UNIT_SETS, n).alias("execution_unit_ids"),
        _one_of(_PHASE_SETS, _per(n, 5)).alias("phases"),
        _one_of(_CHANNEL_SETS, _per(n, 15)).alias("channels"),
        _stage(_per(n, 2)).alias("stage"),
        _condition(n).alias("condition"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else _list(v) + "::VARCHAR[]" if isinstance(v, list) else f"'{v}'" for v in values) + "]"


def _sql_stage(n: str, name: str) -> str:
    return f"{_list(_STAGE_KINDS)}[({n}) % 7 + 1] AS {name}_kind, {_list(_STAGE_VALUES)}[({n}) % 7 + 1] AS {name}_values"


def _sql_scope(n: str, s: str) -> str:
    return (
        f"{_list(_UNITS)}[{n} % 2 + 1] AS {s}_id, {_list(_PHASES)}[({n} // 2) % 3 + 1] AS {s}_phase,"
        f" {_list(_CHANNELS)}[({n} // 6) % 3 + 1] AS {s}_channel, {_sql_stage(f'{n} // 18', s)}"
    )


def _sql_clause(m: str) -> str:
    return f"{{'key': 'k' || ({m}) % 2, 'same': (({m}) // 2) % 2 = 0, 'value': 'v' || (({m}) // 4) % 2}}"


def _sql_selector(n: str, s: str) -> str:
    return (
        f"{_list(_UNIT_SETS)}[{n} % 5 + 1] AS {s}_units, {_list(_PHASE_SETS)}[({n} // 5) % 3 + 1] AS {s}_phases,"
        f" {_list(_CHANNEL_SETS)}[({n} // 15) % 2 + 1] AS {s}_channels, {_sql_stage(f'{n} // 2', s)}, {_list(_CONDITIONS)}[{n} % 3 + 1] AS {s}_condition,"
        f" CASE WHEN {n} % 4 = 0 THEN [{_sql_clause(n)}, {_sql_clause(f'{n} + 3')}] ELSE [{_sql_clause(n)}] END AS {s}_clauses"
    )


def _sql_covers(a: str, b: str) -> str:
    return (
        f"({a}_kind <> 'unknown' AND {b}_kind <> 'unknown' AND ({a}_kind = 'all' OR ({b}_kind <> 'all' AND list_has_all({a}_values, {b}_values))))"
    )


_STAGES_MEET = "(a_kind IN ('all', 'unknown') OR b_kind IN ('all', 'unknown') OR list_has_any(a_values, b_values))"
_SAME_PLACE = "(a_id = b_id AND a_phase = b_phase AND a_channel = b_channel AND a_phase <> 'unknown' AND a_channel <> 'unknown')"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("i"), F.col("o_orderkey").cast("long").alias("j"))


@query(f"""
WITH p AS (SELECT o_orderkey, {_sql_scope('o_custkey', 'a')}, {_sql_scope('o_orderkey', 'b')} FROM orders),
q AS (SELECT *, {_SAME_PLACE} AND {_sql_covers('a', 'b')} AS covers, {_SAME_PLACE} AND {_sql_covers('b', 'a')} AS covered FROM p)
SELECT o_orderkey, covers, covers AND covered AS equivalent,
  CASE WHEN covers THEN 'covers' WHEN a_id = b_id AND (a_phase = b_phase OR 'unknown' IN (a_phase, b_phase))
    AND (a_channel = b_channel OR 'unknown' IN (a_channel, b_channel)) AND {_STAGES_MEET} THEN 'overlaps' ELSE 'outside' END AS relation,
  CASE WHEN 'unknown' NOT IN (a_phase, a_channel, a_kind) THEN CAST(to_json([a_id, a_phase, a_channel,
    CASE a_kind WHEN 'all' THEN 'all' ELSE 'exact:' || CAST(to_json(list_sort(list_distinct(a_values))) AS VARCHAR) END]) AS VARCHAR) END AS scope_key
FROM q
""")
def p5_p6_p13_p16_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    pairs = _orders(spark, sf_dir).select("o_orderkey", _scope(F.col("i")).alias("a"), _scope(F.col("j")).alias("b"))
    return pairs.select(
        "o_orderkey",
        P.scope_covers(a, b).alias("covers"),
        P.scopes_equivalent(a, b).alias("equivalent"),
        P.relation_to_scope(a, b).alias("relation"),
        P.scope_key(a).alias("scope_key"),
    )


@query(f"""
WITH p AS (SELECT o_orderkey, {_sql_selector('o_custkey', 'a')}, {_sql_scope('o_orderkey', 'b')} FROM orders),
q AS (SELECT *, (a_units IS NULL OR list_contains(a_units, b_id)) AND (a_phases IS NULL OR list_contains(a_phases, b_phase))
    AND (a_channels IS NULL OR list_contains(a_channels, b_channel)) AS within FROM p),
r AS (SELECT *, within AND {_STAGES_MEET} AND a_condition <> 'unknown' AND {_sql_covers('a', 'b')} AS covers FROM q)
SELECT o_orderkey, within AND {_STAGES_MEET} AS may_affect, covers, covers AND 'unknown' NOT IN (b_phase, b_channel) AS covers_strict FROM r
""")
def p7_p8_selectors_of_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    pairs = _orders(spark, sf_dir).select("o_orderkey", _selector(F.col("i")).alias("a"), _scope(F.col("j")).alias("b"))
    return pairs.select(
        "o_orderkey",
        P.selector_may_affect(a, b).alias("may_affect"),
        P.selector_covers(a, b).alias("covers"),
        P.selector_covers_strict(a, b).alias("covers_strict"),
    )


def _sql_sets_meet(field: str) -> str:
    return f"(a_{field} IS NULL OR b_{field} IS NULL OR list_has_any(a_{field}, b_{field}))"


def _sql_same_set(field: str) -> str:
    return f"((a_{field} IS NULL AND b_{field} IS NULL) OR coalesce(list_has_all(a_{field}, b_{field}) AND list_has_all(b_{field}, a_{field}), false))"


@query(f"""
WITH p AS (SELECT o_orderkey, {_sql_selector('o_custkey', 'a')}, {_sql_selector('o_orderkey', 'b')} FROM orders),
x AS (SELECT o_orderkey, unnest(a_clauses) AS x, b_clauses FROM p),
y AS (SELECT o_orderkey, x, unnest(b_clauses) AS y FROM x),
clash AS (SELECT DISTINCT o_orderkey FROM y WHERE x.key = y.key AND ((x.same AND y.same AND x.value <> y.value) OR (x.same <> y.same AND x.value = y.value))),
q AS (SELECT p.*, a_condition <> 'all' OR b_condition <> 'all' OR c.o_orderkey IS NULL AS conditions FROM p LEFT JOIN clash c USING (o_orderkey))
SELECT o_orderkey, conditions AS conditions_overlap,
  conditions AND {_STAGES_MEET} AND {_sql_sets_meet('units')} AND {_sql_sets_meet('phases')} AND {_sql_sets_meet('channels')} AS selectors_overlap,
  {_sql_same_set('units')} AND {_sql_same_set('phases')} AND {_sql_same_set('channels')}
    AND a_kind = b_kind AND (a_kind <> 'exact' OR {_sql_same_set('values')})
    AND a_condition = b_condition AND (a_condition <> 'all' OR {_sql_same_set('clauses')}) AS equivalent
FROM q
""")
def p10_p11_p12_selector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    pairs = _orders(spark, sf_dir).select("o_orderkey", _selector(F.col("i")).alias("a"), _selector(F.col("j")).alias("b"))
    return pairs.select(
        "o_orderkey",
        P.conditions_overlap(a["condition"], b["condition"]).alias("conditions_overlap"),
        P.selectors_overlap(a, b).alias("selectors_overlap"),
        (P.selector_key(a) == P.selector_key(b)).alias("equivalent"),
    )


_ROOTS, _FOLDERS = [".", "src", "src/a", "lib", "src/a/"], ["src/a/f", "src/ab/f", "srcx/f", "lib", "src"]


@query(f"""
WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'file' ELSE 'env' END AS ns, CASE WHEN p_partkey % 9 <> 0 THEN 'P_' || p_partkey % 50 END AS name,
    CASE WHEN p_size % 4 = 0 THEN 'file' ELSE 'env' END AS ns2, CASE WHEN p_size % 9 <> 0 THEN 'P_' || p_size END AS name2,
    'P_' || p_size % 10 AS prefix, CAST(p_size % 10 AS VARCHAR) AS suffix, p_partkey // 7 % 3 AS pat, p_size % 5 AS dom,
    {_list(_ROOTS)}[p_size % 5 + 1] AS root, {_list(_FOLDERS)}[p_partkey % 5 + 1] AS path FROM part),
m AS (SELECT *, coalesce(ns = ns2 AND name = name2, false) AS equal,
    coalesce(ns = 'env' AND (pat = 1 OR starts_with(name, prefix)) AND (pat = 0 OR ends_with(name, suffix)), false) AS matched FROM k)
SELECT p_partkey, equal, equal AS same_resource, matched,
  CASE dom WHEN 0 THEN true WHEN 1 THEN ns = 'env' WHEN 2 THEN equal ELSE matched END AS affected,
  root = '.' OR root = path OR starts_with(path, root || '/') AS path_covered FROM m
""")
def p1_p2_p9_p14_p15_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, size = "struct<namespace: string, name: string>", F.col("p_partkey").cast("long"), F.col("p_size").cast("long")

    def key(ordinal: Column, number: Column) -> Column:
        name = F.when(ordinal % 9 != 0, F.concat(F.lit("P_"), number))
        return F.struct(F.when(ordinal % 4 == 0, "file").otherwise("env").alias("namespace"), name.alias("name")).cast(k)

    pattern = F.struct(
        _one_of(["prefix", "suffix", "surrounded"], _per(n, 7)).alias("kind"),
        F.concat(F.lit("P_"), size % 10).alias("prefix"),
        (size % 10).cast("string").alias("suffix"),
    )
    rows = derive.table(spark, sf_dir, "part").select(
        "p_partkey", size.alias("size"), key(n, n % 50).alias("a"), key(size, size).alias("b"), pattern.alias("pattern"),
        _one_of(_ROOTS, size).alias("root"), _one_of(_FOLDERS, n).alias("path"),
    )
    a, b = F.col("a"), F.col("b")
    domain = F.when(F.col("size") % 5 != 0, F.struct(
        F.when(F.col("size") % 5 == 1, "all-environment").when(F.col("size") % 5 == 2, "keys").otherwise("pattern").alias("kind"),
        F.array(b).alias("keys"), F.col("pattern").alias("pattern"),
    ))

    def resource(x: Column) -> Column:
        return F.struct(x["namespace"].alias("authority_id"), x["name"].alias("canonical_id"))

    return rows.select(
        "p_partkey",
        P.key_equals(a, b).alias("equal"),
        P.resource_equals(resource(a), resource(b)).alias("same_resource"),
        P.pattern_matches(F.col("pattern"), a).alias("matched"),
        P.gap_affects_key(domain, a).alias("affected"),
        P.path_covers(F.col("root"), F.col("path")).alias("path_covered"),
    )


@query("""
WITH t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> ''),
c AS (SELECT w, regexp_replace(w, '[._:@/-]', '', 'g') AS z FROM t),
e AS (SELECT w, """ + _SECRET_PREFIXES + " OR " + _MIXED + """ AS secret FROM c)
SELECT w AS token, CASE WHEN NOT secret AND length(w) <= 512 AND regexp_full_match(w, '[a-z]+[.,]?') THEN w END AS structured,
  CASE WHEN regexp_full_match(w, '[A-Z][A-Z0-9_]{0,63}') THEN w ELSE 'UNSAFE_DIAGNOSTIC' END AS diagnostic,
  CASE WHEN secret OR length(w) > 512 OR regexp_matches(w, '[\\x00-\\x1f\\x7f]') THEN '<opaque>' ELSE w END AS shown FROM e
""")
def v3_v8_v11_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = derive.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\\s+")).alias("token")).where("token <> ''").distinct()
    t = F.col("token")
    return words.select(
        "token",
        safety.structured_identifier(t, "^[a-z]+[.,]?$").alias("structured"),
        safety.diagnostic_code(t).alias("diagnostic"),
        safety.redacted(t).alias("shown"),
    )


@query("""
WITH n AS (SELECT o_orderkey, o_orderkey % 14 AS month, o_custkey % 33 AS day, o_orderkey % 26 AS hour, o_custkey % 62 AS minute, o_orderkey % 3 AS form FROM orders),
d AS (SELECT *, month BETWEEN 1 AND 12 AND day BETWEEN 1 AND CASE WHEN month = 2 THEN 28 WHEN month IN (4, 6, 9, 11) THEN 30 ELSE 31 END
    AND hour < 24 AND minute < 60 AND form < 2 AS good FROM n)
SELECT o_orderkey, CASE WHEN good THEN printf('2023-%02d-%02dT%02d:%02d:07', month, day, hour, minute) || CASE form WHEN 0 THEN '.000Z' ELSE '.250Z' END END AS at FROM d
""")
def v8_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, days, hours and minutes run past their ends; every third has no zone."""
    i, j = F.col("i"), F.col("j")
    text = F.format_string("2023-%02d-%02dT%02d:%02d:07", j % 14, i % 33, j % 26, i % 62)
    text = F.concat(text, _one_of(["Z", ".250Z", ""], j))
    return _orders(spark, sf_dir).select("o_orderkey", safety.timestamp(text).alias("at"))

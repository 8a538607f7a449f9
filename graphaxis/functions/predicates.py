"""Scope, selector, key and condition predicates as Column expressions.

Unknown never covers anything and may overlap everything. Opaque names are null, so that plain
equality makes them equal to nothing; wherever null would leak out of a predicate it is closed with
``coalesce``. Every function takes struct columns shaped as in ``plans.schemas``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in(items: Column, value: Column) -> Column:
    """An absent set is a wildcard."""
    return items.isNull() | _true(F.array_contains(items, value))


def key_equals(a: Column, b: Column) -> Column:
    """Same namespace and name, neither opaque."""
    return _true((a["namespace"] == b["namespace"]) & (a["name"] == b["name"]))


def resource_equals(a: Column, b: Column) -> Column:
    """P2."""
    return _true((a["authority_id"] == b["authority_id"]) & (a["canonical_id"] == b["canonical_id"]))


def stage_covers(a: Column, b: Column) -> Column:
    """Every stage of ``b`` is one of ``a``."""
    within = _true(F.size(F.array_except(b["values"], a["values"])) == 0)
    return (
        F.when((a["kind"] == "unknown") | (b["kind"] == "unknown"), False)
        .when(a["kind"] == "all", True)
        .when(b["kind"] == "all", False)
        .otherwise(within)
    )


def stages_overlap(a: Column, b: Column) -> Column:
    """P4."""
    open_ended = a["kind"].isin("unknown", "all") | b["kind"].isin("unknown", "all")
    return F.when(open_ended, True).otherwise(_true(F.arrays_overlap(a["values"], b["values"])))


def known_scope(a: Column) -> Column:
    return (a["phase"] != "unknown") & (a["channel"] != "unknown")


def scope_covers(a: Column, b: Column) -> Column:
    """P5: same unit, phase and channel, all known, and P3. The component doesn't matter."""
    same = (a["id"] == b["id"]) & (a["phase"] == b["phase"]) & (a["channel"] == b["channel"])
    return _true(same & known_scope(a)) & stage_covers(a["stage"], b["stage"])


def scopes_equivalent(a: Column, b: Column) -> Column:
    """P6."""
    return scope_covers(a, b) & scope_covers(b, a)


def selector_may_affect(selector: Column, scope: Column) -> Column:
    """A condition never excludes."""
    return (
        _in(selector["execution_unit_ids"], scope["id"])
        & _in(selector["phases"], scope["phase"])
        & _in(selector["channels"], scope["channel"])
        & stages_overlap(selector["stage"], scope["stage"])
    )


def selector_covers(selector: Column, scope: Column) -> Column:
    """P7's sets, a known condition, and P3."""
    return selector_may_affect(selector, scope) & (selector["condition"]["kind"] != "unknown") & stage_covers(selector["stage"], scope["stage"])


def selector_covers_strict(selector: Column, scope: Column) -> Column:
    """P8 where binding resolution asks: the scope's phase and channel are known too."""
    return selector_covers(selector, scope) & known_scope(scope)


def pattern_matches(pattern: Column, key: Column) -> Column:
    """Prefix and suffix may overlap; environment keys only."""
    starts, ends = F.startswith(key["name"], pattern["prefix"]), F.endswith(key["name"], pattern["suffix"])
    matched = F.when(pattern["kind"] == "prefix", starts).when(pattern["kind"] == "suffix", ends).when(pattern["kind"] == "surrounded", starts & ends)
    return _true((key["namespace"] == "env") & matched)


def _sets_overlap(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | _true(F.arrays_overlap(a, b))


def conditions_overlap(a: Column, b: Column) -> Column:
    """False only if two clauses on one key exclude each other."""
    def excludes(x: Column, y: Column) -> Column:
        same = x["value"] == y["value"]
        both = (x["operator"] == "equals") & (y["operator"] == "equals")
        return (x["key"] == y["key"]) & ((both & ~same) | ((x["operator"] != y["operator"]) & same))

    clash = F.exists(a["clauses"], lambda x: F.exists(b["clauses"], lambda y: excludes(x, y)))
    return F.when((a["kind"] != "all") | (b["kind"] != "all"), True).otherwise(~_true(clash))


def selectors_overlap(a: Column, b: Column) -> Column:
    """P10."""
    sets = [_sets_overlap(a[k], b[k]) for k in ("execution_unit_ids", "phases", "channels")]
    return reduce(lambda x, y: x & y, sets) & stages_overlap(a["stage"], b["stage"]) & conditions_overlap(a["condition"], b["condition"])


def stage_key(stage: Column) -> Column:
    """A canonical text of a known stage: distinct values in code-unit order."""
    exact = F.concat(F.lit("exact:"), F.to_json(F.array_sort(F.array_distinct(stage["values"]))))
    return F.when(stage["kind"] == "all", "all").when(stage["kind"] == "exact", exact)


def scope_key(scope: Column) -> Column:
    """Null where phase, channel or stage is unknown."""
    parts = F.to_json(F.array(scope["id"], scope["phase"], scope["channel"], stage_key(scope["stage"])))
    return F.when(known_scope(scope) & (scope["stage"]["kind"] != "unknown"), parts)


def _set_key(items: Column) -> Column:
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(items))), F.lit("*"))


def dimensions_key(selector: Column) -> Column:
    """A canonical text of a selector's sets and stage, its condition left out."""
    stage = F.coalesce(stage_key(selector["stage"]), selector["stage"]["kind"])
    return F.concat_ws("|", _set_key(selector["execution_unit_ids"]), _set_key(selector["phases"]), stage, _set_key(selector["channels"]))


def clause_key(clause: Column) -> Column:
    return F.to_json(F.array(clause["key"], clause["operator"], clause["value"]))


def condition_key(condition: Column) -> Column:
    clauses = F.to_json(F.array_sort(F.array_distinct(F.transform(condition["clauses"], clause_key))))
    return F.concat(condition["kind"], F.when(condition["kind"] == "all", clauses).otherwise(""))


def selector_key(selector: Column) -> Column:
    """P12 as equality of canonical texts; parsed selectors have no duplicate values."""
    return F.concat_ws("|", dimensions_key(selector), condition_key(selector["condition"]))


def relation_to_scope(scope: Column, member: Column) -> Column:
    """``covers``, ``overlaps`` or ``outside``; unknown phase and channel are compatible."""
    def compatible(field: str) -> Column:
        return (scope[field] == member[field]) | (scope[field] == "unknown") | (member[field] == "unknown")

    touches = _true((scope["id"] == member["id"]) & compatible("phase") & compatible("channel")) & stages_overlap(scope["stage"], member["stage"])
    return F.when(scope_covers(scope, member), "covers").when(touches, "overlaps").otherwise("outside")


def gap_affects_key(key_domain: Column, key: Column) -> Column:
    """P14."""
    listed = F.exists(key_domain["keys"], lambda k: key_equals(k, key))
    return (
        F.when(key_domain.isNull() | key.isNull(), True)
        .when(key_domain["kind"] == "all-environment", key["namespace"] == "env")
        .when(key_domain["kind"] == "keys", _true(listed))
        .otherwise(pattern_matches(key_domain["pattern"], key))
    )


def path_covers(root: Column, path: Column) -> Column:
    """The root marker, the path itself, or a folder above it."""
    return _true((root == ".") | (root == path) | F.startswith(path, F.concat(root, F.lit("/"))))

"""Typed schemas of the fact tables. No column is ever of type void: every null has a type."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, L, B, I = StringType(), LongType(), BooleanType(), IntegerType()  # noqa: E741
NAMES = ArrayType(S)

KEY = _struct(namespace=S, name=S)
RESOURCE = _struct(authority_id=S, canonical_id=S)
STAGE = _struct(kind=S, values=NAMES)
SCOPE = _struct(id=S, component_id=S, phase=S, stage=STAGE, channel=S)
CLAUSE = _struct(key=S, operator=S, value=S)
CONDITION = _struct(kind=S, clauses=ArrayType(CLAUSE))
SELECTOR = _struct(execution_unit_ids=NAMES, phases=NAMES, stage=STAGE, channels=NAMES, condition=CONDITION)
POSITION = _struct(line=I, column=I)
LOCATION = _struct(file=S, start=POSITION, end=POSITION)
EVIDENCE = ArrayType(_struct(rule_id=S, code=S, locations=ArrayType(LOCATION)))
PATTERN = _struct(kind=S, pattern_id=S, prefix=S, suffix=S)
DOMAIN = _struct(kind=S, keys=NAMES, pattern=PATTERN, reason=S)
KEY_DOMAIN = _struct(kind=S, keys=ArrayType(KEY), pattern=PATTERN)

SOURCE_FILE = _struct(root_id=S, ord=L, path=S, language=S, bytes=L, content=S)
DISCOVERY_SKIP = _struct(root_id=S, path=S, code=S)
REFERENCE = _struct(ord=L, id=S, key=KEY, demand=S, operation=S, resolution=S, confidence=S, location=LOCATION, exposure=S, evidence=EVIDENCE)
DEMAND_EDGE = _struct(ord=L, id=S, reference_id=S, scope=SCOPE, origin=S)
DYNAMIC_EDGE = _struct(ord=L, id=S, reference_id=S, scope=SCOPE, domain=DOMAIN, origin=S, pattern_constraint=S, likely_keys=ArrayType(KEY))
CANDIDATE = _struct(ord=L, id=S, adapter_id=S, scope=SCOPE, destination=KEY, source_kind=S, resource=RESOURCE, applies_when=SELECTOR, rank=L, comparable=B, resolution=S)
INVENTORY_ITEM = _struct(snapshot_ord=L, ord=L, input_id=S, authority_id=S, as_of=S, resource=RESOURCE, declared_scopes=ArrayType(SCOPE))
COVERAGE_GAP = _struct(ord=L, id=S, domain=S, input_id=S, potentially_affects=SELECTOR, key_domain=KEY_DOMAIN, reason=S)
COVERAGE_INPUT = _struct(input_id=S, domain=S, state=S, selector=SELECTOR)
CLOSED_SCOPE = _struct(
    selector=SELECTOR,
    closed=B,
    approved_roots=NAMES,
    binding_roots=NAMES,
    expected_inputs=ArrayType(_struct(input_id=S, domain=S)),
    authorities=ArrayType(_struct(authority_id=S, inventory_input_id=S)),
    mechanisms=ArrayType(SELECTOR),
    outside_root_imports=S,
)
PATTERN_DOMAIN = _struct(ord=L, pattern_id=S, selector=SELECTOR, keys=ArrayType(KEY), constraint=S)
TARGET_STATUS = _struct(ord=L, scope=SCOPE, status=S)

FACTS = {
    "references": REFERENCE,
    "demand_edges": DEMAND_EDGE,
    "dynamic_edges": DYNAMIC_EDGE,
    "candidates": CANDIDATE,
    "inventory": INVENTORY_ITEM,
    "gaps": COVERAGE_GAP,
    "inputs": COVERAGE_INPUT,
    "closed_scopes": CLOSED_SCOPE,
    "pattern_domains": PATTERN_DOMAIN,
    "target_statuses": TARGET_STATUS,
}

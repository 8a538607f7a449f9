"""JSON evidence documents to typed rows and gaps.

A document is parsed permissively by ``from_json`` with a fixed schema, exploded with its declared
order, and judged row by row in expressions. A bad row leaves a gap and no fact; a bad root leaves
one gap with an unknown selector; repeated ids keep the first and leave a gap. Overflow of the entry
budget discards everything but one gap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphaxis.functions import safety
from graphaxis.plans import schemas

# Schema names, vocabularies and limits of the documents.
BINDINGS, INVENTORY, CLOSED_MODEL = "binding-manifest/v1", "inventory-snapshot/v1", "closed-provisioning-model/v1"
PHASES = ("build", "install", "deploy", "runtime", "test", "unknown")
CHANNELS = ("environment", "file", "argument", "unknown")
SOURCE_KINDS = ("secret-manager", "configuration", "literal", "platform", "unknown")
RESOLUTIONS = ("exact", "dynamic", "unknown")
MAX_ENTRIES, MAX_DOCUMENT_BYTES, MAX_FINITE_DOMAIN = 100_000, 5 << 20, 100

_STAGE = "struct<kind:string,values:array<string>>"
_SCOPE = f"struct<id:string,componentId:string,phase:string,stage:{_STAGE},channel:string>"
_CONDITION = "struct<kind:string,clauses:array<struct<key:string,operator:string,value:string>>>"
_SELECTOR = f"struct<executionUnitIds:array<string>,phases:array<string>,stage:{_STAGE},channels:array<string>,condition:{_CONDITION}>"
_RESOURCE = "struct<authorityId:string,canonicalId:string>"
_CANDIDATE = (
    f"struct<id:string,scope:{_SCOPE},destination:struct<namespace:string,name:string>,sourceKind:string,providerResourceId:{_RESOURCE},"
    f"appliesWhen:{_SELECTOR},precedence:struct<source:string,rank:bigint,comparable:boolean>,resolution:string>"
)
BINDING_SCHEMA = f"schemaVersion string, inputId string, adapterId string, candidates array<{_CANDIDATE}>, _corrupt string"
INVENTORY_SCHEMA = f"schemaVersion string, inputId string, authorityId string, asOf string, items array<struct<providerResourceId:{_RESOURCE},declaredScopes:array<{_SCOPE}>>>, _corrupt string"


@dataclass
class Parsed:
    facts: DataFrame
    gaps: DataFrame


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``text`` of whole files within the size limit, ``text`` null beyond it."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.when(F.col("length") <= MAX_DOCUMENT_BYTES, F.col("content").cast("string"))
    return raw.select("path", text.alias("text"))


def _parse(documents: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return documents.select("path", parsed.alias("doc"))


def _unique(items: Column) -> Column:
    return items.isNull() | ((F.size(items) > 0) & (F.size(F.array_distinct(items)) == F.size(items)))


def valid_stage(stage: Column) -> Column:
    """Exact stages are non-empty, distinct identifiers."""
    exact = _unique(stage["values"]) & stage["values"].isNotNull() & F.forall(stage["values"], lambda v: safety.generic_identifier(v).isNotNull())
    return F.coalesce(F.when(stage["kind"] == "exact", exact).otherwise(stage["kind"].isin("all", "unknown")), F.lit(False))


def valid_condition(condition: Column) -> Column:
    clauses = condition["clauses"]
    good = F.forall(clauses, lambda c: safety.generic_identifier(c["key"]).isNotNull() & c["operator"].isin("equals", "not-equals") & safety.generic_identifier(c["value"]).isNotNull())
    whole = clauses.isNotNull() & _unique(F.transform(clauses, lambda c: F.to_json(c))) & good
    return F.coalesce(F.when(condition["kind"] == "all", whole).otherwise(condition["kind"].isin("always", "unknown")), F.lit(False))


def valid_scope(scope: Column) -> Column:
    named = safety.generic_identifier(scope["id"]).isNotNull() & safety.generic_identifier(scope["componentId"]).isNotNull()
    return F.coalesce(named & scope["phase"].isin(*PHASES) & scope["channel"].isin(*CHANNELS), F.lit(False)) & valid_stage(scope["stage"])


def valid_selector(selector: Column) -> Column:
    sets = _unique(selector["executionUnitIds"]) & _unique(selector["phases"]) & _unique(selector["channels"])
    return F.coalesce(sets, F.lit(False)) & valid_stage(selector["stage"]) & valid_condition(selector["condition"])


def valid_resource(resource: Column) -> Column:
    return safety.generic_identifier(resource["authorityId"]).isNotNull() & safety.generic_identifier(resource["canonicalId"]).isNotNull()


def _scope(s: Column) -> Column:
    return F.struct(s["id"].alias("id"), s["componentId"].alias("component_id"), s["phase"].alias("phase"), s["stage"].alias("stage"), s["channel"].alias("channel"))


def _selector(s: Column) -> Column:
    return F.struct(s["executionUnitIds"].alias("execution_unit_ids"), s["phases"].alias("phases"), s["stage"].alias("stage"), s["channels"].alias("channels"), s["condition"].alias("condition"))


def _resource(r: Column) -> Column:
    return F.when(r.isNotNull(), F.struct(r["authorityId"].alias("authority_id"), r["canonicalId"].alias("canonical_id")))


def unknown_selector() -> Column:
    return F.lit(None).cast(schemas.SELECTOR)


def scope_selector(scope: Column) -> Column:
    """A selector of just this scope, for the gap that a bad row leaves."""
    condition = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("array<struct<key:string,operator:string,value:string>>").alias("clauses"))
    return F.struct(F.array(scope["id"]).alias("execution_unit_ids"), F.array(scope["phase"]).alias("phases"), scope["stage"].alias("stage"), F.array(scope["channel"]).alias("channels"), condition.alias("condition"))


def _root_state(doc: Column, version: str, entries: Column, good: Column) -> Column:
    return (
        F.when(doc.isNull() | doc["_corrupt"].isNotNull() | (F.coalesce(doc["schemaVersion"], F.lit("")) != version), "INVALID_ROOT")
        .when(safety.generic_identifier(doc["inputId"]).isNull() | entries.isNull() | ~F.coalesce(good, F.lit(False)), "INVALID_ROOT")
        .when(F.size(entries) > MAX_ENTRIES, "OVER_BUDGET")
    )


def _gap(domain: str, selector: Column, reason: Column) -> list[Column]:
    return ["path", "input_id", F.lit(domain).alias("domain"), selector.alias("potentially_affects"), reason.alias("reason")]


def binding_manifests(documents: DataFrame) -> Parsed:
    """Candidates and gaps of binding manifests (columns ``path`` and ``text``)."""
    doc = F.col("doc")
    roots = _parse(documents, BINDING_SCHEMA)
    roots = roots.withColumn("bad", _root_state(doc, BINDINGS, doc["candidates"], safety.generic_identifier(doc["adapterId"]).isNotNull())).withColumn("input_id", safety.generic_identifier(doc["inputId"]))
    root_gaps = roots.where("bad is not null").select(*_gap("binding", unknown_selector(), F.col("bad")))
    rows = roots.where("bad is null").select("path", "input_id", doc["adapterId"].alias("adapter_id"), F.posexplode(doc["candidates"]).alias("ord", "c"))
    c = F.col("c")
    key = F.struct(c["destination"]["namespace"].alias("namespace"), F.when(c["destination"]["namespace"] == "env", safety.environment_key(c["destination"]["name"])).otherwise(safety.generic_identifier(c["destination"]["name"])).alias("name"))
    rank = c["precedence"]["rank"]
    good = (
        safety.generic_identifier(c["id"]).isNotNull() & c["sourceKind"].isin(*SOURCE_KINDS) & c["resolution"].isin(*RESOLUTIONS) & c["destination"]["namespace"].isNotNull()
        & ((c["sourceKind"] != "secret-manager") | c["providerResourceId"].isNotNull()) & (c["providerResourceId"].isNull() | valid_resource(c["providerResourceId"]))
        & c["precedence"]["comparable"].isNotNull() & (~c["precedence"]["comparable"] | F.coalesce(rank >= 0, F.lit(False))) & (rank.isNull() | (rank >= 0))
    )
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)) & valid_scope(c["scope"]) & valid_selector(c["appliesWhen"]))
    first = F.row_number().over(W.partitionBy("path", F.col("ok"), c["id"]).orderBy("ord"))
    rows = rows.withColumn("nth", F.when(F.col("ok"), first).otherwise(1))
    facts = rows.where("ok and nth = 1").select(
        F.col("ord").cast("long").alias("ord"), c["id"].alias("id"), "adapter_id", _scope(c["scope"]).alias("scope"), key.alias("destination"), c["sourceKind"].alias("source_kind"),
        _resource(c["providerResourceId"]).alias("resource"), _selector(c["appliesWhen"]).alias("applies_when"), rank.alias("rank"), c["precedence"]["comparable"].alias("comparable"), c["resolution"].alias("resolution"),
        "path", "input_id",
    )
    affected = F.when(valid_scope(c["scope"]), scope_selector(c["scope"])).otherwise(unknown_selector())
    bad = rows.where("not ok or nth > 1").select(*_gap("binding", affected, F.when(F.col("ok"), "DUPLICATE_ID").otherwise("INVALID_ROW")))
    return Parsed(facts, root_gaps.unionByName(bad))


def inventory_snapshots(documents: DataFrame) -> Parsed:
    """Items and gaps of inventory snapshots; an item of another authority is a bad row."""
    doc = F.col("doc")
    roots = _parse(documents, INVENTORY_SCHEMA)
    head = safety.generic_identifier(doc["authorityId"]).isNotNull() & safety.timestamp(doc["asOf"]).isNotNull()
    roots = roots.withColumn("bad", _root_state(doc, INVENTORY, doc["items"], head)).withColumn("input_id", safety.generic_identifier(doc["inputId"]))
    root_gaps = roots.where("bad is not null").select(*_gap("inventory", unknown_selector(), F.col("bad")))
    rows = roots.where("bad is null").select("path", "input_id", doc["authorityId"].alias("authority_id"), safety.timestamp(doc["asOf"]).alias("as_of"), F.posexplode(doc["items"]).alias("ord", "i"))
    i = F.col("i")
    good = valid_resource(i["providerResourceId"]) & (i["providerResourceId"]["authorityId"] == F.col("authority_id")) & (i["declaredScopes"].isNull() | F.forall(i["declaredScopes"], valid_scope))
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    first = F.row_number().over(W.partitionBy("path", "ok", i["providerResourceId"]["canonicalId"]).orderBy("ord"))
    rows = rows.withColumn("nth", F.when(F.col("ok"), first).otherwise(1))
    facts = rows.where("ok and nth = 1").select(
        F.col("ord").cast("long").alias("ord"), "input_id", "authority_id", "as_of", _resource(i["providerResourceId"]).alias("resource"), F.transform(i["declaredScopes"], _scope).alias("declared_scopes"), "path",
    )
    bad = rows.where("not ok or nth > 1").select(*_gap("inventory", unknown_selector(), F.when(F.col("ok"), "DUPLICATE_RESOURCE").otherwise("INVALID_ROW")))
    return Parsed(facts, root_gaps.unionByName(bad))

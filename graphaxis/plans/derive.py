"""Facts made from the star-schema tables, by key arithmetic only, for queries and benchmarks.

Line items make demand (which part's key is read in which customer region) and bindings (which
supplier provides it in which supplier region); parts make inventory, events dynamic lookups, and
nations coverage gaps. Injected along the way: opaque names, stages that cover all, conditions,
dynamic and incomparable candidates, missing resources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.operators.reconcile import Facts, Records, reconcile
from graphaxis.plans import schemas
from graphaxis.plans.store import large, stored

AS_OF = "2026-07-12T00:00:00.000Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null(kind) -> Column:
    return F.lit(None).cast(kind)


def stage(kind: Column | str, *values: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (F.array(*values) if values else F.array().cast("array<string>")).alias("values"))


def scope(region: Column, phase: Column, of: Column) -> Column:
    unit = F.concat(F.lit("REGION_"), region.cast("string"))
    return F.struct(unit.alias("id"), unit.alias("component_id"), phase.alias("phase"), of.alias("stage"), F.lit("environment").alias("channel"))


def selector(condition: Column, units: Column | None = None, phases: Column | None = None, of: Column | None = None) -> Column:
    names = "array<string>"
    return F.struct(
        (_null(names) if units is None else units).alias("execution_unit_ids"), (_null(names) if phases is None else phases).alias("phases"),
        (stage("all") if of is None else of).alias("stage"), _null(names).alias("channels"), condition.alias("condition"),
    )


def condition(kind: Column | str, clauses: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.array().cast("array<struct<key:string,operator:string,value:string>>")
    return F.struct(kind.alias("kind"), (none if clauses is None else clauses).alias("clauses"))


def key(part: Column) -> Column:
    name = F.when(part % 97 != 0, F.concat(F.lit("PART_"), part.cast("string")))
    return F.struct(F.lit("env").alias("namespace"), name.alias("name"))


def _phase(status: Column) -> Column:
    return F.when(status == "F", "build").otherwise("runtime")


def _flag(flag: Column) -> Column:
    return F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier, supplier region, flag, status): who can provide what, where."""
    place = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("region"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").distinct()
    return rows.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "region", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("part"), F.col("supp")
    wide = supp % 17 == 0
    rows = sold(spark, sf_dir).withColumn("flag", F.when(wide, "*").otherwise(F.col("flag"))).distinct()
    ord = ((part * 100000 + supp) * 8 + F.when(wide, 3).otherwise(_flag(F.col("flag"))) * 2 + F.when(F.col("status") == "F", 0).otherwise(1)).cast("long")
    clause = F.array(F.struct(F.lit("BRANCH").alias("key"), F.when(supp % 3 == 0, "equals").otherwise("not-equals").alias("operator"), F.lit("main").alias("value")))
    conditional = (part % 5 == 0) & (supp % 3 != 2)
    when = F.when(conditional, condition("all", clause)).otherwise(condition("always"))
    resource = F.struct(F.concat(F.lit("AUTH_"), F.col("region").cast("string")).alias("authority_id"), F.concat(F.lit("PART_"), part.cast("string")).alias("canonical_id"))
    return rows.select(
        ord.alias("ord"), F.concat(F.lit("cand-"), ord.cast("string")).alias("id"), F.lit("adapter").alias("adapter_id"),
        scope(F.col("region"), _phase(F.col("status")), F.when(wide, stage("all")).otherwise(stage("exact", F.col("flag")))).alias("scope"),
        key(part).alias("destination"), F.lit("secret-manager").alias("source_kind"), F.when(supp % 19 != 0, resource).alias("resource"), selector(when).alias("applies_when"),
        (supp % 7).cast("long").alias("rank"), (supp % 11 != 0).alias("comparable"), F.when(supp % 13 == 0, "dynamic").otherwise("exact").alias("resolution"),
    )


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, customer nation, region, flag, status): what is read where."""
    place = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(place, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    return lines.join(large(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("part"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).distinct()


def demand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir).select("part", "region", "flag", "status").distinct()
    ord = ((F.col("part") * 5 + F.col("region")) * 6 + _flag(F.col("flag")) * 2 + F.when(F.col("status") == "F", 0).otherwise(1)).cast("long")
    return rows.select(
        ord.alias("ord"), F.concat(F.lit("demand-"), ord.cast("string")).alias("id"), F.concat(F.lit("ref-"), F.col("part").cast("string")).alias("reference_id"),
        scope(F.col("region"), _phase(F.col("status")), stage("exact", F.col("flag"))).alias("scope"), F.when(F.col("part") % 4 == 0, "consumer-derived").otherwise("direct").alias("origin"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    kind = F.when(part % 23 == 0, "metadata").when(part % 2 == 0, "eager-validation").otherwise("direct-read")
    return table(spark, sf_dir, "part").select(
        part.alias("ord"), F.concat(F.lit("ref-"), part.cast("string")).alias("id"), key(part).alias("key"), kind.alias("demand"), F.lit("read").alias("operation"), F.lit("literal").alias("resolution"),
        F.lit("high").alias("confidence"), _null(schemas.LOCATION).alias("location"), F.lit("server").alias("exposure"), _null(schemas.EVIDENCE).alias("evidence"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that isn't of a tenth size, in every region."""
    part, region = F.col("p_partkey"), F.col("region")
    rows = table(spark, sf_dir, "part").where(F.col("p_size") % 10 != 0).select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("region"))
    authority = F.concat(F.lit("AUTH_"), region.cast("string"))
    declared = F.when(part % 50 == 0, F.array(scope(region, F.lit("runtime"), stage("exact", F.lit("A")))))
    return rows.select(
        region.cast("long").alias("snapshot_ord"), part.alias("ord"), F.concat(F.lit("inv-"), region.cast("string")).alias("input_id"), authority.alias("authority_id"), F.lit(AS_OF).alias("as_of"),
        F.struct(authority.alias("authority_id"), F.concat(F.lit("PART_"), part.cast("string")).alias("canonical_id")).alias("resource"), declared.alias("declared_scopes"),
    )


def dynamic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup for each region and kind of event: finite, prefix pattern or unbounded."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("region"), "event_type").distinct().withColumn("n", F.length("event_type").cast("long"))
    region, n = F.col("region"), F.col("n")
    kind = F.when((n % 3 == 2) & (region == 3), "unbounded").when(n % 3 == 1, "pattern").otherwise("finite")
    names = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat(F.lit("PART_"), (region * 10 + n * 100 + i).cast("string")))
    none = F.array().cast("array<string>")
    domain = F.struct(
        kind.alias("kind"), F.when(kind == "finite", names).otherwise(none).alias("keys"),
        F.when(kind == "pattern", F.struct(F.lit("prefix").alias("kind"), F.concat(F.lit("p-"), "event_type").alias("pattern_id"), F.concat(F.lit("PART_1"), (region + 2).cast("string")).alias("prefix"), F.lit(None).cast("string").alias("suffix"))).alias("pattern"),
        F.when(kind == "unbounded", "opaque").alias("reason"),
    )
    likely = F.transform(domain["keys"], lambda k: F.struct(F.lit("env").alias("namespace"), k.alias("name")))
    id = F.concat(F.lit("dynamic-"), region.cast("string"), F.lit("-"), F.col("event_type"))
    return rows.select(
        (region * 100 + n).cast("long").alias("ord"), id.alias("id"), F.concat(F.lit("dref-"), "event_type").alias("reference_id"), scope(region, F.lit("runtime"), stage("exact", F.lit("A"))).alias("scope"),
        domain.alias("domain"), F.when(n % 2 == 0, "user-controlled").otherwise("lexical").alias("origin"), F.when(kind == "pattern", "not-proven").alias("pattern_constraint"), likely.alias("likely_keys"),
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap for every sixth nation, on its region and keys by prefix, and one wildcard by keys."""
    nation = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    prefix = F.struct(F.lit("prefix").alias("kind"), F.lit("g").alias("pattern_id"), F.concat(F.lit("PART_"), (n % 9 + 1).cast("string")).alias("prefix"), F.lit(None).cast("string").alias("suffix"))
    no_keys = F.array().cast("array<struct<namespace:string,name:string>>")
    named = nation.where(n % 6 == 0).select(
        n.cast("long").alias("ord"), F.concat(F.lit("gap-"), n.cast("string")).alias("id"), F.lit("demand").alias("domain"), F.lit("scan").alias("input_id"),
        selector(condition("always"), F.array(F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")))).alias("potentially_affects"),
        F.struct(F.lit("pattern").alias("kind"), no_keys.alias("keys"), prefix.alias("pattern")).alias("key_domain"), F.lit("UNREADABLE").alias("reason"),
    )
    keys = F.array(*[F.struct(F.lit("env").alias("namespace"), F.lit(f"PART_{i}").alias("name")) for i in (7, 77, 177)])
    wild = nation.where(n == 0).select(
        F.lit(1000).cast("long").alias("ord"), F.lit("gap-wild").alias("id"), F.lit("demand").alias("domain"), F.lit("scan").alias("input_id"),
        selector(condition("always"), None, F.array(F.lit("build")), stage("exact", F.lit("R"))).alias("potentially_affects"),
        F.struct(F.lit("keys").alias("kind"), keys.alias("keys"), F.lit(None).cast(schemas.PATTERN).alias("pattern")).alias("key_domain"), F.lit("OVERSIZE").alias("reason"),
    )
    return named.unionByName(wild)


def kept(facts: DataFrame) -> DataFrame:
    """Facts as stored rows: predicates then read columns instead of repeating how they are made.

    Without this the optimiser copies the struct expressions into every use of every predicate.
    """
    return stored(facts)


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The plans of all facts; records store those that they read."""
    return Facts.of(
        spark, references=references(spark, sf_dir), demand_edges=demand_edges(spark, sf_dir), dynamic_edges=dynamic_edges(spark, sf_dir),
        candidates=candidates(spark, sf_dir), inventory=inventory(spark, sf_dir), gaps=gaps(spark, sf_dir),
    )


def records(spark: SparkSession, sf_dir: str) -> Records:
    return reconcile(facts(spark, sf_dir))

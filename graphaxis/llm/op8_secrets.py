"""Secret scans: candidates judged by a random forest, in DataFrame expressions only.

A candidate is a run of at least 16 characters of keys and digests that holds a digit. Its features are its
length, the classes of its characters and how often they change, how much of it corpus words
cover, what its document's path says, and the words beside it. The forest is fitted on labelled findings
and its work is to remove false positives: card numbers, versions, addresses, digests of commits.

The labelled findings come as a table of (token, before, after, path, label) or, by default, from
``labelled_findings``: secrets and look-alikes of known families, generated from hashes, as no
labels of findings exist in the corpus. The dictionary is all words in at least ``DICTIONARY_SHARE`` of all
texts (two at least), a table that is joined to what tokens hold; every text is counted and scanned whole.

Defined results: a null text has no candidates; repeated rows give their candidates again; texts
without candidates give no row.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphaxis.llm.scratch import materialise

TOKEN = "[A-Za-z0-9+/=_-]{16,}"
DICTIONARY_SHARE = 1e-4
LEAST_DICTIONARY_WORD, LONGEST_DICTIONARY_WORD = 4, 32
TREES, DEPTH, SEED = 24, 7, 8
SECRET = 0.5
NEIGHBOURS = 3
_SPLIT = "[ \t-\r]+"
# Words beside a token that speak for a secret, against one, and paths of examples.
FOR_WORDS = "(?i)(secret|token|passw|api[_-]?key|apikey|access[_-]?key|auth|credential|private|bearer|client[_-]?key)"
AGAINST_WORDS = "(?i)(sha|commit|checksum|digest|md5|hash|uuid|guid|etag|version|revision|isbn|order|card|invoice|serial|example|dummy)"
EXAMPLE_PATHS = "(?i)(test|example|sample|fixture|mock|docs?/|readme)"
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "hex", "changes", "distinct", "vowels", "covered",
    "path_depth", "path_example", "assigned", "quoted", "word_for", "word_against", "address",
)


def _share(value: Column, chars: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, chars, ""))) / F.length(value)


def coverage(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each ``token`` with ``covered``: the share of its characters that are in words of ``dictionary`` (``w``)."""
    runs = F.filter(F.split(F.lower("token"), "[^a-z]+"), lambda x: F.length(x) >= LEAST_DICTIONARY_WORD)
    runs = materialise(tokens.select("token").distinct().select("token", F.explode(runs).alias("run")), "runs")
    at = runs.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.length("run") - LEAST_DICTIONARY_WORD + 1)).alias("at"))
    longest = F.least(F.length("run") - F.col("at") + 1, F.lit(LONGEST_DICTIONARY_WORD))
    parts = at.select("run", "at", F.explode(F.sequence(F.lit(LEAST_DICTIONARY_WORD), longest)).alias("k"))
    hit = parts.select("run", "at", "k", F.col("run").substr(F.col("at"), F.col("k")).alias("w")).join(dictionary, "w")
    widest = hit.groupBy("run", "at").agg(F.max("k").alias("k"))
    places = F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)))
    held = widest.groupBy("run").agg(F.size(F.array_distinct(places)).alias("n"))
    return runs.join(held, "run").groupBy("token").agg((F.sum("n") / F.length("token")).alias("covered"))


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds the features to ``token``, ``before``, ``after`` (with what touches the token), ``path``.

    ``found`` is read twice, so it should be stored. ``dictionary``: a table of words ``w``.
    """
    shares = coverage(found, dictionary)
    found = found.join(shares, "token", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    t, before, after = F.col("token"), F.col("before"), F.col("after")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "[+/=_-]+", "+")
    path = F.coalesce(F.col("path"), F.lit(""))
    out = {
        "length": F.length(t),
        "digits": _share(t, "[0-9]"),
        "upper": _share(t, "[A-Z]"),
        "lower": _share(t, "[a-z]"),
        "marks": _share(t, "[+/=_-]"),
        "hex": t.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "changes": (F.length(kinds) - 1) / F.length(t),
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.length(t),
        "vowels": _share(t, "[aeiouAEIOU]"),
        "covered": F.col("covered"),
        "path_depth": F.size(F.split(path, "/")) - 1,
        "path_example": path.rlike(EXAMPLE_PATHS),
        "assigned": before.rlike("[=:]\\s*[\"'`(\\[]*$"),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        "word_for": before.rlike(FOR_WORDS),
        "word_against": before.rlike(AGAINST_WORDS),
        "address": before.rlike("[@.]$") | after.rlike("^[@]|^\\.[A-Za-z]"),
    }
    return found.withColumns({name: value.cast("double") for name, value in out.items()})


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row for each candidate: ``id``, ``word`` (its place), ``part``, token and context."""
    words = docs.select(F.col(id).alias("id"), F.col(path).alias("path"), F.explode(F.array(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT))).alias("words"))
    shaped = F.filter(F.transform("words", lambda w, i: F.when((F.length(w) >= 16) & w.rlike(TOKEN) & w.rlike("[0-9]"), i)), lambda i: i.isNotNull())
    at = words.withColumn("word", F.explode(shaped))
    lo = F.greatest(F.col("word") - NEIGHBOURS, F.lit(0))
    near = at.select(
        "id", "path", "word", F.get("words", F.col("word")).alias("here"),
        F.array_join(F.slice("words", lo + 1, F.col("word") - lo), " ").alias("ahead"),
        F.array_join(F.slice("words", F.col("word") + 2, F.lit(NEIGHBOURS)), " ").alias("behind"),
    )
    each = near.select("*", F.posexplode(F.regexp_extract_all("here", F.lit(f"({TOKEN})"), F.lit(1))).alias("part", "token")).where(F.col("token").rlike("[0-9]"))
    start = F.instr(F.col("here"), F.col("token"))
    return each.select(
        "id", "path", "word", "part", "token",
        F.concat_ws(" ", "ahead", F.substring(F.col("here"), F.lit(1), start - 1)).alias("before"),
        F.concat_ws(" ", F.substring(F.col("here"), start + F.length("token"), F.length("here")), "behind").alias("after"),
    )


def dictionary_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """The words ``w`` in ``DICTIONARY_SHARE`` of all texts, and two at least."""
    texts = docs.where(F.col(text).isNotNull())
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z]+"))).alias("w"))
    counted = words.where(F.length("w").between(LEAST_DICTIONARY_WORD, LONGEST_DICTIONARY_WORD)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    least = max(2, texts.count() * DICTIONARY_SHARE)
    return materialise(counted.where(F.col("n") >= least).select("w"), "dictionary")


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Secrets and look-alikes by family, a fixed table made from hashes of row numbers."""
    ids = spark.range(rows).withColumn("kind", F.col("id") % 16).withColumn("a", F.sha2(F.concat(F.lit("a"), "id"), 256)).withColumn("b", F.sha2(F.concat(F.lit("b"), "id"), 256))
    base64 = F.regexp_replace(F.base64(F.unhex("a")), "\\s", "")
    digits = F.regexp_replace(F.concat("a", "b"), "[a-f]", "")
    word = F.translate(F.col("b"), "0123456789", "aeiourstln")
    pick = lambda *options: F.get(F.array(*map(F.lit, options)), (F.conv(F.substring("b", 1, 6), 16, 10).cast("long") % len(options)).cast("int"))
    name = pick("token", "secret", "api_key", "API_KEY", "password", "access_key", "client_secret", "auth_token", "TOKEN")
    plain = pick("the", "of and in", "with that for", "is a", "for each of", "de la", "und der")
    secret = F.when(F.col("kind") == 0, F.substring("a", 1, 40)).when(F.col("kind") == 1, F.substring(base64, 1, 40)).when(F.col("kind") == 2, F.substring("a", 1, 32))
    secret = secret.when(F.col("kind") == 3, F.upper(F.substring("a", 1, 40))).when(F.col("kind") == 4, F.concat(F.lit("sk_live_"), F.regexp_replace(F.substring(base64, 1, 24), "[+/=]", "x"))).when(F.col("kind") == 5, F.regexp_replace(F.substring(base64, 3, 40), "[+/=]", "_"))
    false = F.when(F.col("kind") == 6, F.substring(digits, 1, 16)).when(F.col("kind") == 7, F.concat_ws("-", F.substring("a", 1, 8), F.substring("a", 9, 4), F.substring("a", 13, 4), F.substring("a", 17, 4), F.substring("a", 21, 12)))
    false = false.when(F.col("kind") == 8, F.concat(F.substring(word, 1, 18), F.substring(digits, 1, 2))).when(F.col("kind") == 9, F.substring("a", 1, 40)).when(F.col("kind") == 10, F.concat(F.lit("usr/lib/x86_64-"), F.substring(word, 1, 8), F.lit("/"), F.substring(digits, 1, 3)))
    false = false.when(F.col("kind") == 11, F.concat(F.substring(word, 1, 10), F.lit("-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(word, 12, 6))).when(F.col("kind") == 12, F.substring("a", 1, 40)).when(F.col("kind") == 13, F.substring(base64, 1, 40)).when(F.col("kind") == 14, F.substring(digits, 1, 20)).otherwise(F.concat(F.lit("2024-"), F.substring(digits, 1, 2), F.lit("-release-build-"), F.substring(digits, 3, 4)))
    real = F.col("kind") < 6
    before = F.when(real & (F.col("id") % 3 == 0), F.concat(plain, F.lit(" "), name, F.lit(' = "'))).when(real & (F.col("id") % 3 == 1), F.concat(plain, F.lit(" "), name, F.lit(": "))).when(real, F.concat(name, F.lit("='")))
    before = before.when(F.col("kind") == 9, F.concat(pick("commit", "sha1:", "checksum", "revision", "etag ="), F.lit(" "))).when(F.col("kind") == 12, F.concat(name, F.lit(' = "'))).when(F.col("kind") == 13, F.concat(pick("sha256-", "digest:", "integrity: sha384-", "hash"), F.lit(" "))).when(F.col("kind") == 14, F.concat(pick("order", "invoice no", "serial:", "card"), F.lit(" "))).when((F.col("kind") == 8) & (F.col("id") % 2 == 0), F.concat(plain, F.lit(" x."))).otherwise(F.concat(plain, F.lit(" ")))
    after = F.when(real & (F.col("id") % 3 == 0), F.lit('" then')).when(real & (F.col("id") % 3 == 2), F.lit("'")).when(F.col("kind") == 12, F.lit('"')).when(F.col("kind") == 8, F.when(F.col("id") % 2 == 0, "@mail.example.com").otherwise(" of")).otherwise(F.lit(" and"))
    path = F.when(F.col("kind") == 12, pick("tests/fixtures/keys.py", "docs/example.md", "samples/mock.json")).otherwise(pick("src0", "app/config.py", "deploy/prod.env", "src3", "notes"))
    return ids.select(F.coalesce(secret, false).alias("token"), before.alias("before"), after.alias("after"), path.alias("path"), real.cast("double").alias("label"))


def train(findings: DataFrame, dictionary: DataFrame) -> PipelineModel:
    """The forest, fitted on labelled findings."""
    ready = features(findings, dictionary).select("label", *FEATURES).repartition(4).persist()
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="vector"), forest]).fit(ready)
    ready.unpersist()
    return model


def scan(docs: DataFrame, model: PipelineModel, dictionary: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate with its ``score`` (probability of a secret) and verdict."""
    judged = model.transform(features(materialise(candidates(docs, id, text, path), "found"), dictionary))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return judged.select(
        F.col("id").alias(id), F.col("word").cast("long").alias("word"), F.col("part").cast("long").alias("part"),
        "token", score.alias("score"), (score >= SECRET).alias("is_secret"),
    )


def findings(docs: DataFrame, labelled: DataFrame | None = None, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    dictionary = dictionary_of(docs, text)
    model = train(labelled_findings(docs.sparkSession) if labelled is None else labelled, dictionary)
    return scan(docs, model, dictionary, id, text, path)


def digests(docs: DataFrame) -> DataFrame:
    found = findings(docs)
    return found.select("doc_id", "word", "part", F.length("token").cast("long").alias("length"), F.sha2("token", 256).alias("token_sha256"), "score", "is_secret")

"""Host-level quality rules, in DataFrame expressions only.

Every document gets base statistics and three soft rules. Rule failures are aggregated by host
(``source``); each host's failure rate is shrunk towards the corpus by a beta prior whose two
parameters are fitted to the hosts' rates by moments; a host whose shrunk rate for a rule passes
that rule's limit is flagged for it. The verdict joins back: a document goes if it fails a base
rule, or fails a soft rule for which its host is flagged. A clean document stays on any host.

Defined results: a null text has no words and fails the base rule; a null host is a host of its
own; repeated rows count as often as they stand; an empty table gives an empty result; a rule's tie
(a share just at its limit) is no failure, a host's rate just at the limit flags it; a very long text
is one row whose words are held as arrays; other columns keep their names and values, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.scratch import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Soft rules: at most so many symbols per 100 words, duplicate lines per 100 words, and
#: characters in 10 words outside of [low, high].
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 5
WORD_CHARS_X10 = (20, 120)
#: A host is flagged for a rule when its shrunk failure rate is at least this.
HOST_RATE = 0.05
#: With at most so many hosts their verdicts are broadcast; beyond, they are joined by shuffling.
BROADCAST_HOSTS = 20_000
RULES = ("base", "symbols", "lines", "shape")

_BLANKS = " \t\n\x0b\x0c\r"
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    body = F.btrim(text, F.lit(_BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \t-\r]+"))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column computed once: a generator keeps the optimiser from copying it into lambdas."""
    return df.withColumn(name, F.explode(F.array(value)))


def _tail(items: str, start: int, drop: int) -> Column:
    return F.slice(F.col(items), F.lit(start), F.greatest(F.size(items) - drop, F.lit(0)))


def _prefix(columns: list[str]) -> str:
    """What own columns begin with: no input column does."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def with_statistics(docs: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the five statistics of each whole text, named with ``prefix``."""
    own = lambda name: prefix + "s_" + name
    c = lambda name: F.col(own(name))
    tail = lambda name, start, drop: _tail(own(name), start, drop)
    df = _held(docs.withColumn(own("text"), F.coalesce(F.col(text), F.lit(""))), own("words"), _words(F.coalesce(F.col(text), F.lit(""))))
    df = _held(df, own("lines"), F.filter(F.split(c("text"), "\n"), lambda x: x.rlike("[^ \t-\r]")))
    df = _held(df, own("hash"), F.transform(c("words"), lambda w: F.xxhash64(w)))
    pairs = F.zip_with(tail("hash", 1, 2), tail("hash", 2, 2), lambda a, b: F.xxhash64(a, b))
    df = _held(df, own("windows"), F.zip_with(pairs, tail("hash", 3, 2), lambda p, c: F.xxhash64(p, c)))
    # Windows found twice or more, then their places; most texts have none and stop there.
    repeated = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    placed = F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _held(df, own("placed"), F.when(repeated, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = F.zip_with(tail("placed", 1, 1), tail("placed", 2, 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    df = _held(df, own("at"), F.sort_array(F.array_distinct(F.flatten(same))))
    gaps = F.zip_with(tail("at", 1, 1), tail("at", 2, 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap) + F.when(F.size(c("at")) > 0, 3).otherwise(0)
    out = {
        "n_words": F.size(c("words")),
        "word_chars": F.length(F.array_join(c("words"), "")),
        "n_symbols": F.length(c("text")) - F.length(F.regexp_replace(c("text"), "[#*$%&|<>]", "")),
        "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
        "n_repeat_words": covered,
    }
    return df.select(*docs.columns, *[value.cast("long").alias(prefix + name) for name, value in out.items()])


def failures(prefix: str) -> dict[str, Column]:
    """Rule name to failed; every rule is a comparison of whole numbers."""
    n, chars, symbols, lines, repeats = (F.col(f"{prefix}{x}") for x in _STATS)
    base = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    low, high = WORD_CHARS_X10
    return {
        "base": base,
        "symbols": 100 * symbols > MAX_SYMBOL_PERCENT * n,
        "lines": 100 * lines > MAX_DUP_LINE_PERCENT * n,
        "shape": (10 * chars < low * n) | (10 * chars > high * n),
    }


def host_verdicts(stats: DataFrame, prefix: str, host: str = "source") -> DataFrame:
    """Per host the flags of each soft rule, from failure rates shrunk by an empirical beta prior."""
    failed = failures(prefix)
    counts = stats.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(failed[r], 1).otherwise(0)).alias(f"k_{r}") for r in RULES])
    counts = materialise(counts, "hosts")
    prior = counts.agg(
        *[F.avg(F.col(f"k_{r}") / F.col("n")).alias(f"m_{r}") for r in RULES],
        *[F.var_pop(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES],
    )
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        # Method of moments, kept between a prior worth 2 and one worth 1,000 documents.
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(2.0)), F.lit(1000.0))).otherwise(1000.0)
        prior = prior.withColumn(f"s_{r}", strength)
    flagged = counts.join(F.broadcast(prior))  # one row
    rate = {r: (F.col(f"k_{r}") + F.col(f"m_{r}") * F.col(f"s_{r}")) / (F.col("n") + F.col(f"s_{r}")) for r in RULES}
    return flagged.select(F.col("host").alias(f"{prefix}host"), *[(rate[r] >= HOST_RATE).alias(f"{prefix}flag_{r}") for r in RULES])


def _judged(docs: DataFrame, text: str, host: str, carry: tuple[str, ...]) -> tuple[DataFrame, str, Column, Column]:
    """``carry`` and the statistics under a prefix of their own, that prefix, and both verdicts."""
    prefix = _prefix(docs.columns)
    wanted = list(dict.fromkeys([*carry, host]))
    stats = with_statistics(docs.select(*dict.fromkeys([*wanted, text])), prefix, text)
    stats = materialise(stats.select(*wanted, *[f"{prefix}{x}" for x in _STATS]), "quality")
    verdicts = materialise(host_verdicts(stats, prefix, host), "verdicts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = stats.join(verdicts, F.col(host).eqNullSafe(F.col(f"{prefix}host")), "left")
    failed = failures(prefix)
    soft = reduce(lambda a, b: a | b, [failed[r] & F.col(f"{prefix}flag_{r}") for r in RULES[1:]])
    return joined, prefix, failed["base"], ~failed["base"] & ~F.coalesce(soft, F.lit(False))


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, the statistics, ``base_failed`` and ``kept`` for every row."""
    joined, prefix, base, kept = _judged(docs, text, host, carry)
    return joined.select(*carry, *[F.col(f"{prefix}{x}").alias(x) for x in _STATS], base.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    joined, _, _, kept = _judged(docs, text, host, tuple(docs.columns))
    return joined.where(kept).select(*docs.columns)


#: The same result in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM d),
s AS (SELECT *, [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] AS tri FROM w),
u AS (SELECT doc_id, unnest(tri) AS g, unnest(range(1, len(tri) + 1)) AS i FROM s),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM
      (SELECT DISTINCT doc_id, i + k AS p FROM r, range(3) q(k) WHERE n > 1) GROUP BY doc_id),
b AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM s LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
      100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words AS f1, 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_words AS f2,
      (10 * word_chars < {WORD_CHARS_X10[0]} * n_words OR 10 * word_chars > {WORD_CHARS_X10[1]} * n_words) AS f3 FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (f1) AS k1, count(*) FILTER (f2) AS k2, count(*) FILTER (f3) AS k3
      FROM f GROUP BY source),
l AS (SELECT source, n, unnest([1, 2, 3]) AS rule, unnest([k1, k2, k3]) AS k FROM h),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM l GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM m),
g AS (SELECT source, bool_or(rule = 1 AND (k + m * s) / (n + s) >= {HOST_RATE}) AS g1,
      bool_or(rule = 2 AND (k + m * s) / (n + s) >= {HOST_RATE}) AS g2,
      bool_or(rule = 3 AND (k + m * s) / (n + s) >= {HOST_RATE}) AS g3 FROM l JOIN p USING (rule) GROUP BY source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ((f1 AND g1) OR (f2 AND g2) OR (f3 AND g3)) AS kept
FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source
"""

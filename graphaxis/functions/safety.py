"""Safe materialisation: text becomes a displayable value or null, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammars of safe values.
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9._:@/-]{0,255}$"
ENVIRONMENT_KEY = "^[A-Z_][A-Z0-9_]{0,255}$"
PATH_SEGMENT = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
DIAGNOSTIC = "^[A-Z][A-Z0-9_]{0,63}$"
OPAQUE, OPAQUE_PATH, UNSAFE_DIAGNOSTIC = "<opaque>", "<opaque-path>", "UNSAFE_DIAGNOSTIC"
LONGEST, LEAST_SECRET, LEAST_ENTROPY = 512, 24, 3.5
# Prefixes of well-known credentials.
SECRET_PREFIXES = (
    "(?i)^sk_(?:live|test)_",
    "(?i)^rk_(?:live|test)_",
    "(?i)^pk_(?:live|test)_",
    "^gh[pousr]_",
    "(?i)^github_pat_",
    "(?i)^glpat-",
    "(?i)^xox[abprs]-",
    "^AKIA[0-9A-Z]{16}$",
    "^ASIA[0-9A-Z]{16}$",
    "^AIza[0-9A-Za-z_-]{20,}$",
    "^ya29\\.[0-9A-Za-z_-]{10,}$",
    "^npm_[0-9A-Za-z]{20,}$",
    "^eyJ[0-9A-Za-z_-]{10,}\\.",
)

#: What Java's ``$`` would let stand after the end.
_LINE_END = "[\\n\\r\\u0085\\u2028\\u2029]\\z"


def matches(value: Column, grammar: str) -> Column:
    """A grammar's ``$`` is the end of the value; no line end may follow."""
    return value.rlike(grammar) & ~value.rlike(_LINE_END) if grammar.endswith("$") else value.rlike(grammar)


def code_units(value: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.octet_length(F.encode(value, "UTF-16BE")) / 2


def shannon_entropy(value: Column) -> Column:
    """V5: bits per character; shares are of the length in UTF-16 code units, characters are code points."""
    chars = F.split(value, "")
    n = code_units(value)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda total, k: total - (k / n) * F.log2(k / n))


def is_secret_like(value: Column) -> Column:
    """V4: a known prefix, or a long mixed token of high entropy."""
    known = reduce(lambda a, b: a | b, [matches(value, p) for p in SECRET_PREFIXES])
    compact = F.regexp_replace(value, "[._:@/-]", "")
    mixed = (code_units(compact) >= LEAST_SECRET) & compact.rlike("[a-z]") & compact.rlike("[A-Z]") & compact.rlike("[0-9]")
    return known | F.when(mixed, shannon_entropy(compact) >= LEAST_ENTROPY).otherwise(False)


def environment_key(value: Column, trusted: Column | None = None) -> Column:
    """V1: the key, or null where it is opaque. ``trusted``: an array of allowed keys."""
    good = matches(value, ENVIRONMENT_KEY) & ~is_secret_like(value)
    if trusted is not None:
        good = good | F.coalesce(F.array_contains(trusted, value), F.lit(False))
    return F.when(good, value)


def generic_identifier(value: Column) -> Column:
    """V2."""
    return F.when(matches(value, IDENTIFIER) & ~is_secret_like(value), value)


def structured_identifier(value: Column, grammar: str) -> Column:
    """V3: a caller's grammar, bounded length, not like a secret."""
    return F.when((code_units(value) <= LONGEST) & matches(value, grammar) & ~is_secret_like(value), value)


def _segments_safe(path: Column) -> Column:
    return F.forall(F.split(path, "/"), lambda p: matches(p, PATH_SEGMENT) & ~is_secret_like(p))


def safe_path(value: Column, root: Column | None = None) -> Column:
    """V6: relative (to ``root``, if given, of a canonical path), no escape, every segment displayable."""
    if root is not None:
        base = F.rtrim(root, F.lit("/"))
        value = F.when(F.startswith(value, F.concat(base, F.lit("/"))), F.substring(value, F.length(base) + 2, F.length(value)))
    return F.when(value.isNotNull() & _segments_safe(value), value).otherwise(OPAQUE_PATH)


def root_relative_path(value: Column) -> Column:
    """V7: as V6, with the root itself as its own marker; null where unsafe."""
    trimmed = F.regexp_replace(value, "^\\./", "")
    path = safe_path(trimmed)
    return F.when(trimmed.isin("", "."), "<root>").when(path != OPAQUE_PATH, path)


def diagnostic_code(value: Column) -> Column:
    return F.when(matches(value, DIAGNOSTIC), value).otherwise(UNSAFE_DIAGNOSTIC)


def timestamp(value: Column) -> Column:
    """V8: UTC ISO-8601 to milliseconds, null where malformed or no such day."""
    shaped = matches(value, "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{3})?Z$")
    millis = F.when(F.length(value) == 24, F.substring(value, 20, 4)).otherwise(".000")
    exists = shaped & F.try_to_timestamp(value).isNotNull()
    return F.when(exists, F.concat(F.substring(value, 1, 19), millis, F.lit("Z")))


def redacted(value: Column, marker: str = OPAQUE) -> Column:
    """The second gate, before anything is shown."""
    bad = (code_units(value) > LONGEST) | value.rlike("[\\x00-\\x1f\\x7f]") | is_secret_like(value)
    return F.when(value.isNull() | bad, marker).otherwise(value)

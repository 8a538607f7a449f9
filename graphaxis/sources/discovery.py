"""Source discovery: files as rows, rejected ones as skips.

The walk itself runs where the files are (on the driver, for a local root); everything after it,
language, exclusions, budgets, is expressions over the walked table, so that a listing of any other
store takes the same path.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Languages by extension, folders never entered, limits, and what becomes a gap.
LANGUAGES = {".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx", ".ts": "ts", ".mts": "ts", ".cts": "ts", ".tsx": "tsx"}
EXCLUDED = (".git", ".hg", ".jj", ".svn", ".turbo", ".next", "node_modules", "dist", "build", "coverage", "out")
IGNORE_FILES = (".gitignore", ".secret-usageignore")
MAX_DEPTH, MAX_FILES, MAX_BYTES, MAX_FILE_BYTES = 40, 100_000, 512 << 20, 5 << 20
GAP_CODES = ("BUDGET_EXCEEDED", "UNREADABLE", "OVERSIZE", "DEPTH_EXCEEDED", "IGNORED", "SYMLINK", "GENERATED")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """S2."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path))


def excluded(path: Column) -> Column:
    """S3: a folder on the way is never entered."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED)))


def generated(path: Column) -> Column:
    """S5."""
    return path.rlike("\\.d\\.ts$|\\.map$|(?i)\\.min\\.[cm]?[jt]sx?$")


def classify(listing: DataFrame) -> DataFrame:
    """Adds ``language`` and ``code`` (null for a source) to ``path``, ``bytes``, ``depth``, ``kind``, ``ignored``."""
    path = F.col("path")
    code = (
        F.when(F.col("kind") == "outside", "OUTSIDE_ROOT").when(F.col("kind") == "symlink", "SYMLINK").when(excluded(path), "EXCLUDED_DIRECTORY").when(F.col("ignored"), "IGNORED")
        .when(F.col("kind") == "special", "SPECIAL_FILE").when(F.col("depth") > MAX_DEPTH, "DEPTH_EXCEEDED").when(generated(path), "GENERATED").when(language(path).isNull(), "UNSUPPORTED_FILE")
        .when(F.col("kind") == "unreadable", "UNREADABLE").when(F.col("bytes") > MAX_FILE_BYTES, "OVERSIZE")
    )
    return listing.withColumn("language", language(path)).withColumn("code", code)


def within_budget(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """B1: in order, the first file over a limit stops everything from it on (``BUDGET_EXCEEDED``).

    Only files that nothing else rejects count. Prefix sums are a window by root; a root is one walk.
    """
    w = W.partitionBy("root_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    good = F.col("code").isNull()
    over = (F.count_if(good).over(w) > max_files) | (F.sum(F.when(good, F.col("bytes"))).over(w) > max_bytes)
    return files.withColumn("code", F.when(~good, F.col("code")).when(over, "BUDGET_EXCEEDED"))


def walk(root: str) -> Iterator[tuple[int, str, int, int, str, bool]]:
    """Every entry below a local root, depth first, entries in order."""
    real = os.path.realpath(root)
    count = 0

    def visit(folder: str, depth: int, ignores: tuple[tuple[str, tuple[tuple[bool, re.Pattern], ...]], ...]):
        nonlocal count
        here = tuple((folder, rules) for name in IGNORE_FILES if (rules := read_ignore(os.path.join(folder, name))))
        ignores = ignores + here
        try:
            entries = sorted(os.scandir(folder), key=lambda e: (e.name.lower(), e.name))
        except OSError:
            yield count, os.path.relpath(folder, real), 0, depth, "unreadable", False
            count += 1
            return
        for entry in entries:
            path = os.path.relpath(entry.path, real)
            skip = any(is_ignored(os.path.relpath(entry.path, base), entry.is_dir(follow_symlinks=False), rules) for base, rules in ignores)
            if entry.is_symlink():
                kind = "symlink"
            elif entry.is_dir(follow_symlinks=False):
                if entry.name in EXCLUDED or skip or depth >= MAX_DEPTH:
                    yield count, path + "/", 0, depth + (depth >= MAX_DEPTH), "folder", skip
                    count += 1
                else:
                    yield from visit(entry.path, depth + 1, ignores)
                continue
            else:
                kind = "file" if entry.is_file(follow_symlinks=False) else "special"
            try:
                size = entry.stat(follow_symlinks=False).st_size
            except OSError:
                size, kind = 0, "unreadable"
            yield count, path, size, depth, kind, skip
            count += 1

    yield from visit(real, 0, ())


def read_ignore(path: str) -> tuple[tuple[bool, re.Pattern], ...]:
    try:
        with open(path, encoding="utf-8", errors="replace") as lines:
            return tuple(rule for line in lines if (rule := ignore_rule(line.rstrip("\n"))))
    except OSError:
        return ()


def ignore_rule(line: str) -> tuple[bool, re.Pattern] | None:
    """One gitignore line: whether it re-includes, and what it matches."""
    line = line.rstrip() if not line.endswith("\\ ") else line
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[negated:].removeprefix("\\")
    folder, anchored = body.endswith("/"), "/" in body.strip("/") or body.startswith("/")
    pieces = []
    for part in body.strip("/").split("/"):
        pieces.append("(?:[^/]+/)*" if part == "**" else re.sub(r"\(\?s:(.*)\)\\[Zz]", r"\1", fnmatch.translate(part)).replace(".*", "[^/]*").replace("(?>[^/]*?", "(?:[^/]*?") + "/")
    text = "".join(pieces).removesuffix("/") if pieces[-1] != "(?:[^/]+/)*" else "".join(pieces) + ".*"
    return negated, re.compile(("" if anchored else "(?:.*/)?") + text + ("/" if folder else "/?") + "$")


def is_ignored(path: str, folder: bool, rules: tuple[tuple[bool, re.Pattern], ...]) -> bool:
    """The last rule that matches decides."""
    shown, out = path + ("/" if folder else ""), False
    for negated, pattern in rules:
        if pattern.match(shown):
            out = not negated
    return out


def discover(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources (without content) and skips (S7) of local roots; the deepest of nested roots owns a file."""
    rows = []
    real = sorted({os.path.realpath(r) for r in roots}, key=lambda r: (-len(r), r))
    for n, root in enumerate(real):
        inner = [os.path.relpath(r, root) for r in real if r != root and r.startswith(root + os.sep)]
        rows += [(f"root-{n}", *e) for e in walk(root) if not any(e[1] == i or e[1].startswith(i + "/") for i in inner)]
    listing = spark.createDataFrame(rows, "root_id string, ord long, path string, bytes long, depth int, kind string, ignored boolean")
    judged = within_budget(classify(listing))
    sources = judged.where("code is null").select("root_id", "ord", "path", "language", "bytes")
    return sources, judged.where("code is not null").select("root_id", "path", "code")


def gap_skips(skips: DataFrame) -> DataFrame:
    """Skips that leave demand unknown."""
    return skips.where(F.col("code").isin(*GAP_CODES))

"""Which paths of a tree count: pruned directories, extensions, ignore patterns."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories that are never entered, and the default ignore patterns' syntax below.
PRUNED = (".venv", ".git", "node_modules", "__pycache__", ".pytest_cache", "venv")


def expand_gitignore(lines: Iterable[str]) -> list[str]:
    """Patterns of an ignore file: blank lines and comments go, each rule becomes two patterns."""
    out = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            out += [f"{line[:-1]}/**", line[:-1]] if line.endswith("/") else [line, f"**/{line}"]
    return out


def expanded(line: Column) -> Column:
    """``expand_gitignore`` for one line, as an array."""
    rule = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    bare = F.regexp_replace(rule, "/$", "")
    pair = F.when(F.endswith(rule, F.lit("/")), F.array(F.concat(bare, F.lit("/**")), bare)).otherwise(F.array(rule, F.concat(F.lit("**/"), rule)))
    return F.when((rule == "") | F.startswith(rule, F.lit("#")), F.array().cast("array<string>")).otherwise(pair)


def pattern_regex(patterns: Iterable[str]) -> str | None:
    """One regular expression for all patterns; ``*`` crosses slashes."""
    parts = [re.sub(r"\\[Zz]$", "", fnmatch.translate(p)) for p in patterns]
    return "^(?:" + "|".join(parts) + r")\z" if parts else None


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether the path, or a directory it lies in, matches a pattern."""
    regex = pattern_regex(patterns)
    if regex is None:
        return F.lit(False)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.exists(prefixes, lambda p: p.rlike(regex))


def pruned(path: Column, names: Iterable[str] = PRUNED) -> Column:
    """Whether a directory of the path is never entered; the file's own name does not count."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def shut(folder: Column, patterns: Iterable[str] = ()) -> Column:
    """Whether a folder's files are all excluded, so that it need not be entered."""
    return F.element_at(F.split(folder, "/"), -1).isin(*PRUNED) | ignored(folder, patterns)


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    return path.rlike(r"(?:" + "|".join(re.escape(e) for e in extensions) + r")$")


def kept(paths: DataFrame, extensions: Iterable[str], patterns: Iterable[str] = (), column: str = "rel_path") -> DataFrame:
    p = F.col(column)
    return paths.where(has_extension(p, extensions) & ~pruned(p) & ~ignored(p, patterns))

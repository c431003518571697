"""Text columns: newlines, lines, analyzers, truncation, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the words of the default analyzer.
WORD_BREAK = r"[^\p{L}\p{N}_]+"
MAX_LINES = 50
TRUNCATED = "\n... (truncated)"


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def not_blank(text: Column) -> Column:
    """Whether the text has anything but white space; a null has not."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, 1-based and inclusive."""
    return F.array_join(F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def terms(text: Column, parts: bool = False) -> Column:
    """Lower-cased words, in order; with ``parts`` also what underscores and camel case join."""
    whole = F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: F.length(t) > 0)
    if not parts:
        return whole
    apart = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), "_", " "))
    more = F.filter(F.split(apart, WORD_BREAK), lambda t: F.length(t) > 0)
    return F.concat(whole, F.filter(more, lambda t: ~F.array_contains(whole, t)))


def truncated(text: Column, limit: int = MAX_LINES) -> tuple[Column, Column]:
    """The first ``limit`` lines with a notice, and whether anything was cut."""
    all_lines = lines(text)
    cut = F.size(all_lines) > limit
    return F.when(cut, F.concat(F.array_join(F.slice(all_lines, 1, limit), "\n"), F.lit(TRUNCATED))).otherwise(text), cut


def rounded(score: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(score, digits)

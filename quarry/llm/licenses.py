"""License scans by conditional compression.

A candidate block is a run of words that holds enough of a template in order, wherever it stands: lines of
any length, notices wrapped over lines and behind comment markers, several in one line. The words
around every anchor of a template are aligned with it, which finds each block with the fewest other words
between. Anchors are chosen so that no block can lack one. A block is compressed with zstandard alone and
with the template as a raw dictionary; the more a template says of what the block says, the more bytes
it saves, and of overlapping blocks the one that saves most stays.

Words are runs of letters, or numbers without final zeros (2.0 is 2), in any case. A block lacks at most
a fifth of its template's words, and has at most a quarter of their number, or 4, of other words in between. Words
that name a licence (NAMING, and the numbers of a template that has any) must all agree.

Defined results: null and empty texts have no blocks; a block that no template explains gives no row;
several licences in one text give a row each, as does the same one in several places. Ties in bytes saved go to the
closer wording, then to the template that sorts first.
"""

from __future__ import annotations

import operator
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Customary licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Share of a template's words that a block must have, in order.
COVERED = 0.8
#: Other words that may stand between them: so many, or this share of the template's words.
EXTRA = 4
EXTRA_SHARE = 0.25
#: Words that tell licences apart: a block has all of its template's and no others. So do numbers, where a template has any.
NAMING = frozenset(
    "affero agpl alike apache artistic attribution boost bsd cc cddl cecill commercial commons creative derivatives derivs documentation eclipse epl eupl expat general "
    "gnu gpl isc lesser lgpl mit mozilla mpl nc nd noncommercial noderivatives noderivs sa sharealike unlicense zlib".split()
)
#: Words of a text that are held at once.
CHUNK = 1 << 16
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
_ONE = np.int64(1) << 20  # the cost of an extra word; the bits below hold how far from the end a block begins
_FAR = np.int64(1) << 36  # a cost that no block may have
_NONE = np.int64(1) << 60


def _word(found: str) -> str:
    return re.sub(r"(\.0+)+$", "", found) if found[0].isdigit() else found.lower().replace("licenc", "licens")


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        found = list(_WORD.finditer(text))
        self.words = [_word(m[0]) for m in found]
        self.tail = text[found[-1].end() :]
        self.missing = int(len(self.words) - COVERED * len(self.words) + 1e-9)
        self.extra = max(EXTRA, int(EXTRA_SHARE * len(self.words)))
        self.numbered = any(w[0].isdigit() for w in self.words)
        self.naming = sorted({w for w in self.words if self.names(w)})
        # a block lacks at most ``missing`` words, none of them naming: it has all of the latter, and one of any missing + 1 words
        by_length = sorted(set(self.words), key=lambda w: (-len(w), w))
        letters = [w for w in by_length if w in self.naming and not w[0].isdigit()]
        self.likely = by_length[: self.missing + 1]
        self.anchors = letters[:1] or self.likely
        self.primed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def names(self, word: str) -> bool:
        return word in NAMING or (self.numbered and word[0].isdigit())

    def blocks(self, words: list[str], hits: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(first word, last word, template words missing, other words between) of blocks that do not overlap, closest wording first."""
        reach = len(self.words) + self.extra
        near = np.zeros(len(words) + 1, np.int64)
        for at in hits:
            near[max(0, at - reach)] += 1
            near[min(len(words), at + reach + 1)] -= 1
        places = np.flatnonzero(np.cumsum(near[:-1]))
        text = [words[p] for p in places]
        if not set(self.naming) <= set(text):
            return
        # costs of a word that stands between; a gap in the places cannot be crossed
        cost = np.array([_FAR if self.names(w) else _ONE for w in text])
        cost[1:][np.diff(places) > 1] = _FAR
        sums = np.r_[0, np.cumsum(cost)]
        n = len(text)
        # best[x, j]: least extra words, and where the block begins, of a block with x missing that ends before word j
        best = np.full((self.missing + 1, n + 1), _NONE)
        best[0] = n - np.arange(n + 1)
        codes = np.array([self._code.get(w, -1) for w in text])
        for w in self.words:
            step = np.full_like(best, _NONE)
            step[:, 1:] = np.where(codes == self._code[w], best[:, :-1], step[:, 1:])
            if not self.names(w):
                step[1:] = np.minimum(step[1:], best[:-1])
            best = np.minimum.accumulate(step - sums, axis=1) + sums
        missing, end = np.nonzero(best < (self.extra + 1) * _ONE)
        extra, begin = np.divmod(best[missing, end], _ONE)
        begin = n - begin
        used = np.zeros(n, bool)
        for k in np.lexsort((begin, missing, missing + extra)):
            a, b = begin[k], end[k]
            if not used[a:b].any():
                used[a:b] = True
                yield int(places[a]), int(places[b - 1]), int(missing[k]), int(extra[k])

    @cached_property
    def _code(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(dict.fromkeys(self.words))}


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = [Template(n, templates[n]) for n in sorted(templates)]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.overlap = 2 * max(len(t.words) + t.extra for t in self.templates) + 1
        self.anchors: dict[str, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.anchors:
                self.anchors.setdefault(w, []).append(k)

    def _saved(self, block: str, template: Template) -> int:
        raw = block.lower().encode("utf-8", "surrogatepass")
        return len(self.plain.compress(raw)) - len(template.primed.compress(raw))

    def _blocks(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(template, start, end, missing, extra) of all blocks."""
        found, held = _WORD.finditer(text), []
        while fresh := list(islice(found, CHUNK)):
            held += [(_word(m[0]), m.start(), m.end()) for m in fresh]
            words = [w for w, _, _ in held]
            hits: dict[int, list[int]] = {}
            for at, w in enumerate(words):
                for k in self.anchors.get(w, ()):
                    hits.setdefault(k, []).append(at)
            for k, places in hits.items():
                for a, b, missing, extra in self.templates[k].blocks(words, places):
                    tail = self.templates[k].tail
                    end = held[b][2]
                    yield k, held[a][1], end + len(tail) * text.startswith(tail, end), missing, extra
            held = held[-self.overlap :]

    def text(self, text: str) -> Iterator[tuple[str, int, int, int, int, int]]:
        found = []
        for k, start, end, missing, extra in set(self._blocks(text)):
            found.append((-self._saved(text[start:end], self.templates[k]), missing + extra, self.templates[k].name, start, end, missing, extra))
        taken: list[tuple[int, int]] = []  # by start, without overlaps
        kept = []
        for saved, _, name, start, end, missing, extra in sorted(found):
            at = bisect_left(taken, (start, end))
            if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                continue
            taken.insert(at, (start, end))
            kept.append((name, start, end, -saved, missing, extra))
        yield from sorted(kept, key=lambda r: r[1])

    def may_have(self, text: Column) -> Column:
        """What every text with a block satisfies: a cheap test before any Python."""
        low = F.regexp_replace(F.lower(text), "licenc", "licens")
        tests = [reduce(operator.and_, [low.contains(w) for w in t.naming], reduce(operator.or_, [low.contains(w) for w in t.likely])) for t in self.templates]
        return reduce(operator.or_, tests)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """A row for each licensed block: doc_id, license, start, end, bytes_saved, words_missing, words_extra."""
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(chosen)
        for batch in batches:
            rows = [(d, *found) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for found in scanner.text(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "start", "end", "bytes_saved", "words_missing", "words_extra"])
            yield out.astype({c: np.int64 for c in out.columns if c != "license"})

    # texts without the words that a block must have are left out before any Python
    maybe = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(Scanner(chosen).may_have(F.col("text")) & F.col("doc_id").isNotNull())
    return maybe.mapInPandas(run, "doc_id long, license string, start long, end long, bytes_saved long, words_missing long, words_extra long")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

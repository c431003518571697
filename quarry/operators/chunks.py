"""Chunking a table of files: dispatch by extension, blank guard, one row for each chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import newlines, not_blank

from .markdown import chunk_markdown
from .python_chunks import python_chunks
from .rust_chunks import rust_chunks

CHUNK_TYPES = ("module", "function", "class", "method", "section")
SCHEMA = "file_path string, line_start int, line_end int, content string, chunk_type string, name string"
Spans = Callable[[str, str], list[tuple[int, int, str, str]]]


def from_spans(files: DataFrame, spans: Spans) -> DataFrame:
    """Chunks of (file_path, content) by a function from (source, stem) to spans, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source in zip(batch["file_path"], batch["content"], strict=True):
                stem = path.rsplit("/", 1)[-1]
                stem = stem.rsplit(".", 1)[0] or stem
                split = source.split("\n")
                rows += [(path, a, b, "\n".join(split[a - 1 : b]), kind, name) for a, b, kind, name in spans(source, stem)]
            yield pd.DataFrame(rows, columns=["file_path", "line_start", "line_end", "content", "chunk_type", "name"]).astype({"line_start": "int32", "line_end": "int32"})

    read = files.select("file_path", newlines(F.col("content")).alias("content")).where(not_blank(F.col("content")))
    return read.mapInPandas(run, SCHEMA)


def chunk_python(files: DataFrame) -> DataFrame:
    return from_spans(files, python_chunks)


def chunk_rust(files: DataFrame) -> DataFrame:
    return from_spans(files, rust_chunks)


class Registry:
    """Chunkers by extension, such as ``.py``."""

    def __init__(self, chunkers: Iterable[tuple[Iterable[str], Callable[[DataFrame], DataFrame]]]):
        self.by_extension: dict[str, Callable[[DataFrame], DataFrame]] = {}
        for extensions, chunker in chunkers:
            for e in extensions:
                if e in self.by_extension:
                    raise ValueError(f"two chunkers for {e}")
                self.by_extension[e] = chunker

    @property
    def extensions(self) -> list[str]:
        return sorted(self.by_extension)

    def chunk(self, files: DataFrame) -> DataFrame:
        """Chunks of every file whose extension is known; other files give none."""
        suffix = F.regexp_extract(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)(\.[^.]+)$", 1)
        parts = [chunker(files.where(suffix == e)) for e, chunker in self.by_extension.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def default_registry() -> Registry:
    return Registry([([".py"], chunk_python), ([".rs"], chunk_rust), ([".md"], chunk_markdown)])


def valid(chunks: DataFrame) -> DataFrame:
    """Rows that are chunks: line_start at least 1, line_end no less, a known type."""
    return chunks.where((F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & F.col("chunk_type").isin(*CHUNK_TYPES))


def invalid(chunks: DataFrame) -> DataFrame:
    """The rest, for quarantine."""
    ok = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & F.col("chunk_type").isin(*CHUNK_TYPES)
    return chunks.where(~F.coalesce(ok, F.lit(False)))

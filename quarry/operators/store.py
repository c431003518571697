"""The store: immutable snapshots of chunks, manifest and keyword index, and a pointer to the current one.

A commit writes a new snapshot beside the old ones and then replaces the pointer, so readers see all
of it or nothing, and a lost executor only repeats tasks. The folder may be on any file system that
Spark writes to.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fts
from . import manifest as m

CHUNKS = "chunk_id string, file_path string, line_start int, line_end int, content string, chunk_type string, name string, vector array<float>"
MANIFEST = "file_path string, mtime double"
#: Snapshots that stay: the current one and what its readers may still hold.
KEPT = 2


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def delete_by_file(old: DataFrame, files: DataFrame) -> DataFrame:
    return old.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*old.columns)


def replace_by_file(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """The old chunks but for those of the touched files, and the new ones."""
    return delete_by_file(old, touched).unionByName(new)


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        """Name of the current snapshot."""
        fs, path = self._fs()
        pointers = fs.globStatus(path(f"{self.path}/CURRENT-*"))
        names = sorted(p.getPath().getName() for p in pointers or [])
        return names[-1].split("-", 2)[2] if names else None

    def committed_at(self) -> float | None:
        """Epoch seconds of the last commit."""
        fs, path = self._fs()
        times = [p.getModificationTime() / 1000 for p in fs.globStatus(path(f"{self.path}/CURRENT-*")) or []]
        return max(times, default=None)

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.current()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{at}/{name}") if at else self.spark.createDataFrame([], schema)

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    @property
    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", "term string, chunk_id string, tf long")

    @property
    def lengths(self) -> DataFrame:
        return self._read("lengths", "chunk_id string, dl long")

    def commit(self, chunks: DataFrame, manifest: DataFrame, dimension: int | None = None) -> str:
        """Publish chunks, manifest and the keyword index derived from them."""
        name = f"snapshot-{uuid.uuid4().hex}"
        rows = chunks
        if dimension:
            fits = F.assert_true(F.size("vector") == dimension, F.lit(f"a vector is not {dimension} wide"))
            rows = chunks.where(fits.isNull())
        rows.write.parquet(f"{self.path}/{name}/chunks")
        manifest.write.parquet(f"{self.path}/{name}/manifest")
        stored = self.spark.read.schema(CHUNKS).parquet(f"{self.path}/{name}/chunks")
        # sorted by term, so that a query's terms touch few row groups
        fts.postings(stored).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/{name}/postings")
        fts.doc_lengths(stored).write.parquet(f"{self.path}/{name}/lengths")
        fs, path = self._fs()
        pointers = sorted(p.getPath().getName() for p in fs.globStatus(path(f"{self.path}/CURRENT-*")) or [])
        number = int(pointers[-1].split("-")[1]) + 1 if pointers else 0
        fs.create(path(f"{self.path}/.next-{name}"), True).close()
        fs.rename(path(f"{self.path}/.next-{name}"), path(f"{self.path}/CURRENT-{number:012d}-{name}"))
        for old in pointers[: max(0, len(pointers) + 1 - KEPT)]:
            fs.delete(path(f"{self.path}/{old}"), False)
            fs.delete(path(f"{self.path}/{old.split('-', 2)[2]}"), True)
        return name

    def clear(self) -> None:
        self.commit(self.spark.createDataFrame([], CHUNKS), self.spark.createDataFrame([], MANIFEST))


def indexed_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct()


def stats(chunks: DataFrame) -> DataFrame:
    """One row: files_count, chunks_count."""
    return chunks.agg(F.count_distinct("file_path").alias("files_count"), F.count("*").alias("chunks_count"))


def status(chunks: DataFrame, current: DataFrame, manifest: DataFrame, last_updated: Column | None = None) -> DataFrame:
    """One row: is_indexed, last_updated, files_count, chunks_count, stale_count."""
    stale = m.stale_files(current, manifest).agg(F.count("*").alias("stale_count"))
    row = stats(chunks).crossJoin(stale)  # one row each
    return row.select((F.col("files_count") > 0).alias("is_indexed"), (last_updated if last_updated is not None else F.lit(None).cast("timestamp")).alias("last_updated"), "files_count", "chunks_count", "stale_count")

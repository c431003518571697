"""Change detection: a manifest of modification times against the files there are now.

``current`` and ``manifest`` are (file_path, mtime). A path is a key; times differ if unequal, newer or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, MODIFIED, DELETED = "new", "modified", "deleted"


def changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, change) of every path that is new, modified or deleted: one full outer join."""
    a = current.select("file_path", F.col("mtime").alias("now"), F.lit(True).alias("here"))
    b = manifest.select("file_path", F.col("mtime").alias("then"), F.lit(True).alias("known"))
    change = F.when(F.col("known").isNull(), NEW).when(F.col("here").isNull(), DELETED).when(F.col("now") != F.col("then"), MODIFIED)
    return a.join(b, "file_path", "full_outer").select("file_path", change.alias("change")).where("change IS NOT NULL")


def new_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return current.join(manifest, "file_path", "left_anti").select("file_path")


def modified_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    then = manifest.select("file_path", F.col("mtime").alias("then"))
    return current.join(then, "file_path").where("mtime <> then").select("file_path")


def deleted_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(current, "file_path", "left_anti").select("file_path")


def stale_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """New and modified files; deleted ones are not stale."""
    return changes(current, manifest).where(F.col("change") != DELETED)


def has_changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: has_changes, has_work (anything to index or delete)."""
    found = changes(current, manifest).agg(F.count("*").alias("n"))
    return found.select((F.col("n") > 0).alias("has_changes"), (F.col("n") > 0).alias("has_work"))


def scan_plan(current: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """(file_path, action): what to index and what to delete. Forced: index all, delete nothing."""
    if force:
        return current.select("file_path", F.lit("index").alias("action"))
    action = F.when(F.col("change") == DELETED, "delete").otherwise("index")
    return changes(current, manifest).select("file_path", action.alias("action"))


def upsert(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "file_path", "left_anti").select("file_path", "mtime").unionByName(files.select("file_path", "mtime"))


def remove(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "file_path", "left_anti").select("file_path", "mtime")


def tracked(manifest: DataFrame) -> DataFrame:
    return manifest.select("file_path")

"""Source trees as tables of files."""

from __future__ import annotations

import contextlib
import os
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ignore import expand_gitignore, kept, shut

FILES = "file_path string, mtime double"
GIT_SECONDS = 10
#: Bytes of file contents that a task holds before it hands them on.
HELD_BYTES = 16 << 20


def is_git(root: str) -> bool:
    return (Path(root) / ".git").is_dir()


def git_paths(root: str, extensions: Sequence[str]) -> list[str] | None:
    """Tracked files below ``root`` that exist; None where listing fails."""
    try:
        done = subprocess.run(["git", "ls-files", "-z", *(f"*{e}" for e in extensions)], cwd=root, capture_output=True, timeout=GIT_SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    if done.returncode:
        return None
    names = done.stdout.decode("utf-8", "surrogateescape").split("\0")
    return [str(Path(root) / n) for n in names if n and (Path(root) / n).is_file()]


def _folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each folder; names that cannot be read are left out."""
    for batch in batches:
        rows = []
        for folder in batch["folder"]:
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        try:
                            below = e.is_dir(follow_symlinks=False)
                            if below or e.is_file():
                                rows.append((e.path, below, None if below else e.stat().st_mtime))
                        except OSError:
                            continue
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["file_path", "is_folder", "mtime"]).astype({"is_folder": bool, "mtime": float})


def walk(spark: SparkSession, root: str, extensions: Sequence[str], ignore: Sequence[str] = (), use_gitignore: bool = True) -> DataFrame:
    """Every file below ``root``, a path that all executors see, that no rule excludes: file_path, mtime.

    Folders are listed in tasks, level by level, and those that a rule excludes are never entered.
    """
    patterns = list(ignore)
    if use_gitignore:
        patterns += gitignore(root)
    root = str(Path(root).resolve())
    rel = F.expr(f"substring(file_path, {len(root.rstrip('/')) + 2})")
    level, found = spark.createDataFrame([(root,)], "folder string"), spark.createDataFrame([], FILES)
    while True:
        below = level.mapInPandas(_folders, "file_path string, is_folder boolean, mtime double").withColumn("rel_path", rel).persist()
        found = found.union(kept(below.where("not is_folder"), extensions, patterns).select("file_path", "mtime"))
        folders = below.where("is_folder").where(~shut(F.col("rel_path"), patterns)).select(F.col("file_path").alias("folder"))
        n = folders.count()
        if not n:
            return found
        level = folders.repartition(min(n, spark.sparkContext.defaultParallelism))


def gitignore(root: str) -> list[str]:
    try:
        return expand_gitignore((Path(root) / ".gitignore").read_text(encoding="utf-8", errors="replace").splitlines())
    except OSError:
        return []


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["file_path"]:
            with contextlib.suppress(OSError):
                rows.append((path, os.stat(path).st_mtime))
        yield pd.DataFrame(rows, columns=["file_path", "mtime"]).astype({"mtime": float})


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, held = [], 0
        for path, mtime in zip(batch["file_path"], batch["mtime"], strict=True):
            try:
                raw = Path(path).read_bytes()
            except OSError:
                continue
            rows.append((path, mtime, raw))
            held += len(raw)
            if held >= HELD_BYTES:
                yield pd.DataFrame(rows, columns=["file_path", "mtime", "raw"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["file_path", "mtime", "raw"])


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The named files, whatever characters their names hold: file_path, mtime."""
    if not paths:
        return spark.createDataFrame([], FILES)
    return spark.createDataFrame([(p,) for p in paths], "file_path string").mapInPandas(_stats, FILES)


def scan(spark: SparkSession, root: str, extensions: Sequence[str], ignore: Sequence[str] = (), use_gitignore: bool = True) -> DataFrame:
    """The tree's files, without their contents: as git lists them in a repository, else by walking with the ignore rules."""
    root = str(Path(root).resolve())
    if is_git(root) and (paths := git_paths(root, extensions)) is not None:
        return listed(spark, paths)
    return walk(spark, root, extensions, ignore, use_gitignore)


def texts(files: DataFrame) -> DataFrame:
    """file_path, mtime, content of ``files``; content is null where the bytes are no UTF-8.

    Bytes come from a column ``raw`` if there is one, else from the files that are named; those that are gone are left out.
    """
    read = files if "raw" in files.columns else files.select("file_path", "mtime").mapInPandas(_contents, "file_path string, mtime double, raw binary")
    return read.select("file_path", "mtime", F.try_validate_utf8(F.col("raw").cast("string")).alias("content"))


def readable(files: DataFrame) -> DataFrame:
    return texts(files).where(F.col("content").isNotNull())


def quarantined(files: DataFrame) -> DataFrame:
    return texts(files).where(F.col("content").isNull()).select("file_path", "mtime")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, mtime) of a JSON file {path: mtime}; missing or broken files are empty."""
    schema = "file_path string, mtime double"
    try:
        raw = spark.read.text(path, wholetext=True)
        parsed = raw.select(F.explode(F.from_json("value", "map<string,double>")).alias("file_path", "mtime"))
        parsed.limit(1).count()
        return parsed
    except Exception as e:  # noqa: BLE001  a path that is not there is an empty manifest, whatever the file system says
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)

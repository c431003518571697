"""File listing, ignore rules, manifests, settings."""

import fnmatch
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.operators import manifest as m
from quarry.sources import files, ignore
from quarry.sources.settings import Settings, index_path, project_hash


@pytest.fixture
def tree(tmp_path):
    for name in ("a.py", "sub/b.rs", "sub/c.md", "d.json", ".venv/e.py", "__pycache__/f.py", "skip/g.py", "h.generated.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# c\n\nskip/\n*.generated.py\n")
    return tmp_path


EXT = [".py", ".rs", ".md"]


def _names(df, root):
    return sorted(os.path.relpath(r.file_path, root) for r in df.collect())


def test_walk(spark, tree):
    assert _names(files.scan(spark, str(tree), EXT), tree) == ["a.py", "sub/b.rs", "sub/c.md"]
    assert "skip/g.py" in _names(files.scan(spark, str(tree), EXT, use_gitignore=False), tree)


def test_git_listing(spark, tree):
    run = lambda *a: subprocess.run(["git", *a], cwd=tree, check=True, capture_output=True)
    run("init", "-q")
    run("add", "-f", "a.py", "skip/g.py", "sub/c.md")
    (tree / "sub/c.md").unlink()
    assert _names(files.scan(spark, str(tree), EXT), tree) == ["a.py", "skip/g.py"]


ODD_NAMES = ["__init__.py", "_pkg/c.py", "_x.py", "b[1].py", "q?{a,b}*.py", "a b%20+é.py"]


@pytest.mark.parametrize("git", [False, True])
def test_names_that_readers_take_for_hidden_or_for_patterns(spark, tmp_path, git):
    for name in [*ODD_NAMES, "node_modules/deep/x.py", "build/y.py"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    if git:
        subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True, capture_output=True)
        subprocess.run(["git", "add", "-f", "--", *ODD_NAMES], cwd=tmp_path, check=True, capture_output=True)
    found = files.scan(spark, str(tmp_path), EXT, ["build"])
    assert _names(found, tmp_path) == sorted(ODD_NAMES)
    assert {os.path.relpath(r.file_path, tmp_path): r.content for r in files.readable(found).collect()} == {n: f"# {n}\n" for n in ODD_NAMES}


def test_bad_bytes_are_quarantined(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"\xff\xfe")
    (tmp_path / "b.py").write_bytes("é\r\n".encode())
    found = files.scan(spark, str(tmp_path), EXT)
    assert _names(files.readable(found), tmp_path) == ["b.py"] and _names(files.quarantined(found), tmp_path) == ["a.py"]


def test_both_forms_of_ignore_rules_agree(spark):
    lines = ["a", " b/ ", "\tc\t", "d\r", "#e", "", " \t\r", "f g", "\x1ch\x85"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.e for r in df.select("i", ignore.expanded(F.col("line")).alias("e")).collect()}
    assert [got[i] for i in range(len(lines))] == [ignore.expand_gitignore([x]) for x in lines]


def test_ignore_agrees_with_fnmatch(spark):
    patterns = ["build/**", "build", "*.pyc", "**/*.log", "d[ab]c", "x?z", "a.b"]
    paths = ["build/x/y.py", "src/build/x.py", "a.pyc", "q/r.log", "dac", "dcc/f", "xyz/a.py", "a.b/c", "axb", "new\nline.pyc"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.i for r in df.select("p", ignore.ignored(F.col("p"), patterns).alias("i")).collect()}
    for p in paths:
        parts = p.split("/")
        assert got[p] == any(fnmatch.fnmatchcase("/".join(parts[:k]), q) for k in range(1, len(parts) + 1) for q in patterns), p


def test_manifest(spark, tmp_path):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "file_path string, mtime double")
    then = spark.createDataFrame([("b", 5.0), ("c", 3.0), ("d", 1.0)], "file_path string, mtime double")
    assert {tuple(r) for r in m.changes(now, then).collect()} == {("a", "new"), ("b", "modified"), ("d", "deleted")}
    assert {r[0] for r in m.upsert(then, now).collect()} == {"a", "b", "c", "d"}
    assert not m.has_changes(now, now).first().has_changes
    empty = now.limit(0)
    assert m.changes(empty, empty).count() == 0 and m.changes(now, empty).count() == 3
    assert files.load_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert files.load_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "ok.json").write_text('{"a": 1.5}')
    assert [tuple(r) for r in files.load_manifest(spark, str(tmp_path / "ok.json")).collect()] == [("a", 1.5)]


def test_settings(spark, tmp_path):
    s = Settings.from_env({"QUARRY_LOCAL_INDEX": "true", "QUARRY_IGNORE_PATTERNS": "a,b", "QUARRY_UNKNOWN": "x"})
    assert s.local_index and s.ignore_patterns == ("a", "b") and s.use_gitignore
    assert index_path(str(tmp_path), s) == str(tmp_path / ".quarry")
    other = index_path(str(tmp_path), Settings(cache_dir=str(tmp_path / "cache")))
    want = spark.range(1).select(project_hash(F.lit(str(tmp_path.resolve())))).first()[0]
    assert os.path.basename(other) == want and len(want) == 16

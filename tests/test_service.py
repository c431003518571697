"""Index, search and status of a small project, end to end."""

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.embed import HashingProvider, embedded
from quarry.functions.vectors import hashed
from quarry.operators.chunks import default_registry
from quarry.operators.store import Store
from quarry.plans import observe
from quarry.plans.service import MissingPath, SearchEngine
from quarry.sources.settings import Settings
from quarry.streaming.ingest import ingest


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "main.py").write_text('"""Main module."""\n\n\ndef read_config():\n    return 1\n\n\ndef run():\n    return read_config()\n')
    (root / "utils.py").write_text('"""Utilities."""\n\n\nclass Cache:\n    def get(self, key):\n        return key\n')
    return root


def _engine(spark, project, tmp_path):
    return SearchEngine(spark, str(project), Settings(), index=str(tmp_path / "index"))


def test_life_cycle(spark, project, tmp_path):
    engine = _engine(spark, project, tmp_path)
    assert not engine.status().is_indexed
    found = engine.search("read_config", limit=3, now=time.time())
    assert found.index_result.files_indexed == 2 and found.index_result.chunks_indexed == 6
    rows = found.results.collect()
    assert rows and rows[0].name in ("read_config", "run") and all(0 <= r.score <= 1 for r in rows)
    assert engine.index().files_indexed == 0
    state = engine.status()
    assert (state.files_count, state.chunks_count, state.stale_files) == (2, 6, [])
    # an edit, a new file and a deletion
    (project / "main.py").write_text("def other():\n    return 2\n")
    os.utime(project / "main.py", (time.time() + 5, time.time() + 5))
    (project / "new.md").write_text("# Notes\n\ntext\n")
    (project / "utils.py").unlink()
    assert [os.path.basename(p) for p in engine.status().stale_files] == ["main.py", "new.md"]
    done = engine.index()
    assert (done.files_indexed, done.files_deleted, done.chunks_indexed) == (2, 1, 2)
    assert {r.name for r in engine.store.chunks.select("name").collect()} == {"other", "Notes"}
    forced = engine.index(force=True)
    assert forced.files_indexed == 2 and engine.status().chunks_count == 2
    assert engine.search("zzz", limit=0).results.count() == 0
    near = engine.find_similar(engine.store.chunks.first().chunk_id, 5)
    assert near.count() == 1
    engine.store.clear()
    assert engine.status().chunks_count == 0


def test_response_logs_and_profiles(spark, project, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    calls, said = [], io.StringIO()
    engine = SearchEngine(spark, str(project), Settings(profile=True), index=str(tmp_path / "index"))
    before = observe.HANDLER.setStream(said)
    got = json.loads(engine.respond("read_config", 2, progress=lambda done, of, what: calls.append((done, of, what))))
    debug = got["debug"]
    assert debug["index_status"] == {"files_count": 2, "chunks_count": 6, "was_stale": True}
    assert debug["index_result"] == {"files_indexed": 2, "chunks_indexed": 6} and debug["timings"]["indexing_ms"] > 0
    assert got["results"][0]["name"] in ("read_config", "run") and debug["stats"]["results_count"] == len(got["results"])
    assert calls[0][0] < calls[-1][0] == calls[-1][1] == 100
    again = json.loads(engine.respond("read_config", 2))["debug"]
    assert again["index_status"]["was_stale"] is False and again["timings"]["indexing_ms"] is None
    assert engine.status().response()["files_count"] == 2 and engine.index().files_indexed == 0
    assert {p.name.split("-")[0] for p in (tmp_path / "profiles").iterdir()} == {"index", "search"}
    observe.HANDLER.setStream(before)
    events = [json.loads(x)["event"] for x in said.getvalue().splitlines()]
    assert events == ["index_started", "index_finished", "search_finished", "search_finished", "index_started", "index_finished"]


def test_missing_path(spark, tmp_path):
    with pytest.raises(MissingPath):
        SearchEngine(spark, str(tmp_path / "none"))


def test_provider_agrees_with_sql(spark):
    df = spark.createDataFrame([(1, "Some words, some more_words É"), (2, "")], "id int, text string")
    dense = {r.id: r.v for r in df.select("id", embedded(F.col("text"), HashingProvider()).alias("v")).collect()}
    for r in hashed(df, "id", "text").collect():
        assert dense[r.id][r.bucket] == pytest.approx(r.w, abs=1e-6)
    assert len(dense[1]) == 384 and not any(dense[2])


def test_streaming_upsert(spark, tmp_path):
    source = tmp_path / "in"
    schema = "file_path string, mtime double, content string"
    store = Store(spark, str(tmp_path / "store"))
    for mtime, content in ((1.0, "# A\nx"), (2.0, "# B\ny\n# C\nz")):
        spark.createDataFrame([("n.md", mtime, content)], schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        ingest(stream, store, default_registry(), HashingProvider(), str(tmp_path / "cp")).awaitTermination()
    assert {r.name for r in store.chunks.collect()} == {"B", "C"} and store.manifest.first().mtime == 2.0

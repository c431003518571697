"""The engine's three calls: index a tree, search it, tell its state."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.functions.embed import EmbeddingProvider, HashingProvider, embedded
from quarry.operators import fts, ranking, store
from quarry.operators import manifest as m
from quarry.operators.chunks import Registry, default_registry, valid
from quarry.plans import observe, response
from quarry.session import ship
from quarry.sources import files as sources
from quarry.sources.settings import Settings, index_path

Progress = Callable[[float, float, str], None]
PAYLOAD = ("line_end", "content", "chunk_type", "name")


class MissingPath(FileNotFoundError):
    """The project's path does not exist."""


@dataclass(frozen=True)
class IndexResult:
    files_indexed: int = 0
    chunks_indexed: int = 0
    files_deleted: int = 0
    duration_seconds: float = 0.0


@dataclass(frozen=True)
class IndexStatus:
    is_indexed: bool
    last_updated: datetime | None
    files_count: int
    chunks_count: int
    stale_files: list[str] = field(default_factory=list)

    def response(self) -> dict:
        """Without the stale files' names."""
        return {"is_indexed": self.is_indexed, "last_updated": self.last_updated and self.last_updated.isoformat(), "files_count": self.files_count, "chunks_count": self.chunks_count}


@dataclass(frozen=True)
class SearchOutcome:
    results: DataFrame
    raw_count: int
    filtered_count: int
    index_result: IndexResult
    embedding_ms: float
    search_ms: float
    total_ms: float


class SearchEngine:
    def __init__(self, spark: SparkSession, project: str, settings: Settings | None = None, index: str | None = None, provider: EmbeddingProvider | None = None, registry: Registry | None = None):
        self.spark, self.project = ship(spark), project
        if not Path(project).exists():
            raise MissingPath(project)
        self.settings = settings or Settings()
        self.log = observe.logger(self.settings.debug)
        self.provider = provider or HashingProvider()
        self.registry = registry or default_registry()
        self.store = store.Store(spark, index or index_path(project, self.settings))

    def files(self) -> DataFrame:
        return sources.scan(self.spark, self.project, self.registry.extensions, self.settings.ignore_patterns, self.settings.use_gitignore)

    def index(self, force: bool = False, progress: Progress | None = None) -> IndexResult:
        """Bring the store up to date with the tree: one commit of chunks, manifest and keyword index."""
        observe.say(self.log, "index_started", project=self.project, force=force)
        with observe.profiled("index", self.settings.profile):
            done = self._index(force, progress)
        observe.say(self.log, "index_finished", **asdict(done))
        return done

    def _index(self, force: bool, progress: Progress | None) -> IndexResult:
        began, tell = time.perf_counter(), progress or (lambda *_: None)
        tell(5, 100, "scanning files")
        files = self.files()
        current = files.select("file_path", "mtime").persist()
        tell(10, 100, "detecting changes")
        old = self.spark.createDataFrame([], store.MANIFEST) if force else self.store.manifest
        plan = m.scan_plan(current, old, force).persist()
        try:
            counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
            if not counts and not force:
                tell(100, 100, "up to date")
                return IndexResult(duration_seconds=round(time.perf_counter() - began, 3))
            todo = plan.where(F.col("action") == "index").select("file_path")
            tell(20, 100, "chunking")
            read = sources.readable(files.join(todo, "file_path", "left_semi"))
            chunks = valid(self.registry.chunk(read.select("file_path", "content")))
            tell(70, 100, "embedding")
            identity = F.substring(F.sha2(F.concat_ws(":", "file_path", "line_start", "line_end", "chunk_type", "name"), 256), 1, 32)
            new = chunks.select(identity.alias("chunk_id"), *chunks.columns, embedded(F.col("content"), self.provider).alias("vector"))
            new = new.persist()
            kept = self.spark.createDataFrame([], store.CHUNKS) if force else self.store.chunks
            gone = plan.where(F.col("action") == "delete").select("file_path")
            manifest = m.upsert(m.remove(old, gone), read.select("file_path", "mtime"))
            self.store.commit(store.replace_by_file(kept, new, plan.select("file_path")), manifest, self.provider.dimension)
            n = new.count()
            new.unpersist()
            tell(100, 100, "done")
            return IndexResult(counts.get("index", 0), n, counts.get("delete", 0), round(time.perf_counter() - began, 3))
        finally:
            plan.unpersist()
            current.unpersist()

    def status(self) -> IndexStatus:
        current = self.files().select("file_path", "mtime")
        row = store.stats(self.store.chunks).first()
        stale = [r[0] for r in m.stale_files(current, self.store.manifest).select("file_path").collect()]
        at = self.store.committed_at()
        return IndexStatus(row["files_count"] > 0, datetime.fromtimestamp(at, UTC) if at else None, row["files_count"], row["chunks_count"], sorted(stale))

    def search(self, query: str, limit: int = 10, min_score: float = ranking.MIN_SCORE, vector_weight: float = 0.5, now: float | None = None, progress: Progress | None = None, file_pattern: str | None = None, include_deleted: bool = True) -> SearchOutcome:
        """Ranked chunks; the tree is indexed first where it is new or stale.

        ``file_pattern`` (a regular expression over paths) and ``include_deleted=False`` are extensions.
        """
        if limit < 0:
            raise ValueError("limit must be at least 0")
        with observe.profiled("search", self.settings.profile):
            found = self._search(query, limit, min_score, vector_weight, now, progress, file_pattern, include_deleted)
        observe.say(self.log, "search_finished", query=query, raw=found.raw_count, filtered=found.filtered_count, total_ms=found.total_ms)
        return found

    def _search(self, query: str, limit: int, min_score: float, vector_weight: float, now: float | None, progress: Progress | None, file_pattern: str | None, include_deleted: bool) -> SearchOutcome:
        began, tell = time.perf_counter(), progress or (lambda *_: None)
        tell(5, 100, "checking the index")
        state = self.status()
        indexed = IndexResult()
        if not state.is_indexed or state.stale_files:
            tell(10, 100, "indexing")
            indexed = self.index()
        tell(85, 100, "searching")
        t = time.perf_counter()
        vector = self.provider.embed_text(query)
        embedding_ms = (time.perf_counter() - t) * 1000
        t = time.perf_counter()
        files = self.files().select("file_path", "mtime")
        chunks = self.store.chunks
        if file_pattern:
            chunks = chunks.where(F.col("file_path").rlike(file_pattern))
        if not include_deleted:
            chunks = chunks.join(files, "file_path", "left_semi")
        take = ranking.OVERFETCH * limit
        by_vector = self._vector_leg(chunks, vector, take)
        by_keyword = self._keyword_leg(chunks, query, take)
        fused = ranking.hybrid(by_vector, by_keyword, take, vector_weight, PAYLOAD).persist()
        passed = ranking.above(fused, min_score)
        results = ranking.by_file(ranking.boosted_top(ranking.recency(passed, files, now if now is not None else time.time()), limit)).orderBy("place").persist()
        raw, left = fused.count(), passed.count()
        results.count()
        end = time.perf_counter()
        tell(100, 100, "done")
        return SearchOutcome(results, raw, raw - left, indexed, round(embedding_ms, 1), round((end - t) * 1000, 1), round((end - began) * 1000, 1))

    def respond(self, query: str, limit: int = 10, **options) -> str:
        """The full answer to a search as JSON; ``options`` as for ``search``."""
        began = time.perf_counter()
        found = self.search(query, limit, **options)
        counts = store.stats(self.store.chunks).first()
        run = found.index_result
        times = {"embedding_ms": found.embedding_ms, "search_ms": found.search_ms, "total_ms": (time.perf_counter() - began) * 1000, "indexing_ms": run.duration_seconds * 1000 if run.files_indexed else 0.0}
        return response.search_response(found.results, found.filtered_count, times, run.files_indexed, run.chunks_indexed, counts["files_count"], counts["chunks_count"]).first()["response"]

    def find_similar(self, chunk_id: str, limit: int = 10) -> DataFrame:
        """Extension: the chunks nearest to a stored one."""
        row = self.store.chunks.where(F.col("chunk_id") == chunk_id).select("vector").first()
        if row is None:
            raise KeyError(chunk_id)
        return self._vector_leg(self.store.chunks.where(F.col("chunk_id") != chunk_id), list(row["vector"]), limit)

    def _vector_leg(self, chunks: DataFrame, vector: list[float], limit: int) -> DataFrame:
        asked = F.lit(",".join(map(repr, vector)))
        score = vectors.cosine_score(F.col("vector"), F.split(asked, ",").cast("array<double>"))
        scored = chunks.select("chunk_id", "file_path", "line_start", score.alias("score"))
        return self._with_payload(chunks, ranking.top(scored, limit, F.desc("score"), "file_path", "line_start", "chunk_id"))

    def _keyword_leg(self, chunks: DataFrame, query: str, limit: int) -> DataFrame:
        raw = fts.bm25_indexed(self.store.postings, self.store.lengths, query)
        scored = chunks.select("chunk_id", "file_path", "line_start").join(raw, "chunk_id").withColumn("score", fts.keyword_score("raw"))
        return self._with_payload(chunks, ranking.top(scored, limit, F.desc("score"), F.desc("raw"), "file_path", "line_start", "chunk_id"))

    @staticmethod
    def _with_payload(chunks: DataFrame, best: DataFrame) -> DataFrame:
        """The ranked chunks, at most the limit, with their contents."""
        ranked = F.broadcast(best.select("chunk_id", "file_path", "line_start", "score", "rank"))
        return chunks.select("chunk_id", *PAYLOAD).join(ranked, "chunk_id").select("file_path", "line_start", *PAYLOAD, "score", "rank")

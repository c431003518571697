"""What a caller gets: truncated contents, rounded scores, counts, and the whole as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import rounded, truncated

SCORE_DIGITS = 3


def result_stats(results: DataFrame, filtered_out: int = 0) -> DataFrame:
    """One row: results_count, filtered_out, unique_files, tokens_estimate (of the untruncated contents)."""
    chars = F.coalesce(F.sum(F.length("content")), F.lit(0)) + F.count("*") - 1
    return results.agg(F.count("*").alias("results_count"), F.lit(filtered_out).cast("long").alias("filtered_out"), F.count_distinct("file_path").alias("unique_files"), F.greatest(F.lit(0), F.floor(chars / 4)).cast("long").alias("tokens_estimate"))


def formatted(results: DataFrame) -> DataFrame:
    """``results`` with content cut to a page, a flag for it, and the score rounded."""
    text, cut = truncated(F.col("content"))
    return results.withColumns({"truncated": cut, "content": text, "score": rounded(F.col("score"), SCORE_DIGITS)})


def search_response(results: DataFrame, filtered_out: int = 0, timings: dict[str, float] | None = None, files_indexed: int = 0, chunks_indexed: int = 0, files_count: int = 0, chunks_count: int = 0) -> DataFrame:
    """One row, ``response``: the JSON of results in order and, under ``debug``, of timings, stats, index state and index run."""
    shown = formatted(results)
    columns = ["file_path", "line_start", "line_end", "content", "truncated", "chunk_type", "name", "score"]
    item = F.struct(F.col("place").alias("place"), *[F.col(c) for c in columns if c in shown.columns])
    listed = shown.agg(F.array_sort(F.collect_list(item)).alias("results"))  # as many as the limit allows
    times = timings or {}
    clock = F.struct(*[F.lit(round(times.get(k, 0.0), 1)).alias(k) for k in ("embedding_ms", "search_ms", "total_ms")], F.lit(round(times["indexing_ms"], 1) if times.get("indexing_ms") else None).cast("double").alias("indexing_ms"))
    state = F.struct(F.lit(files_count).alias("files_count"), F.lit(chunks_count).alias("chunks_count"), F.lit(files_indexed > 0).alias("was_stale"))
    run = F.struct(F.lit(files_indexed).alias("files_indexed"), F.lit(chunks_indexed).alias("chunks_indexed"))
    whole = listed.crossJoin(result_stats(results, filtered_out).select(F.struct("*").alias("stats")))  # one row each
    debug = F.struct(clock.alias("timings"), "stats", state.alias("index_status"), run.alias("index_result"))
    return whole.select(F.to_json(F.struct("results", debug.alias("debug")), {"ignoreNullFields": "false"}).alias("response"))

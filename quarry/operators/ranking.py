"""Search legs and what follows them: fusion, threshold, recency, cuts, grouping by file.

A leg is a ranked result: the chunk's columns with ``score`` and ``rank`` (from 1). All orders are total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

MIN_SCORE = 0.3
OVERFETCH = 2
BOOST, BOOST_SECONDS = 0.05, 604800


def _whole(*order: Column | str) -> WindowSpec:
    """Over all rows, for what is already cut to a limit."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def top(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows in ``order``, with their ``rank``; only these rows meet in one task."""
    if limit < 0:
        raise ValueError("limit must be at least 0")
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(_whole(*order)))


def merge(vector: DataFrame, keyword: DataFrame, weight: float = 0.5, payload: Sequence[str] = ()) -> DataFrame:
    """Weighted fusion of two legs by (file_path, line_start): score, position and the payload.

    Of equal keys in the vector leg the last counts, at the place of the first; equal keys in the keyword
    leg add up; the sum is at most 1. The payload is the last vector hit's, else the first keyword hit's.
    """
    keep = ["file_path", "line_start", *payload]
    pick = F.struct(*payload) if payload else F.struct(F.lit(1).alias("one"))
    tagged = vector.select(*keep, "rank", F.lit(0).alias("leg"), (weight * F.col("score")).alias("part")).unionByName(keyword.select(*keep, "rank", F.lit(1).alias("leg"), ((1 - weight) * F.col("score")).alias("part")))
    first, second = F.col("leg") == 0, F.col("leg") == 1
    fused = tagged.groupBy("file_path", "line_start").agg(
        F.max_by(F.when(first, F.col("part")), F.when(first, F.col("rank"))).alias("v"),
        F.sum(F.when(second, F.col("part"))).alias("k"),
        F.coalesce(F.max_by(F.when(first, pick), F.when(first, F.col("rank"))), F.min_by(F.when(second, pick), F.when(second, F.col("rank")))).alias("p"),
        F.min(F.struct("leg", "rank")).alias("position"),
    )
    score = F.least(F.lit(1.0), F.coalesce("v", F.lit(0.0)) + F.coalesce("k", F.lit(0.0)))
    return fused.select("file_path", "line_start", *[F.col(f"p.{c}").alias(c) for c in payload], score.alias("score"), "position")


def hybrid(vector: DataFrame, keyword: DataFrame, limit: int, weight: float = 0.5, payload: Sequence[str] = ()) -> DataFrame:
    """Fused legs, best first, cut to ``limit``."""
    ranked = top(merge(vector, keyword, weight, payload), limit, F.desc("score"), F.col("position"))
    return ranked.drop("position")


def above(df: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    return df.where(F.col("score") >= least)


def boosted(score: Column, mtime: Column, now: float) -> Column:
    """Score with up to BOOST for files edited within a week; a missing time or file gets none."""
    age = F.greatest(F.lit(float(now)) - mtime, F.lit(0.0))
    boost = F.when(age < BOOST_SECONDS, BOOST * (1 - age / BOOST_SECONDS)).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.coalesce(boost, F.lit(0.0)))


def recency(df: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """``df`` with ``boosted``, by the files' (file_path, mtime)."""
    times = files.select("file_path", F.col("mtime").alias("__mtime"))
    return df.join(times, "file_path", "left").withColumn("boosted", boosted(F.col("score"), F.col("__mtime"), now)).drop("__mtime")


def boosted_top(df: DataFrame, limit: int) -> DataFrame:
    """The best by boosted score, ties in the former order; the boost itself is dropped."""
    former = df.withColumnRenamed("rank", "former")
    return top(former, limit, F.desc("boosted"), F.col("former")).drop("boosted", "former")


def by_file(df: DataFrame) -> DataFrame:
    """Final order: files by their best unboosted score, then first appearance; within a file as ranked."""
    file = Window.partitionBy("file_path")
    best = df.withColumns({"__best": F.max("score").over(file), "__first": F.min("rank").over(file)})
    order = (F.desc("__best"), F.col("__first"), F.col("rank"))
    return best.withColumn("place", F.row_number().over(_whole(*order))).drop("__best", "__first")


def pipeline(vector: DataFrame, keyword: DataFrame, files: DataFrame, limit: int, now: float, weight: float = 0.5, min_score: float = MIN_SCORE, payload: Sequence[str] = ()) -> DataFrame:
    """Fusion, threshold, recency, cut and grouping: the whole search behind its two legs."""
    fused = hybrid(vector, keyword, OVERFETCH * limit, weight, payload)
    return by_file(boosted_top(recency(above(fused, min_score), files, now), limit))

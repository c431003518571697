"""Vectors: cosine scores of dense ones, signed feature hashing into sparse ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import terms

DIMENSION = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score_of_distance(distance: Column) -> Column:
    """Cosine distance in [0, 2] to a score in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def cosine_score(a: Column, b: Column) -> Column:
    """Score of two dense vectors; 0 where either has no direction."""
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(cosine.isNull() | F.isnan(cosine), F.lit(0.0)).otherwise(score_of_distance(1 - cosine))


def bucket(term: Column, dimension: int = DIMENSION) -> Column:
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % dimension


def sign(term: Column) -> Column:
    return 1 - 2 * (F.conv(F.substring(F.md5(term.cast("binary")), 9, 2), 16, 10).cast("int") % 2)


def hashed(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """Sparse L2-normalised vectors (key, bucket, w) of signed term frequencies.

    At most ``dimension`` rows of a document leave the map side; a text without words has no rows.
    """
    words = df.select(key, F.explode(terms(F.col(text))).alias("term"))
    summed = words.groupBy(key, bucket(F.col("term"), dimension).alias("bucket")).agg(F.sum(sign(F.col("term"))).alias("v")).where("v <> 0")
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("v").cast("double") * F.col("v"))).alias("norm"))
    return summed.join(norms, key).select(key, "bucket", (F.col("v") / F.col("norm")).alias("w"))


def hashed_scores(df: DataFrame, query: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, score) of every text with words against the one text of ``query`` (bucket, w).

    Norm and inner product come from the same aggregation, so a document is shuffled once.
    """
    words = df.select(key, F.explode(terms(F.col(text))).alias("term"))
    summed = words.groupBy(key, bucket(F.col("term"), dimension).alias("bucket")).agg(F.sum(sign(F.col("term"))).alias("v"))
    both = summed.join(F.broadcast(query), "bucket", "left")  # at most ``dimension`` rows
    sums = both.groupBy(key).agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("n"), F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("d"))
    return sums.where("n > 0").select(key, score_of_distance(1 - F.col("d") / F.sqrt("n")).alias("score"))

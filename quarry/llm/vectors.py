"""Embeddings as matrices: validity, packing, blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of vectors; with the dimension it bounds what a task holds.
BLOCK_ROWS = 2048


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def prepare(df: DataFrame, vec_id: str, vector: str, *more: str) -> DataFrame:
    """vec_id long and vector array<double> of the usable rows, with further columns."""
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"), *more).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())


def matrix(series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in series]) if len(series) else np.zeros((0, 1))


def by_length(batch):
    """The batch's rows grouped by the length of their vectors: vectors of unlike lengths never meet."""
    return batch.groupby(batch["vector"].map(len), sort=True)

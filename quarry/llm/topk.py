"""Exact top-k search by a three-phase uniform threshold.

The components of a vector are dealt to m slices; the local score of a row in a slice is the inner
product over that slice, and its score the sum over the slices.

1. Gather: each block of rows sends, for each query and slice, its k best local scores with the full
   scores of those rows. The k-th best full score among distinct rows is a safe cutoff t: at least k
   rows reach it.
2. Threshold: t goes back to the blocks. A row whose local scores all lie below t / m totals below t,
   so only rows with a local score of at least t / m are sufficient entries.
3. Resolve: the sufficient entries' scores are completed exactly and those of at least t go on to be
   ranked, ties to the smaller id.

Queries are taken in groups of at most GROUP_QUERIES, each one broadcast of bounded size (a stated
query set against all rows, in blocks); rows are never moved but as results. The local scores of a pair of blocks are
products of matrices either way, so the threshold bounds what is sent and ranked, not the arithmetic. Components become
floor(scale * x). Scores are exact integers: blocks whose sums stay below 2**53 are multiplied in float64, others below 2**63 in
int64, and any others as Python integers; a score that does not fit a long raises OverflowError.

Defined results: null vectors and those with null or non-finite components neither ask nor answer;
vectors are compared only with those of the same length; a query's own row (by id) is no candidate;
repeated ids are separate rows, each a candidate, of which the result may hold several, and ask once, with
the smallest of their vectors; no queries or
candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import BLOCK_ROWS, by_length, matrix, prepare

SLICES = 4
#: Queries of one pass over the rows; bounds the broadcast to this many vectors.
GROUP_QUERIES = 8192
#: Queries scored at once within a task.
QUERY_BLOCK = 256
_LEAST = np.iinfo(np.int64).min


def _local(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(slices, queries, rows) of local scores, as exact integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    exact = (lambda x: x) if bound < 2**53 else (lambda x: x.astype(np.int64)) if bound < 2**62 else (lambda x: np.array([[int(v) for v in r] for r in x], object))
    parts = np.array_split(np.arange(rows.shape[1]), min(SLICES, rows.shape[1]))
    local = [exact(queries[:, p]) @ exact(rows[:, p]).T for p in parts]
    if bound >= 2**62 and abs(sum(np.abs(x) for x in local)).max(initial=0) >= 2**63:
        raise OverflowError("an inner product does not fit a long")
    return np.stack([x.astype(np.int64) for x in local])


def _pairs(batches: Iterator[pd.DataFrame], queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Query ids, cutoffs, row ids, local scores and which are candidates (not a query's own row), of each pair of blocks."""
    for batch in batches:
        for dim, part in by_length(batch):
            if dim not in queries:
                continue
            q_ids, q, cutoff = queries[dim]
            for lo in range(0, len(part), BLOCK_ROWS):
                ids = part["vec_id"].to_numpy()[lo : lo + BLOCK_ROWS]
                rows = matrix(part["vector"].iloc[lo : lo + BLOCK_ROWS])
                for a in range(0, len(q_ids), QUERY_BLOCK):
                    of = slice(a, a + QUERY_BLOCK)
                    yield q_ids[of], cutoff[of], ids, _local(q[of], rows), q_ids[of, None] != ids


def search(df: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best rows of ``df`` for each row of ``queries``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    whole = lambda x: F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    rows = prepare(df, vec_id, vector).withColumn("vector", whole(F.col("vector")))
    asked = cut(prepare(queries, vec_id, vector).withColumn("vector", whole(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    schema = "query_id long, vec_id long, score long"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = []
    last = None
    while True:
        group = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(GROUP_QUERIES).toArrow().to_pandas()
        if group.empty:
            break
        last = int(group["vec_id"].iloc[-1])
        blocks = {dim: (part["vec_id"].to_numpy(), matrix(part["vector"]), np.full(len(part), _LEAST)) for dim, part in by_length(group)}
        first = spark.sparkContext.broadcast(blocks)

        def gather(batches: Iterator[pd.DataFrame], first=first) -> Iterator[pd.DataFrame]:
            for q_ids, _, ids, local, candidate in _pairs(batches, first.value):
                keep = min(k, len(ids))
                ranked = np.where(candidate, local, _LEAST)
                best = np.concatenate(np.argpartition(ranked, len(ids) - keep, axis=2)[:, :, len(ids) - keep :], axis=1)
                best = np.sort(best, axis=1)
                new = np.c_[np.ones((len(best), 1), bool), best[:, 1:] != best[:, :-1]] & np.take_along_axis(candidate, best, axis=1)
                q, at = np.nonzero(new)
                row = best[q, at]
                yield pd.DataFrame({"query_id": q_ids[q], "vec_id": ids[row], "score": local[:, q, row].sum(axis=0)})

        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        seen = rows.mapInPandas(gather, schema)
        safe = seen.withColumn("n", F.row_number().over(top)).where(F.col("n") == k).select("query_id", "score").toArrow().to_pandas()  # one a query of the group
        cutoff = dict(zip(safe["query_id"], safe["score"], strict=True))
        second = spark.sparkContext.broadcast({dim: (ids, m, np.array([cutoff.get(i, _LEAST) for i in ids], np.int64)) for dim, (ids, m, _) in blocks.items()})

        def resolve(batches: Iterator[pd.DataFrame], second=second) -> Iterator[pd.DataFrame]:
            for q_ids, least, ids, local, candidate in _pairs(batches, second.value):
                share = least // len(local)  # rounded down: what lies below it in every slice totals less than the cutoff
                q, at = np.nonzero((local >= share[:, None]).any(axis=0) & candidate)
                total = local[:, q, at].sum(axis=0)
                enough = total >= least[q]
                yield pd.DataFrame({"query_id": q_ids[q[enough]], "vec_id": ids[at[enough]], "score": total[enough]})

        ranked = rows.mapInPandas(resolve, schema).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        out.append(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    result = out[0] if out else empty
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order; near vectors order them
alike. The index has an inverted list for each set of SHARED pivots within a label: a vector stands in
the lists of all such sets among its first PREFIX pivots, so two vectors meet exactly if they share at
least that many, and the number shared is counted from two bit masks. A pair is compared only in the
list of its smallest shared set, so no pair is seen twice; the comparison is a block-wise cosine in
double precision. A list longer than TILE is dealt to tiles of two blocks each, so that no task
holds more than two blocks of a list however many vectors crowd in it.

Equal vectors are one entry with a multiplicity. Only counts and spanning links leave a task: the
links of a crowd of near copies are never expanded into rows.

The pivots are at most PIVOTS vectors, those with the smallest hashed contents; every vector is
indexed. The index is approximate: ``recall`` is measured in the tests and the README.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a
null label, link with nothing (0 links, their own component). Vectors of unlike length never link.
Repeated ids are separate rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components
from .vectors import matrix, usable

PIVOTS = 64
PREFIX = 6
SHARED = 3
#: Vectors of one list that a task takes as a block.
TILE = 1024
TILE_KEY = ["label", "dim", "key", "low", "high"]
_COMBOS = np.array(list(combinations(range(PREFIX), SHARED)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _describe(pivots: np.ndarray):
    """(key, mask) of each inverted list that a vector stands in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                near = pivots[[len(p) == dim for p in pivots]] if pivots.dtype == object else pivots
                rows = _unit(matrix(part["vector"]))
                reference = np.stack(near) if len(near) else np.zeros((0, dim))
                if reference.shape[1:] != (dim,) or len(reference) < PREFIX:
                    keys, masks, combos = np.zeros((len(rows), 1), np.int64), np.zeros(len(rows), np.int64), 1
                else:
                    order = np.argsort(-(rows @ reference.T), axis=1, kind="stable")[:, :PREFIX]
                    masks = np.bitwise_or.reduce(np.int64(1) << order.astype(np.int64), axis=1)
                    sets = np.sort(order[:, _COMBOS], axis=2)
                    keys = (sets * (PIVOTS ** np.arange(SHARED))).sum(axis=2) + 1
                    combos = len(_COMBOS)
                yield pd.DataFrame({"label": np.repeat(part["label"].to_numpy(), combos), "dim": np.int32(dim), "key": keys.ravel(), "node": np.repeat(part["node"].to_numpy(), combos), "mask": np.repeat(masks, combos), "n": np.repeat(part["n"].to_numpy(), combos)})

    return run


def _smallest(common: np.ndarray) -> np.ndarray:
    """The key of the smallest SHARED pivots of each mask."""
    out, left = np.zeros(common.shape, np.int64), common.copy()
    for k in range(SHARED):
        low = left & -left
        # the float is exact for a power of two; the sign bit is the 64th pivot
        place = np.where(low < 0, 63, np.log2(np.maximum(np.abs(low.astype(np.float64)), 1))).astype(np.int64)
        out += np.where(left != 0, place, 0) * PIVOTS**k
        left = left & (left - 1)
    return out + 1


def _verify(threshold: float):
    """Counts and spanning links of the tiles in a partition, whose rows come ordered by tile."""

    def links_of(tile: pd.DataFrame, rows: np.ndarray):
        """Linked pairs of one tile, each in the one list that counts it."""
        node, mask, block = (tile[c].to_numpy() for c in ("node", "mask", "block"))
        across, list_key = tile["low"].iat[0] != tile["high"].iat[0], tile["key"].iat[0]
        for lo in range(0, len(rows), 512):
            i, j = np.nonzero(np.triu(rows[lo : lo + 512] @ rows.T >= threshold, lo + 1))
            if len(i):
                i += lo
                ok = (block[i] != block[j]) if across else np.ones(len(i), bool)
                if list_key:
                    ok &= _smallest(mask[i] & mask[j]) == list_key
                yield i[ok], j[ok]

    def tile_rows(tiles: pd.DataFrame) -> pd.DataFrame:
        """(node, other, links) of whole tiles: counts have no other, spanning links count nothing."""
        out = []
        unit = np.empty((len(tiles), 0))
        length = tiles["vector"].map(len).to_numpy()
        bounds = np.flatnonzero(np.r_[True, (tiles[TILE_KEY].to_numpy()[1:] != tiles[TILE_KEY].to_numpy()[:-1]).any(axis=1), True])
        if len(set(length)) == 1:
            unit = _unit(matrix(tiles["vector"]))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            rows = unit[lo:hi] if unit.shape[1] else _unit(matrix(tiles["vector"].iloc[lo:hi]))
            if hi - lo <= 64 and not (np.triu(rows @ rows.T, 1) >= threshold).any():
                continue
            tile = tiles.iloc[lo:hi]
            node, n = tile["node"].to_numpy(), tile["n"].to_numpy()
            pairs = list(links_of(tile, rows))
            if not pairs:
                continue
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            links = (np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))).astype(np.int64)
            first = np.arange(len(rows))
            while True:  # the smallest place that each reaches
                low = np.minimum(first[i], first[j])
                after = first.copy()
                np.minimum.at(after, i, low)
                np.minimum.at(after, j, low)
                after = after[after]
                if (after == first).all():
                    break
                first = after
            some, leaf = links > 0, first != np.arange(len(rows))
            out.append((np.r_[node[some], node[leaf]], np.r_[np.full(some.sum(), -1), first[leaf]], np.r_[links[some], np.zeros(leaf.sum(), np.int64)], node))
        if not out:
            return pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")
        other = [pd.array(np.where(o < 0, 0, nodes[o]), "Int64") for _, o, _, nodes in out]
        for x, (_, o, _, _) in zip(other, out, strict=True):
            x[o < 0] = pd.NA
        return pd.DataFrame({"node": np.concatenate([x[0] for x in out]), "other": pd.concat([pd.Series(x) for x in other], ignore_index=True), "links": np.concatenate([x[2] for x in out])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last tile so far, which may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held[TILE_KEY] == held[TILE_KEY].iloc[-1]).all(axis=1).to_numpy()
            start = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if start:
                yield tile_rows(held.iloc[:start].reset_index(drop=True))
                held = held.iloc[start:].reset_index(drop=True)
        if held is not None:
            yield tile_rows(held)

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    single = df.schema[vector].dataType.simpleString() == "array<float>"  # carried as it is; compared in double precision
    kind = "array<float>" if single else "array<double>"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"), F.col(label).cast("string").alias("label"))
    can = usable(F.col("vector")) & F.col("label").isNotNull() & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = cut(rows.withColumn("can", F.coalesce(can, F.lit(False))))
    # entries: distinct vectors of a label, named by their smallest id; -0.0 and 0.0 are the same component
    same = F.transform("vector", lambda x: (x + F.lit(0.0)).cast(kind[6:-1]))
    entries = cut(rows.where("can").groupBy("label", same.alias("vector")).agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    chosen = entries.orderBy(F.xxhash64("vector"), "node").limit(PIVOTS).select("vector").toArrow().to_pandas()["vector"].tolist()
    pivots = np.empty(len(chosen), object)
    pivots[:] = [_unit(np.asarray(v, np.float64)[None])[0] for v in chosen]
    index = cut(entries.mapInPandas(_describe(pivots), "label string, dim int, key long, node long, mask long, n long"))
    lists = index.groupBy("label", "dim", "key").agg(F.count("*").alias("size")).where("size > 1")
    split = index.join(lists, ["label", "dim", "key"]).withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int"))
    split = split.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = split.select("*", other).select("label", "dim", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "mask", "n", "block")
    tiles = tiles.join(entries.select("node", "label", "vector"), ["node", "label"])
    dealt = tiles.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    found = cut(dealt.mapInPandas(_verify(threshold), "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where(F.col("other").isNotNull()), "node", "other")
    named = entries.join(links, "node", "left").join(groups, "node", "left")
    named = named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    keyed = rows.where("can").select("vec_id", "label", same.alias("vector")).join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not can").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON l.a = r.other
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""

"""Helpers that the operators of this subpackage share: input columns, folds, cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set a local session gets a temporary one; on a cluster that would be lost with its machine, so it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that the cluster shares, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 3. A null id counts as 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(3)), F.lit(0)).cast("int")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return fold(doc_id) == 1


#: log2 of the bits of the bitmap behind ``likely_members``: 1 MB.
MEMBER_BITS = 23


def likely_members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among those of ``ids``: all that are, and some others.

    A bitmap of fixed size over the hashed keys is broadcast, so that rows without a partner need not be
    shuffled for the exact join that follows; with very many keys it merely lets more rows pass.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - MEMBER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{key}`), {64 - MEMBER_BITS}) & 63 as int))")
    got = ids.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_pandas()
    words = np.zeros(1 << (MEMBER_BITS - 6), np.uint64)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may_be(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in places:
            at = p.to_numpy(np.int64)
            yield pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0)

    return df.where(may_be(place))

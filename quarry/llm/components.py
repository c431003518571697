"""Connected components of an edge table, without bringing edges or labels to the driver.

Each round does a large-star and a small-star step (Kiveris et al., 2014), which keep the
components and at least shorten every path, until the edges are stars around their smallest nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``: the smallest node that it reaches.

    Null ends and loops are no edges; repeated edges count once. A node's edges are read as a stream by one task, which may
    spill; what leaves it is one row an edge.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col("hi") != F.col("lo"))
    by_node, by_hi = Window.partitionBy("node"), Window.partitionBy("hi")
    before = None
    while True:
        both = pairs.union(pairs.select("lo", "hi")).toDF("node", "other")
        # each node's larger neighbours go to the smallest among its neighbours and it
        large = both.withColumn("least", F.least("node", F.min("other").over(by_node))).where(F.col("other") > F.col("node")).select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        # then each node and its smaller neighbours go to the smallest of these
        small = large.withColumn("least", F.min("lo").over(by_hi)).select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("least").alias("lo"))
        pairs = cut(small.where(F.col("hi") != F.col("lo")).distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before or not now[0]:
            break
        before = now
    leaves = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return leaves.union(pairs.select("lo", "lo").distinct().toDF("node", "component"))

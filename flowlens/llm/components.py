"""Connected components of an edge table by alternating star steps.

Each round points every node at the smallest node it knows, first from the
larger neighbours, then from the smaller ones; the edge table ends as one star
for each component. A round is two aggregations and two joins, its result is a
table in the shared folder, and the driver sees a checksum of it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import write_scratch


def _checksum(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b, in any order and number; returns
    (node, component) with the smallest node as component, for every node of
    an edge. An empty table gives an empty one."""
    e = write_scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _checksum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = write_scratch(small, "edges")
        after = _checksum(e)
        if after == before:
            break
        before = after
    heads = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads.select("node", F.col("node").alias("component")))

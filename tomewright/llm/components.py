"""Connected components by alternating large and small stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import is_empty, stored


def _mark(edges: DataFrame) -> tuple:
    """Number and order-independent digest of the edges: one row to the driver."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 32))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is its smallest node.

    Each round links the larger neighbours of a node to its smallest one, then the smaller ones, and
    writes the new edges to the shared folder; paths shrink geometrically, so rounds grow with the
    logarithm of the longest path. The smallest neighbours are a stored table, so that both sides of a
    join are plain exchanges and a node with very many edges is split by the adaptive skew join.
    Loops, repeated edges and rows with a null end are ignored; no edges give no rows.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e)
    if not is_empty(e):
        mark = _mark(e)
        while True:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
            small = (
                large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v")))
                .distinct()
            )
            e = stored(small)
            new = _mark(e)
            if new == mark:
                break
            mark = new
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import written
from .places import discard


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: a node's neighbours are tied to the smallest of them and itself.

    Only minima are aggregated (with map-side combine); neighbour lists are never gathered.
    """
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    tied = near.join(least, "a")
    root = F.least("a", "m")
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("a"), root.alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), root.alias("b")).unionByName(least.select("a", root.alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node with an edge, but for
    the roots themselves.

    Null ends and loops are left out; an empty table gives an empty one.  Each round is a
    table in the shared folder; the number of rounds grows with the logarithm of the data.
    """
    a, b = F.col(left), F.col(right)
    # every edge points from the larger node to the smaller one
    now = written(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    mark = None
    while True:
        new = written(_stars(_stars(now, large=True), large=False))
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen

"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Each pass at least halves the depth; the bound only stops a run that goes wrong.
MOST_PASSES = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b", passes: int | None = None) -> DataFrame:
    """``node, component`` for every node that has a link; the component is the smallest node reached.

    Large-star and small-star passes over staged edge tables: every pass is a
    minimum per node, combined before the shuffle, and a join, so neither a hub
    nor a long chain meets in one task's memory.  With ``passes`` it stops early:
    nodes of one component are then connected, but a component may be in parts.
    """
    x, y = F.col(a), F.col(b)
    edges = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct()
    for _ in range(passes or MOST_PASSES):
        edges = stage(edges, "edges")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = small.filter("u <> v").distinct()
        if passes is None:
            edges = stage(edges, "edges")
            # Stars only: no centre is itself a leaf and no leaf has two centres.
            centres = edges.select(F.col("v").alias("u")).distinct()
            n, leaves = edges.agg(F.count("*"), F.countDistinct("u")).first()
            if n == leaves and not edges.join(centres, "u", "left_semi").take(1):
                break
    else:
        if passes is None:
            raise RuntimeError("components did not settle")
        edges = stage(edges.groupBy("u").agg(F.min("v").alias("v")), "edges")
    centres = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centres.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )

"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.llm.common import cut


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of `edges`; root is the smallest node reachable.

    Large-star then small-star steps: each links nodes to the smallest neighbour, so that the edges become one star per
    component in a number of rounds that grows with the logarithm of a component's size. Minima are combined before each
    shuffle, joins are equi-joins that Spark splits when a node is hot, and each round ends in the shared checkpoint folder.
    Edges with a null end are dropped, loops and repeated edges change nothing, and no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    links = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _state(links)
    while before[0]:
        both = links.union(links.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        # The smallest neighbour of u links to u itself, every other one to the smallest.
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        links = cut(small.distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())


def _state(links: DataFrame) -> tuple:
    """Two different link sets agree in this only by a collision of 64-bit sums."""
    return tuple(links.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``edges`` (long columns ``a``, ``b``).

    Each round hangs larger neighbours on the smallest one (aggregates with map-side combine and joins that AQE can
    split), so hubs are never gathered in one task, and rounds grow with the logarithm of the longest path. Stops when
    a round leaves the links unchanged. An empty table gives an empty result.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = print_of(current)
    while mark[0]:
        around = both(current)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        current = stored(small.distinct())
        if (now := print_of(current)) == mark:
            break
        mark = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

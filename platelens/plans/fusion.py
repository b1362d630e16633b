"""Combining per-marker probabilities: entropy weights and the evaluation table. Long tables throughout."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropy_weighted(long: DataFrame, keys: Sequence[str], n_classes: int, marker: str = "Antibody") -> DataFrame:
    """Weighted mean over markers of mean class probabilities, (keys, class, p).

    A marker's weight is its share of max(0, (ln k - H) / ln k), H = -sum p ln(p + 1e-8); equal weights if all are 0.
    ``long`` has one row per (keys, marker, class) with column ``p``. The markers and classes of one line are few, so
    they are packed into one row per line: a single shuffle.
    """
    top = math.log(n_classes)
    per_marker = long.groupBy(*keys, marker).agg(
        (-F.sum(F.col("p") * F.log(F.col("p") + F.lit(1e-8)))).alias("_h"),
        F.collect_list(F.struct("class", "p")).alias("_c"),
    )
    weighted = per_marker.select(
        *keys, F.greatest(F.lit(0.0), (F.lit(top) - F.col("_h")) / F.lit(top)).alias("_w"), F.inline("_c")
    )
    total = F.sum("_w")
    p = F.when(total > 0, F.sum(F.col("_w") * F.col("p")) / total).otherwise(F.avg("p"))
    return weighted.groupBy(*keys, "class").agg(p.alias("p"))


def evaluation_table(sources: Sequence[DataFrame], n_classes: int, order: Sequence[str]) -> DataFrame:
    """One row per (line, true class), one column ``class_<i>_<source>``. Inputs: CellLines, True, source, class, p."""
    long = reduce(lambda a, b: a.unionByName(b), [s.select("CellLines", "True", "source", "class", "p") for s in sources])
    cols = [
        F.max(F.when((F.col("source") == s) & (F.col("class") == i), F.col("p"))).alias(f"class_{i}_{s}")
        for s in order for i in range(n_classes)
    ]
    return long.groupBy("CellLines", "True").agg(*cols)

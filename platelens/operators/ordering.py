"""Row scaling, line ordering, centring and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.functions.ordered import positions
from platelens.functions.sizing import join_bounded


def scale_rows(long: DataFrame, group: str = "ModelGenetics", value: str = "Class_1", name: str | None = None):
    """Min-max scaling inside each model; a constant row becomes 0.5.

    The extremes are a grouped aggregate joined back, so a model with many rows is not gathered in one task.
    """
    ends = long.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(F.lit(0.5))
    return join_bounded(long, ends, group).withColumn(name or f"{value}_scaled", scaled).drop("_lo", "_hi")


def order_lines(long: DataFrame) -> DataFrame:
    """Plot order of lines: groups by name; inside a group by the mean score of the matching model, highest first.

    Wild type and sporadic lines use the mean over all models; lines without a matching score come last. A line listed
    under two groups keeps its first place.
    """
    free = F.col("Mutations").isin("WT", "sporadic")
    match = F.when(free | (F.col("ModelGenetics") == F.col("Mutations")), F.col("Class_1"))
    means = long.groupBy("Mutations", "CellLines").agg(F.avg(match).alias("score"))
    first = means.groupBy("CellLines").agg(
        F.min("Mutations").alias("Mutations"), F.min_by("score", "Mutations").alias("score")
    )
    first = first.withColumn("_o", F.coalesce(-F.col("score"), F.lit(float("inf"))))
    ranked = positions(first, ["Mutations"], "_o", ["CellLines"], "position_in_group")
    return ranked.select("Mutations", "CellLines", "score", "position_in_group")


def centre_at_half(df: DataFrame, split: Sequence[str], value: str) -> DataFrame:
    """Shift scores of each split so that their mean is 0.5."""
    means = df.groupBy(*split).agg(F.avg(value).alias("_m"))
    return join_bounded(df, means, list(split)).withColumn(value, F.col(value) - F.col("_m") + 0.5).drop("_m")


def normalise_rows(long: DataFrame, row: Sequence[str], value: str, kind: str) -> DataFrame:
    """Normalise the features of each attribution row: ``max``, ``zscore`` (population) or ``abs``.

    The window holds one row's features, a number fixed by the schema.
    """
    if kind == "abs":
        return long.withColumn(value, F.abs(value))
    w = Window.partitionBy(*row)
    if kind == "max":
        top = F.max(value).over(w)
        return long.withColumn(value, F.col(value) / F.when(top == 0, 1.0).otherwise(top))
    if kind == "zscore":
        sd = F.stddev_pop(value).over(w)
        centred = F.col(value) - F.avg(value).over(w)
        return long.withColumn(value, centred / F.when(sd == 0, 1.0).otherwise(sd))
    raise ValueError(f"unknown normalisation {kind}")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[c if c in keys else f"_r.{c}" for c in df.columns])

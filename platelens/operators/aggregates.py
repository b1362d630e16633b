"""Grouped tables: counts, profiles, replicate summaries and plate layouts. All combine on the map side first."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.ordered import LINEAR, grouped_quantiles, positions
from platelens.functions.sizing import join_bounded
from platelens.operators.features import quoted
from platelens.screen import Screen


def class_columns(df: DataFrame, prefix: str = "Class_") -> list[str]:
    """Class probability columns in class order."""
    found = [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)]
    return sorted(found, key=lambda c: int(c[len(prefix):]))


def cells_per_well(cells: DataFrame) -> DataFrame:
    return cells.groupBy("ID").agg(F.count(F.lit(1)).alias("NCells"))


def well_profiles(screen: Screen) -> DataFrame:
    """Mean of every feature per well."""
    return screen.cells.groupBy("ID").agg(*[F.avg(quoted(c)).alias(c) for c in screen.features])


def profiles_by(screen: Screen, label: str) -> DataFrame:
    """Mean of every feature over the cells of each value of a well label."""
    return screen.labelled(label).groupBy(label).agg(*[F.avg(quoted(c)).alias(c) for c in screen.features])


def group_predicted(scores: DataFrame, group: Sequence[str] | str, score: str = "Class_1") -> DataFrame:
    """Mean score per group, lowest first."""
    keys = [group] if isinstance(group, str) else list(group)
    return scores.groupBy(*keys).agg(F.avg(score).alias(score)).orderBy(score)


def scores_by_line(scores: DataFrame, agg: str = "mean", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per line: the chosen aggregate of class scores, smallest value of ``True`` and ``Mutations``.

    The median is exact and goes through the order statistics that split large groups.
    """
    columns = list(columns or class_columns(scores))
    labels = [c for c in ("True", "Mutations") if c in scores.columns]
    firsts = [F.min(quoted(c)).alias(c) for c in labels]
    if agg == "median":
        medians = grouped_quantiles(scores, ["CellLines"], {c: (c, 0.5) for c in columns}, LINEAR)
        if not firsts:
            return medians
        return medians.join(scores.groupBy("CellLines").agg(*firsts), "CellLines")
    known = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum,
             "count": F.count}
    if agg not in known:
        raise ValueError(f"unknown aggregate {agg}")
    return scores.groupBy("CellLines").agg(*[known[agg](quoted(c)).alias(c) for c in columns], *firsts)


def replicate_means(scores: DataFrame, keys: Sequence[str] = ("True", "CellLines")) -> DataFrame:
    """Mean of every class score over replicates."""
    return scores.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in class_columns(scores)])


def replicate_ranges(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, extremes and error-bar lengths over replicates."""
    out = long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select("*", (F.col("mean") - F.col("min")).alias("error_low"),
                      (F.col("max") - F.col("mean")).alias("error_high"))


def replicate_summary(scores: DataFrame, value: str, keys: Sequence[str] = ("CellLines",)) -> DataFrame:
    """Mean, sample deviation and number of scores."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("mean_pred"), F.stddev_samp(value).alias("std_pred"), F.count(value).alias("count")
    )


def most_common(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per group, the smallest one on ties."""
    counts = df.groupBy(*keys, label).count()
    best = F.min_by(F.col(label), F.struct(-F.col("count"), F.col(label)))
    return counts.groupBy(*keys).agg(best.alias(label), F.max("count").alias("n"))


def cell_count_table(wells: DataFrame, facet: str) -> DataFrame:
    """Mean cells per (line, mutation, facet) and the position of the line inside its facet, most cells first."""
    means = wells.groupBy("CellLines", "Mutations", facet).agg(F.avg("NCells").alias("NCells"))
    totals = means.groupBy(facet, "CellLines").agg(F.sum("NCells").alias("total"))
    totals = positions(totals.withColumn("_o", -F.col("total")), [facet], "_o", ["CellLines"], "position")
    return join_bounded(means, totals.drop("_o"), [facet, "CellLines"])


def cell_count_boxes(wells: DataFrame) -> DataFrame:
    """Five-number summary per mutation of the mean cells per line."""
    lines = wells.groupBy("CellLines", "Mutations").agg(F.avg("NCells").alias("NCells"))
    levels = {"low": ("NCells", 0.0), "q1": ("NCells", 0.25), "median": ("NCells", 0.5), "q3": ("NCells", 0.75),
              "high": ("NCells", 1.0)}
    return grouped_quantiles(lines, ["Mutations"], levels, LINEAR).withColumn("range", F.col("high") - F.col("low"))


def plate_layout(screen: Screen, feature: str, columns: Sequence[int] | None = None) -> DataFrame:
    """Mean of well means per plate position, one output column per plate column."""
    if feature in screen.wells.columns:
        per_well = screen.wells.select("ID", "Row", "Column", quoted(feature).alias("_v"))
    else:
        means = screen.cells.groupBy("ID").agg(F.avg(quoted(feature)).alias("_v"))
        rows = screen.bounds().groups
        per_well = join_bounded(screen.wells.select("ID", "Row", "Column"), means, "ID", rows=rows)
    placed = per_well.select(F.col("Row").cast("int").alias("Row"), F.col("Column").cast("int").alias("Column"), "_v")
    pivot = placed.groupBy("Row").pivot("Column", list(columns) if columns else None)
    return pivot.agg(F.avg("_v"))


def label_counts(lines: DataFrame, label: str = "Mutations") -> DataFrame:
    """Lines per label."""
    return lines.select("CellLines", label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("lines"))


def pooled_probabilities(cells: DataFrame, keys: Sequence[str] = ("CellLines", "Antibody")) -> DataFrame:
    """Mean class probabilities over the cells of a line, per marker."""
    return cells.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in class_columns(cells)])


def shared_by_all(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Keys seen in every value of ``member`` (lines in all screens, lines in all marker sets)."""
    pairs = df.select(*keys, member).distinct()
    total = pairs.agg(F.count_distinct(member)).scalar()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == total).select(*keys)


def pivot_mean(df: DataFrame, rows: Sequence[str], column: str, value: str, values: Sequence | None = None):
    """Mean of ``value`` with one column per value of ``column``."""
    return df.groupBy(*rows).pivot(column, list(values) if values is not None else None).agg(F.avg(value))


def top_features(importance: DataFrame, k: int = 25) -> DataFrame:
    """Features with the largest absolute mean importance over folds."""
    mean = importance.groupBy("feature").agg(F.abs(F.avg("value")).alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(k)


def distinct_values(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns).distinct()

"""Conformal prediction: thresholds, prediction sets, probability grids and regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.functions.hashing import hash_number, hash_order
from platelens.functions.ordered import LINEAR, grouped_quantiles, positions
from platelens.functions.sizing import join_bounded
from platelens.operators.aggregates import class_columns
from platelens.operators.ordering import first_per_key


def _class_array(df: DataFrame) -> Column:
    return F.array(*[F.col(c).cast("double") for c in class_columns(df)])


def nonconformity(scores: DataFrame, name: str = "nonconformity") -> DataFrame:
    """1 - probability of the true class."""
    return scores.withColumn(name, 1 - F.element_at(_class_array(scores), F.col("True").cast("int") + 1))


def adjusted_level(q: float):
    """Finite-sample level q(n+1)/n, clipped to [0, 1]."""
    return lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(float(q)) * (n + 1) / n))


def thresholds(scores: DataFrame, quantiles: Sequence[float] = (0.75, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """(quantile, threshold) per group: linear-interpolated quantile at the adjusted level."""
    levels = {f"t{i}": ("nonconformity", adjusted_level(q)) for i, q in enumerate(quantiles)}
    wide = grouped_quantiles(nonconformity(scores), list(by), levels, LINEAR)
    return wide.select(*by, F.inline(F.array(*[
        F.struct(F.lit(float(q)).alias("quantile"), F.col(f"t{i}").alias("threshold"))
        for i, q in enumerate(quantiles)
    ])))


def _with_sets(scores: DataFrame, limit: Column) -> DataFrame:
    """Prediction set: class numbers, as text, whose probability is at least 1 - threshold."""
    picks = [F.when(F.col(c) >= 1 - limit, F.lit(c.removeprefix("Class_"))).otherwise("") for c in class_columns(scores)]
    chosen = F.array_remove(F.array(*picks), "")
    out = scores.withColumn("PredictionSet", chosen)
    return out.withColumn("Covered", F.array_contains("PredictionSet", F.col("True").cast("int").cast("string")))


def sets_split(calibration: DataFrame, evaluation: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Sets for one table with the threshold of another. Columns CellLines, True, PredictionSet, Covered."""
    limit = thresholds(calibration, [quantile]).select("threshold").scalar()
    return _with_sets(evaluation, limit).select("CellLines", "True", "PredictionSet", "Covered")


def line_halves(scores: DataFrame, seed=42) -> DataFrame:
    """Two seeded halves of the lines: (CellLines, half), the smaller half first."""
    lines = scores.select("CellLines").distinct()
    total = lines.agg(F.count(F.lit(1))).scalar()
    ranked = positions(
        lines.withColumn("_o", hash_number(hash_order(F.col("CellLines"), seed))), [], "_o", ["CellLines"], "_pos"
    )
    return ranked.select("CellLines", F.when(F.col("_pos") <= F.floor(total / 2), 0).otherwise(1).alias("half"))


def sets_cross(scores: DataFrame, quantile: float = 0.9, seed=42) -> DataFrame:
    """Each half of the lines is evaluated with the threshold of the other half; one row per line."""
    split = join_bounded(scores, line_halves(scores, seed), "CellLines")
    limits = thresholds(split, [quantile], by=["half"])
    other = limits.select((1 - F.col("half")).alias("half"), F.col("threshold").alias("_limit"))
    sets = _with_sets(join_bounded(split, other, "half"), F.col("_limit"))
    order = ["half", *class_columns(scores), "True"]
    out = first_per_key(sets.select("CellLines", *order, "PredictionSet", "Covered"), ["CellLines"], order)
    return out.select("CellLines", "True", "PredictionSet", "Covered")


def coverage(sets: DataFrame) -> DataFrame:
    """Share of covered rows and mean set size."""
    return sets.agg(
        F.avg(F.col("Covered").cast("double")).alias("coverage"), F.avg(F.size("PredictionSet")).alias("mean_size")
    )


def _expand(df: DataFrame, names: Sequence[str], left: str) -> DataFrame:
    """Unfold ``left`` grid steps over the named columns: each takes 0..rest, the last takes what remains."""
    for n in names[:-1]:
        df = df.withColumn(n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(left))))
        df = df.withColumn(left, F.col(left) - F.col(n))
    return df.withColumn(names[-1], F.col(left)).drop(left)


def simplex_grid(spark: SparkSession, n_classes: int, step: float = 0.01) -> DataFrame:
    """All probability vectors with entries on the grid, in exact integer steps; grown by generators, not joins."""
    steps = round(1 / step)
    names = [f"_s{i}" for i in range(n_classes)]
    first = spark.range(0, steps + 1).select(F.col("id").alias("_s0"), (F.lit(steps) - F.col("id")).alias("_left"))
    if n_classes == 1:
        first = first.filter(F.col("_left") == 0)
    grid = _expand(first, names[1:], "_left") if n_classes > 1 else first
    return grid.select(*[(F.col(n) / F.lit(steps)).alias(f"Class_{i}") for i, n in enumerate(names)])


def regions(limits: DataFrame, n_classes: int, step: float = 0.01) -> DataFrame:
    """Grid vectors in which a class enters the prediction set, per (quantile, class): P(class) >= 1 - threshold."""
    steps = round(1 / step)
    names = [f"_s{i}" for i in range(n_classes)]
    lowest = F.greatest(F.lit(0), F.ceil((1 - F.col("threshold")) * steps - F.lit(1e-9))).cast("bigint")
    tables = []
    for i in range(n_classes):
        own = limits.filter(lowest <= steps).withColumn(
            names[i], F.explode(F.sequence(lowest, F.lit(steps).cast("bigint")))
        )
        own = own.withColumn("_left", F.lit(steps).cast("bigint") - F.col(names[i])).withColumn("class", F.lit(i))
        tables.append(_expand(own, [n for n in names if n != names[i]], "_left").select("quantile", "class", *names))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("quantile", "class", *[(F.col(n) / F.lit(steps)).alias(f"Class_{i}") for i, n in enumerate(names)])

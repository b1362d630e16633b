"""Cell-count correction of scores.

The model is score ~ count + group. Its correction to a reference count needs one number only: the pooled slope of the
score on the count within groups. It is a two-level aggregate of per-group moments, so no solver and no row exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.operators.aggregates import class_columns

REFERENCE_COUNT = 1000.0


def within_group_slopes(scores: DataFrame, columns: Sequence[str], count: str = "NCells", group: str = "Mutations"):
    """One row: pooled within-group slope of every score column; null when counts do not vary inside any group."""
    x = F.col(count).cast("double")
    parts = scores.groupBy(group).agg(
        (F.var_pop(x) * F.count(x)).alias("_xx"),
        *[(F.covar_pop(x, F.col(c)) * F.count(x)).alias(f"_xy{i}") for i, c in enumerate(columns)],
    )
    den = F.sum("_xx")
    return parts.agg(*[F.when(den > 0, F.sum(f"_xy{i}") / den).alias(c) for i, c in enumerate(columns)])


def _corrected(slopes: DataFrame, columns: Sequence[str], count: str, reference: float) -> dict[str, Column]:
    s = slopes.select(F.struct(*columns).alias("s")).scalar()
    shift = F.lit(float(reference)) - F.col(count)
    return {c: F.col(c) + F.coalesce(s.getField(c), F.lit(0.0)) * shift for c in columns}


def correct_score(scores: DataFrame, score: str = "Class_1", count: str = "NCells", reference=REFERENCE_COUNT):
    """Score at the reference count, as ``Score_corrected``. Without variation inside groups it stays unchanged."""
    fixed = _corrected(within_group_slopes(scores, [score], count), [score], count, reference)
    return scores.withColumn("Score_corrected", fixed[score])


def correct_classes(scores: DataFrame, columns: Sequence[str] | None = None, count: str = "NCells",
                    reference=REFERENCE_COUNT) -> DataFrame:
    """Correct every class on its own, then softmax over the corrected values (``<class>_corrected``)."""
    columns = list(columns or class_columns(scores))
    fixed = _corrected(within_group_slopes(scores, columns, count), columns, count, reference)
    raw = scores.select("*", *[v.alias(f"_z_{c}") for c, v in fixed.items()])
    top = F.greatest(*[F.col(f"_z_{c}") for c in columns])
    exps = raw.select(*scores.columns, *[F.exp(F.col(f"_z_{c}") - top).alias(f"_e_{c}") for c in columns])
    total = sum((F.col(f"_e_{c}") for c in columns[1:]), F.col(f"_e_{columns[0]}"))
    return exps.select(*scores.columns, *[(F.col(f"_e_{c}") / total).alias(f"{c}_corrected") for c in columns])


def fitted_lines(scores: DataFrame, score: str = "Class_1", count: str = "NCells", drop_sporadic: bool = True):
    """Intercept and slope of the model per group, and the fitted value at every observed count."""
    if drop_sporadic:
        scores = scores.filter(F.col("Mutations") != "sporadic")
    slope = within_group_slopes(scores, [score], count).select(F.coalesce(score, F.lit(0.0)).alias("s")).scalar()
    means = scores.groupBy("Mutations").agg(F.avg(score).alias("_y"), F.avg(count).alias("_x"))
    lines = means.select("Mutations", slope.alias("slope"), (F.col("_y") - slope * F.col("_x")).alias("intercept"))
    out = join_bounded(scores.select("CellLines", "Mutations", count), lines, "Mutations")
    return out.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(count))

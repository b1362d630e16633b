"""Attributions of linear scorers and their summaries.

For a linear score the integrated gradient of a feature is exactly (x - baseline) * coefficient; averaged over the
cells of a line it needs only the line's mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.operators.features import quoted
from platelens.plans.fitters import FitResult


def line_means_long(cells: DataFrame, features: Sequence[str], keys: Sequence[str] = ("CellLines",)) -> DataFrame:
    """(keys, feature, mean) with one grouped pass."""
    wide = cells.groupBy(*keys).agg(*[F.avg(quoted(c)).alias(f"_{i}") for i, c in enumerate(features)])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("mean")) for i, c in enumerate(features)
    ])))


def integrated_gradients(means: DataFrame, coefficients: DataFrame, baseline: float = 0.0) -> DataFrame:
    """(line, class, feature, value) from line means and a (class, feature, coef) table."""
    joined = join_bounded(means, coefficients, "feature")
    return joined.select("CellLines", "class", "feature",
                         ((F.col("mean") - F.lit(float(baseline))) * F.col("coef")).alias("value"))


def attribution_wide(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per (line, class), one column ``Feature_<i>``."""
    cols = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"Feature_{i}") for i, f in enumerate(features)]
    return long.groupBy(F.col("CellLines").alias("CellLine"), F.col("class").alias("Class")).agg(*cols)


def train_eval_attributions(table: DataFrame) -> DataFrame:
    """From (Holdout, CellLines, feature, value): a line's value in its own fold, and its mean over the other folds."""
    own = F.col("Holdout") == F.col("CellLines")
    return table.groupBy("CellLines", "feature").agg(
        F.max(F.when(own, F.col("value"))).alias("eval"),
        F.coalesce(F.avg(F.when(~own, F.col("value"))), F.lit(0.0)).alias("train"),
    )


def linear_train_eval(means: DataFrame, fold_coefficients: DataFrame) -> DataFrame:
    """The same for linear scorers without listing folds x lines: totals of coefficients minus the own fold.

    ``fold_coefficients``: (Holdout, feature, coef).
    """
    totals = fold_coefficients.groupBy("feature").agg(F.sum("coef").alias("_t"), F.count(F.lit(1)).alias("_k"))
    own = join_bounded(fold_coefficients.withColumnRenamed("Holdout", "CellLines"), totals, "feature")
    joined = means.join(own, ["CellLines", "feature"])
    others = F.when(F.col("_k") > 1, (F.col("_t") - F.col("coef")) / (F.col("_k") - 1)).otherwise(F.lit(0.0))
    return joined.select("CellLines", "feature", (F.col("mean") * F.col("coef")).alias("eval"),
                         (F.col("mean") * others).alias("train"))


def ridge_coefficients(folds: DataFrame, features: Sequence[str]) -> DataFrame:
    """(ModelGenetics, Holdout, class, feature, coef) of ridge folds, in the units of the features."""
    named = F.transform(F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("coef").alias("coef")),
                        lambda p: F.struct(p["feature"].alias("feature"), p["coef"].alias("coef")))
    return folds.select("ModelGenetics", "Holdout", "class", F.inline(named))


def fitted_coefficients(result: FitResult, spark: SparkSession) -> DataFrame:
    """(fold, class, feature, coef, intercept) of all fitted logistic models, in the units of the features: the scaling
    of the training rows is undone. ``fold`` counts the models of the run; ``fitted_on`` names the lines of each."""
    rows = []
    for fold, model in enumerate(result.fitted):
        raw, base = model.model.plain()
        rows += [(fold, int(c), f, float(raw[k, j]), float(base[k])) for k, c in enumerate(model.classes) for j, f in enumerate(model.features)]
    return spark.createDataFrame(rows, "fold int, class bigint, feature string, coef double, intercept double")


def marker_means(long: DataFrame, marker_of_feature: DataFrame, value: str = "value") -> DataFrame:
    """Mean attribution per line and marker."""
    joined = join_bounded(long, marker_of_feature, "feature")
    return joined.groupBy("CellLines", "Antibody").agg(F.avg(value).alias(value))


def group_importance(importance: DataFrame, groups: Sequence[str], k: int = 25) -> DataFrame:
    """Share of each pattern: summed importance of the top features it matches over the features it matches at all.

    ``importance``: (fold, feature, value). The mean over folds is taken first, then its absolute value.
    """
    mean = importance.groupBy("feature").agg(F.abs(F.avg("value")).alias("importance"))
    sizes = [F.sum(F.col("feature").rlike(g).cast("int")) for g in groups]
    n = mean.agg(F.array(*sizes).alias("n")).scalar()
    top = mean.orderBy(F.desc("importance"), "feature").limit(k)
    sums = top.agg(F.array(*[F.sum(F.when(F.col("feature").rlike(g), F.col("importance")).otherwise(0.0))
                             for g in groups]).alias("s"))
    per = sums.select(F.posexplode("s").alias("i", "s")).select("i", (F.col("s") / F.get(n, F.col("i"))).alias("v"))
    total = per.agg(F.sum("v")).scalar()
    name = F.get(F.array(*[F.lit(g) for g in groups]), F.col("i"))
    return per.select(name.alias("group"), (F.col("v") / total).alias("importance"))

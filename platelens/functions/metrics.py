"""Classification metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.ordered import running_before
from platelens.functions.sizing import join_bounded
from platelens.operators.aggregates import class_columns


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: Column, name: str = "auroc") -> DataFrame:
    """Area under the ROC curve per group: pairs ranked rightly plus half the ties; null if a class is missing.

    Rows are first counted per distinct score; the running count of negatives is split over score ranges when a group
    is large.
    """
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        F.sum(positive.cast("int")).cast("double").alias("_p"), F.sum((~positive).cast("int")).cast("double").alias("_q")
    )
    ranked = running_before(counts, keys, "_s", ["_q"])
    won = F.sum(F.col("_p") * (F.col("_before__q") + F.col("_q") / 2))
    pairs = F.sum("_p") * F.sum("_q")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias(name))


def binary_metrics(long: DataFrame, keys: Sequence[str], score: str = "score", label: str = "True") -> DataFrame:
    """Long table (keys, metric, value): accuracy at 0.5, clipped cross entropy, AUROC."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))
    hit = ((p > 0.5).cast("double") == y).cast("double")
    basic = long.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.avg(loss).alias("cross_entropy"))
    wide = join_bounded(basic, auroc(long, keys, score, F.col(label) == 1, "auc"), list(keys))
    return wide.unpivot(list(keys), ["accuracy", "cross_entropy", "auc"], "metric", "value")


def against_wild_type(predictions: DataFrame, keys: Sequence[str], score: str = "Class_1") -> DataFrame:
    """Mean score per line with one copy of the wild-type rows for each mutation seen in the group.

    Adds ``Mutation`` (the contrast) and ``positive``. Copies are made from the short list of mutations per group.
    """
    means = predictions.groupBy("CellLines", "Mutations", *keys).agg(F.avg(score).alias(score))
    present = means.filter(F.col("Mutations") != "WT").groupBy(*keys).agg(
        F.sort_array(F.collect_set("Mutations")).alias("_others")
    )
    joined = join_bounded(means, present, list(keys))
    wild = F.col("Mutations") == "WT"
    contrasts = F.when(wild, F.col("_others")).otherwise(F.array("Mutations"))
    return joined.select("*", F.explode(contrasts).alias("Mutation"), (~wild).alias("positive")).drop("_others")


def mutation_auroc(predictions: DataFrame, keys: Sequence[str], score: str = "Class_1") -> DataFrame:
    """AUROC of every mutation against wild type; pairs without both classes are left out."""
    rows = against_wild_type(predictions, keys, score)
    return auroc(rows, [*keys, "Mutation"], score, F.col("positive"), "AUROC").filter(F.col("AUROC").isNotNull())


def group_auroc(predictions: DataFrame, x: str, score: str) -> DataFrame:
    """AUROC of wild type against the rest on mean scores per (x, mutation), sporadic rows removed."""
    kept = predictions.filter(F.col("Mutations") != "sporadic")
    means = kept.groupBy(x, "Mutations").agg(F.avg(score).alias(score))
    return auroc(means, [], score, F.col("Mutations") != "WT", "AUROC")


def confusion(predictions: DataFrame, keys: Sequence[str], score: str = "Class_1", cut: float = 0.5) -> DataFrame:
    """Confusion counts, PPV and recall of every mutation against wild type; undefined ratios are 0."""
    rows = against_wild_type(predictions, keys, score)
    called, pos = F.col(score) >= cut, F.col("positive")
    def n(c: Column, name: str) -> Column:
        return F.sum(c.cast("bigint")).alias(name)
    out = rows.groupBy(*keys, "Mutation").agg(
        n(called & pos, "TP"), n(called & ~pos, "FP"), n(~called & pos, "FN"), n(~called & ~pos, "TN")
    ).filter((F.col("TP") + F.col("FN") > 0) & (F.col("FP") + F.col("TN") > 0))
    def ratio(a: str, b: str) -> Column:
        d = F.col(a) + F.col(b)
        return F.when(d > 0, F.col(a) / d).otherwise(F.lit(0.0))
    return out.select("*", ratio("TP", "FP").alias("PPV"), ratio("TP", "FN").alias("Recall"),
                      (F.col("TP") + F.col("FP")).alias("called"), (F.col("TP") + F.col("FN")).alias("actual"))


def matching_heatmap(table: DataFrame, value: str, column: str = "Marker", values: Sequence | None = None):
    """Rows whose contrast is the model's own mutation, one column per marker."""
    own = table.filter(F.col("Mutation") == F.col("ModelGenetics"))
    return own.groupBy("ModelGenetics").pivot(column, list(values) if values else None).agg(F.avg(value))


def matching_fractions(table: DataFrame, top: str, bottom: str, column: str = "Marker", values=None) -> DataFrame:
    """The same layout with text fractions ``numerator/denominator``."""
    own = table.filter(F.col("Mutation") == F.col("ModelGenetics"))
    text = F.concat_ws("/", F.sum(top).cast("string"), F.sum(bottom).cast("string"))
    return own.groupBy("ModelGenetics").pivot(column, list(values) if values else None).agg(text)


def top_class(scores: DataFrame) -> Column:
    """Index of the largest class probability, the first on ties."""
    classes = F.array(*class_columns(scores))
    return F.array_position(classes, F.array_max(classes)) - 1


def class_accuracy(scores: DataFrame) -> DataFrame:
    """Share of rows assigned to their true class, per true class."""
    hit = (top_class(scores) == F.col("True")).cast("double")
    return scores.groupBy("True").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def marker_of_result(df: DataFrame, file: str = "file") -> DataFrame:
    """Parse ``binary-<marker1>-<marker2>-<488|647>``: at 647 the first marker was dropped, at 488 the second."""
    pattern = r"^binary-(.+)-(.+)-(488|647)"
    parts = [F.regexp_extract(file, pattern, i) for i in (1, 2, 3)]
    out = df.select("*", parts[0].alias("Marker1"), parts[1].alias("Marker2"), parts[2].alias("Wavelength"))
    out = out.filter(F.col("Wavelength") != "")
    return out.withColumn("Marker", F.when(F.col("Wavelength") == "647", F.col("Marker1")).otherwise(F.col("Marker2")))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation with 1e-7 added to the denominator."""
    n = F.count(F.lit(1))
    scale = F.sqrt(F.var_pop(a) * n) * F.sqrt(F.var_pop(b) * n)
    return df.agg((F.covar_pop(a, b) * n / (scale + F.lit(1e-7))).alias("cor"))


def relative_rmse(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """Root mean squared error divided by the variance of the truth (+1e-7)."""
    err = F.sqrt(F.avg((F.col(truth) - F.col(estimate)) ** 2))
    return df.agg((err / (F.var_pop(truth) + F.lit(1e-7))).alias("rmse"))

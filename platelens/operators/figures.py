"""Tables behind the standard figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.functions.metrics import top_class
from platelens.functions.sizing import join_bounded
from platelens.operators.aggregates import class_columns
from platelens.operators.ordering import scale_rows
from platelens.plans.labels import label_codes


def _name_of(index, names: Mapping[int, str]):
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in (int(kv[0]), kv[1])])
    return F.try_element_at(pairs, index)


def long_scores(scores: DataFrame, names: Mapping[int, str] | None = None) -> DataFrame:
    """One row per (line, class): ``ModelGenetics`` (class name or number), ``ClassIndex``, score as ``Class_1``."""
    classes = class_columns(scores)
    keys = [c for c in ("CellLines", "True", "Mutations") if c in scores.columns]
    names = names or {}
    rows = F.array(*[
        F.struct(F.lit(names.get(i, str(i) if not names else None)).alias("ModelGenetics"), F.lit(i).alias("ClassIndex"),
                 F.col(c).alias("Class_1"))
        for i, c in enumerate(classes)
    ])
    return scores.select(*keys, F.inline(rows))


def bar_table(scores: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """One row per (line, class) with true class (the largest probability if absent) and its probability."""
    classes = class_columns(scores)
    true = F.col("True").cast("int") if "True" in scores.columns else top_class(scores).cast("int")
    def named(i):
        return F.coalesce(_name_of(i, names), F.concat(F.lit("Class_"), i.cast("string")))
    base = scores.withColumn("_t", true)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("p")) for i, c in enumerate(classes)])
    return base.select("CellLines", "_t", F.element_at(F.array(*classes), F.col("_t") + 1).alias("tp"), F.inline(rows)) \
        .select(F.col("CellLines").alias("CellLine"), named(F.col("_t")).alias("TrueClass"),
                named(F.col("i")).alias("PredictedClass"), F.col("p").alias("Probability"),
                F.col("tp").alias("TrueClassProb"), F.col("i").alias("ClassIndex"))


def heatmap_table(long: DataFrame, scaled: bool = True, lines=None) -> DataFrame:
    """Mean (row-scaled) score, one row per model, one column per line."""
    table = scale_rows(long) if scaled else long.withColumn("Class_1_scaled", F.col("Class_1"))
    return table.groupBy("ModelGenetics").pivot("CellLines", lines).agg(F.avg("Class_1_scaled"))


def heatmap_cells(long: DataFrame) -> DataFrame:
    """The heatmap in long form, for line lists too long to be columns."""
    return scale_rows(long).groupBy("ModelGenetics", "CellLines").agg(F.avg("Class_1_scaled").alias("value"))


def scatter_table(long: DataFrame) -> DataFrame:
    """Vertical offset and opacity by relation of the line's mutation to the model; other mutations sit at 1 + 0.3 i.

    i counts the other mutations by name. The jitter of the drawing is left out.
    """
    known = ~F.col("Mutations").isin("WT", "sporadic")
    codes = label_codes(long.filter(known), "Mutations").withColumnRenamed("code", "_m")
    own = codes.select(F.col("Mutations").alias("ModelGenetics"), F.col("_m").alias("_g"))
    rows = join_bounded(join_bounded(long, codes, "Mutations", "left"), own, "ModelGenetics", "left")
    before = F.col("_m") - F.when(F.col("_g") < F.col("_m"), 1).otherwise(0)
    place = (
        F.when(F.col("Mutations") == "WT", 0.0).when(F.col("Mutations") == F.col("ModelGenetics"), 0.2)
        .when(F.col("Mutations") == "sporadic", 0.4).otherwise(1.0 + before * 0.3)
    )
    strong = F.col("Mutations").isin("WT", "sporadic") | (F.col("Mutations") == F.col("ModelGenetics"))
    return rows.withColumn("mutation_position", place).withColumn("alpha", F.when(strong, 0.8).otherwise(0.3)).drop(
        "_m", "_g"
    )

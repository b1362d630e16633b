"""Splits and folds as tables.

Fold membership is never spelled out as lines x lines. A leave-one-out fold is a row naming its held-out line, and the
training set is "every eligible line but that one"; totals minus the own part give all per-fold quantities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.hashing import hash_number, hash_order
from platelens.functions.ordered import positions
from platelens.functions.sizing import GroupProfile, join_bounded

WILD_TYPE = "WT"
SPORADIC = "sporadic"


def lines_of(wells: DataFrame) -> DataFrame:
    """Distinct (cell line, mutation)."""
    return wells.select("CellLines", "Mutations").distinct()


def mutation_lines(wells: DataFrame, mutations: Sequence[str]) -> DataFrame:
    return lines_of(wells).filter(F.col("Mutations").isin(*mutations)).select("CellLines")


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def stratified_split(wells: DataFrame, share: float = 0.5, seed=47, profile: GroupProfile | None = None) -> DataFrame:
    """Per mutation, ``share`` of the distinct lines (half-even rounding) train, the rest test."""
    lines = lines_of(wells).withColumn("_o", hash_number(hash_order(F.col("CellLines"), seed)))
    return _take_share(lines, share, profile).withColumn(
        "split", F.when(F.col("_in"), "train").otherwise("test")
    ).select("CellLines", "Mutations", "split")


def _take_share(lines: DataFrame, share: float, profile, keys: Sequence[str] = ("Mutations",)) -> DataFrame:
    sizes = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = positions(lines, keys, "_o", ["CellLines"], "_pos", profile)
    ranked = join_bounded(ranked, sizes, list(keys))
    return ranked.withColumn("_in", F.col("_pos") <= round_half_even(F.lit(float(share)) * F.col("_n")))


def split_wells(wells: DataFrame, share: float = 0.5, seed=47) -> DataFrame:
    """The split at well level: ``ID`` and its side."""
    return join_bounded(wells, stratified_split(wells, share, seed).select("CellLines", "split"), "CellLines").select(
        "ID", "CellLines", "Mutations", "split"
    )


def model_genetics(wells: DataFrame) -> list[str]:
    """Mutations that get their own model: all but wild type and sporadic."""
    rows = wells.select("Mutations").distinct().collect()
    return sorted(r[0] for r in rows if r[0] is not None and r[0] not in (WILD_TYPE, SPORADIC))


def eligibility(wells: DataFrame, genetics: Sequence[str] | None = None, holdout: Sequence[str] = ()) -> DataFrame:
    """(ModelGenetics, line, eligible): lines that may train each model. Sporadic lines never do.

    Without ``genetics`` there is one model for all mutations, named ``all``.
    """
    lines = lines_of(wells)
    out = F.col("Mutations").isin(SPORADIC) | F.coalesce(F.col("CellLines").isin(*holdout), F.lit(False))
    if genetics is None:
        return lines.select(F.lit("all").alias("ModelGenetics"), "*", (~out).alias("eligible"))
    models = lines.select(F.explode(F.array(*[F.lit(g) for g in genetics])).alias("ModelGenetics"), "*")
    mine = F.col("Mutations").isin(WILD_TYPE) | (F.col("Mutations") == F.col("ModelGenetics"))
    return models.withColumn("eligible", mine & ~out)


def leave_one_out_folds(table: DataFrame) -> DataFrame:
    """One fold per eligible line (``Holdout``) and the lines predicted in every fold (``Holdout`` null)."""
    return table.select(
        "ModelGenetics", "CellLines", "Mutations",
        F.when(F.col("eligible"), F.col("CellLines")).alias("Holdout"),
        F.when(F.col("eligible"), "held_out").otherwise("every_fold").alias("role"),
    )


def fold_sizes(table: DataFrame, line_cells: DataFrame) -> DataFrame:
    """Training and prediction sizes of every leave-one-out fold, by subtraction from per-model totals."""
    sized = join_bounded(table, line_cells, "CellLines")
    el = F.col("eligible")
    totals = sized.groupBy("ModelGenetics").agg(
        F.sum(el.cast("bigint")).alias("_tl"), F.sum(F.when(el, F.col("cells")).otherwise(0)).alias("_tc"),
        F.sum((~el).cast("bigint")).alias("_hl"), F.sum(F.when(~el, F.col("cells")).otherwise(0)).alias("_hc"),
    )
    return join_bounded(sized.filter(el), totals, "ModelGenetics").select(
        "ModelGenetics", F.col("CellLines").alias("Holdout"),
        (F.col("_tl") - 1).alias("train_lines"), (F.col("_tc") - F.col("cells")).alias("train_cells"),
        (F.col("_hl") + 1).alias("predict_lines"), (F.col("_hc") + F.col("cells")).alias("predict_cells"),
    )


def reciprocal_halves(wells: DataFrame, reps: int = 1, seed=47, holdout: Sequence[str] = ()) -> DataFrame:
    """(rep, half, line, role): train on half A and predict all else, then the other way; holdouts never train.

    A line is in the training set of its own half only, so both models of a repetition predict the holdout lines.
    """
    lines = lines_of(wells).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return _halves(lines.withColumn("_o", hash_number(hash_order(F.col("CellLines"), seed, F.col("rep")))), holdout)


def replicate_halves(wells: DataFrame, replicates: int, holdout: Sequence[str] = ()) -> DataFrame:
    """The first reciprocal halves under each of the seeds 0, 1, ..., in one table; ``rep`` is the seed."""
    lines = lines_of(wells).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = F.md5(F.concat_ws("|", "CellLines", F.lit("0"), F.col("rep").cast("string")))
    return _halves(lines.withColumn("_o", hash_number(order)), holdout)


def _halves(lines: DataFrame, holdout: Sequence[str]) -> DataFrame:
    taken = _take_share(lines, 0.5, None, ("rep", "Mutations"))
    held = F.col("Mutations").isin(SPORADIC) | F.coalesce(F.col("CellLines").isin(*holdout), F.lit(False))
    own = F.when(F.col("_in"), 0).otherwise(1)
    return taken.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "rep", "half", "CellLines", "Mutations",
        F.when((F.col("half") == own) & ~held, "train").otherwise("predict").alias("role"),
    )

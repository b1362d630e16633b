"""Joins between cells, wells, lines and score tables. Equi-joins only; the small side is broadcast when measured small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.operators.features import quoted


def cells_with_wells(cells: DataFrame, wells: DataFrame, rows: int | None = None) -> DataFrame:
    return join_bounded(cells, wells, "ID", rows=rows)


def cells_with_wells_checked(cells: DataFrame, wells: DataFrame, rows: int | None = None) -> DataFrame:
    """Left join that fails at run time when a cell has no well or a value is missing."""
    joined = join_bounded(cells, wells.withColumn("_found", F.lit(True)), "ID", "left", rows=rows)
    complete = F.col("_found").isNotNull()
    for c in [*cells.columns, *wells.columns]:
        complete &= quoted(c).isNotNull()
    check = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("cell without a complete well row")))
    return joined.filter(check).drop("_found")


def keep_ids(cells: DataFrame, wells: DataFrame, rows: int | None = None) -> DataFrame:
    return join_bounded(cells, wells.select("ID"), "ID", "left_semi", rows=rows)


def without_lines(wells: DataFrame, lines: DataFrame) -> DataFrame:
    """Wells whose line is not listed."""
    return join_bounded(wells, lines.select("CellLines"), "CellLines", "left_anti")


def wells_with_counts(wells: DataFrame, cells: DataFrame) -> DataFrame:
    """Wells that have cells, with their number."""
    counts = cells.groupBy("ID").agg(F.count(F.lit(1)).alias("NCells"))
    return wells.drop("NCells").join(counts, "ID")


def scores_with_counts(scores: DataFrame, wells: DataFrame) -> DataFrame:
    """Scores by line with mean cells per well of the line; lines without wells stay."""
    counts = wells.groupBy("CellLines").agg(F.avg("NCells").alias("NCells"))
    return join_bounded(scores, counts, "CellLines", "left")


def scores_with_sets(scores: DataFrame, sets: DataFrame) -> DataFrame:
    return scores.join(sets.select("CellLines", "PredictionSet"), "CellLines", "left")


def look_up(df: DataFrame, table: Mapping | DataFrame, column: str, name: str) -> DataFrame:
    """Value per key, null when absent: a map literal for a Python mapping, a join for a (key, value) table."""
    if isinstance(table, DataFrame):
        key, value = table.columns
        pairs = table.select(F.col(key).alias(column), F.col(value).alias(name))
        return join_bounded(df, pairs, column, "left")
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(name, F.try_element_at(pairs, quoted(column)))


def shared_lines(wells: DataFrame) -> DataFrame:
    """(line, mutation) pairs present in every marker set."""
    from platelens.operators.aggregates import shared_by_all

    return shared_by_all(wells, ["CellLines", "Mutations"], "Antibody")


def merged_group_means(first: DataFrame, second: DataFrame, score1: str, y: str, x: str, hue: str,
                       drop_sporadic: bool = True) -> DataFrame:
    """Group means of two score tables joined on (x, hue), highest first score first."""
    def means(df: DataFrame, value: str, name: str) -> DataFrame:
        if drop_sporadic:
            df = df.filter(F.col(hue) != "sporadic")
        return df.groupBy(x, hue).agg(F.avg(value).alias(name))
    merged = means(first, score1, "score1").join(means(second, y, y), [x, hue])
    return merged.orderBy(F.desc("score1"), x)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out

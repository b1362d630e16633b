"""Row operators: filters on wells, trimming and sampling of cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.functions.hashing import hash_order
from platelens.functions.ordered import NEAREST, grouped_quantiles, rank_position, smallest_digests, smallest_per_group
from platelens.functions.sizing import broadcast_limit, hot_group_rows, join_bounded, profile_groups
from platelens.operators.features import quoted
from platelens.operators.registry import step, well_filter
from platelens.screen import Screen


@well_filter
def select_sample_by_feature(wells: DataFrame, select_key: Sequence[Mapping[str, Sequence]]) -> DataFrame:
    """Keep wells whose label is among the values; all conditions must hold."""
    for item in select_key:
        for column, values in item.items():
            wells = wells.filter(quoted(column).isin(*values))
    return wells


@well_filter
def drop_sample_by_feature(wells: DataFrame, drop_key: Sequence[Mapping[str, Sequence]]) -> DataFrame:
    """Drop wells whose label is among the values; a null label is dropped too."""
    for item in drop_key:
        for column, values in item.items():
            wells = wells.filter(~quoted(column).isin(*values))
    return wells


@well_filter
def drop_cells_by_count(wells: DataFrame, min_count: float = 0, max_count: float | None = None) -> DataFrame:
    """Keep cell lines whose mean cell count per well lies within the closed range."""
    lines = wells.groupBy("CellLines").agg(F.avg("NCells").alias("_mean"))
    lines = lines.filter(F.col("_mean") >= min_count)
    if max_count is not None:
        lines = lines.filter(F.col("_mean") <= max_count)
    return wells.join(lines.select("CellLines"), "CellLines", "left_semi").select(*wells.columns)


@step
def drop_cells_by_feature_qt(screen: Screen, feature_filters: Mapping[str, float]) -> Screen:
    """Per well, keep cells inside [alpha, 1-alpha] of every listed feature (nearest-rank quantiles, untrimmed well).

    Bounds come from the listed columns alone; the full-width cells are not shuffled when the bounds fit a broadcast.
    With more wells the cells move once, by well, and each well finds its bounds where it lies.
    """
    known = screen.bounds()
    if known.groups > broadcast_limit(screen.cells.select("ID", *[quoted(c).alias(f"{c}{end}") for c in feature_filters for end in ("_lo", "_hi")])) and known.max_rows <= hot_group_rows(screen.cells.sparkSession):
        return screen.with_cells(_trimmed_in_place(screen.cells, feature_filters))
    levels = {}
    for i, (feature, alpha) in enumerate(feature_filters.items()):
        levels[f"_lo{i}"] = (feature, float(alpha))
        levels[f"_hi{i}"] = (feature, 1 - float(alpha))
    bounds = grouped_quantiles(screen.cells, ["ID"], levels, NEAREST, screen.bounds())
    inside = F.lit(True)
    for i, feature in enumerate(feature_filters):
        inside &= quoted(feature).between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    cells = join_bounded(screen.cells, bounds, "ID", rows=screen.bounds().groups)
    return screen.with_cells(cells.filter(inside).select(*[quoted(c) for c in screen.cells.columns]))


def _trimmed_in_place(cells: DataFrame, feature_filters: Mapping[str, float]) -> DataFrame:
    """The trim of wells below the hot limit by windows over a well: one shuffle, none if the cells lie by well already."""
    well = Window.partitionBy("ID")
    out, inside = cells.filter(F.col("ID").isNotNull()), F.lit(True)
    for i, (feature, alpha) in enumerate(feature_filters.items()):
        x = quoted(feature)
        out = out.withColumns({f"_r{i}": F.row_number().over(well.orderBy(x.asc_nulls_last())), f"_n{i}": F.count(x).over(well)})
        ends = [rank_position(q, F.col(f"_n{i}"), NEAREST)[0] for q in (float(alpha), 1 - float(alpha))]
        out = out.withColumns({f"_{end}{i}": F.max(F.when(F.col(f"_r{i}") == r, x)).over(well) for end, r in zip(("lo", "hi"), ends, strict=True)})
        inside &= x.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    return out.filter(inside).select(*[quoted(c) for c in cells.columns])


@step
def subsample_rows_by_id(screen: Screen, n: int = 100, seed: int = 47) -> Screen:
    """At most ``n`` cells per well, without replacement, in a seeded order of the cell key.

    Wells are counted from the cells, not taken from ``NCells``. While every well already holds at most ``n`` cells
    nothing is sorted or moved. Otherwise only (ID, digest) is shuffled to find each well's n-th digest, and cells are
    filtered against it.
    """
    cells = screen.cells
    counted = profile_groups(cells, ["ID"])
    if counted.max_rows <= n:
        return screen
    if "cell_key" not in cells.columns:
        keyed = cells.withColumn("_h", hash_order(_content_key(cells), seed))
        return screen.with_cells(smallest_per_group(keyed, ["ID"], ["_h"], n, counted).select(*cells.columns))
    digest = hash_order(F.col("cell_key"), seed)
    last = smallest_digests(cells.select("ID", digest.alias("_h")), ["ID"], "_h", [], n, counted)
    last = last.groupBy("ID").agg(F.max("_h").alias("_last"))
    kept = join_bounded(cells, last, "ID", rows=counted.groups).filter(digest <= F.col("_last"))
    return screen.with_cells(kept.select(*[quoted(c) for c in cells.columns]))


def _content_key(cells: DataFrame):
    """Without a cell key, the values of the row stand in for it; equal rows are interchangeable."""
    return F.to_json(F.struct(*[quoted(c) for c in cells.columns]))

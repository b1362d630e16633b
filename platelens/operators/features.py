"""Feature operators: null and constant columns, selection by pattern, scaling, grouping and renaming."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded, scalar
from platelens.operators.registry import step
from platelens.screen import Screen


def quoted(name: str) -> Column:
    """Column by literal name; feature names hold dots, spaces and brackets."""
    return F.col(f"`{name}`")


def _key_columns(screen: Screen) -> list[str]:
    return [c for c in screen.cells.columns if c not in screen.features]


def _check_pattern(pattern: str) -> None:
    if not (pattern.startswith("^") and pattern.endswith("$")):
        raise ValueError("pattern must start with '^' and end with '$'")


@step
def drop_na_features(screen: Screen, na_prop: float) -> Screen:
    """Drop features whose null share exceeds ``na_prop``; fill the other nulls with the mean over all cells."""
    feats = screen.features
    stats = screen.cells.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count(quoted(c)) for c in feats]).alias("filled"),
        F.array(*[F.avg(quoted(c)) for c in feats]).alias("mean"),
    ).first()
    n, cols = stats["n"], [quoted(c) for c in _key_columns(screen)]
    for c, filled, mean in zip(feats, stats["filled"], stats["mean"], strict=True):
        missing = n - filled
        if n and missing / n > na_prop:
            continue
        dtype = screen.cells.schema[c].dataType
        if missing and mean is not None and dtype.typeName() != "string":
            cols.append(F.coalesce(quoted(c), F.lit(mean).cast(dtype)).alias(c))
        else:
            cols.append(quoted(c))
    return screen.with_cells(screen.cells.select(*cols))


@step
def drop_constant_features(screen: Screen) -> Screen:
    """Keep features with more than one distinct value, null counting as a value; key columns always stay."""
    feats = screen.features
    if not feats:
        return screen
    varies = [
        F.coalesce(F.min(quoted(c)) < F.max(quoted(c)), F.lit(False))
        | ((F.count(quoted(c)) < F.count(F.lit(1))) & (F.count(quoted(c)) > 0))
        for c in feats
    ]
    keep = screen.cells.agg(F.array(*varies).alias("v")).first()["v"]
    names = _key_columns(screen) + [c for c, k in zip(feats, keep, strict=True) if k]
    return screen.with_cells(screen.cells.select(*[quoted(c) for c in names]))


@step
def select_feature_types(screen: Screen, feature_str: str) -> Screen:
    """Keep features whose name matches the pattern, plus key columns."""
    _check_pattern(feature_str)
    keep = [c for c in screen.features if re.search(feature_str, c)]
    return screen.with_cells(screen.cells.select(*[quoted(c) for c in _key_columns(screen) + keep]))


@step
def drop_feature_types(screen: Screen, feature_str: str) -> Screen:
    """Drop features whose name matches the pattern."""
    _check_pattern(feature_str)
    keep = [c for c in screen.features if not re.search(feature_str, c)]
    return screen.with_cells(screen.cells.select(*[quoted(c) for c in _key_columns(screen) + keep]))


@step
def standardize_features(screen: Screen) -> Screen:
    """(x - mean) / (sample deviation + 1e-6) over all cells."""
    return screen.with_cells(scale_columns(screen.cells, screen.features, sample=True, epsilon=1e-6))


@step
def group_markers(screen: Screen, groups: Sequence[str]) -> Screen:
    """Prefix features with each pattern they match; a feature may appear twice, unmatched features are dropped."""
    cols = [quoted(c) for c in _key_columns(screen)]
    for g in groups:
        cols += [quoted(c).alias(f"{g}_{c}") for c in screen.features if re.search(g, c)]
    return screen.with_cells(screen.cells.select(*cols))


@step
def pca_transform(screen: Screen, alpha: float, groups: Sequence[str]) -> Screen:
    """Principal components per feature group, as many as explain ``alpha`` of the variance."""
    from platelens.plans.components import components_by_group

    return screen.with_cells(components_by_group(screen.cells, screen.features, groups, alpha))


def scale_columns(df: DataFrame, columns: Sequence[str], sample: bool = False, epsilon: float = 0.0,
                  fitted_on: DataFrame | None = None) -> DataFrame:
    """Centre and scale columns with statistics of ``fitted_on`` (default: the same rows), in one lazy plan that grows with
    the number of columns (the statistics are one value of a row, not one expression for each column).

    ``sample`` picks the deviation; without ``epsilon`` a constant column is divided by 1.
    """
    dev = F.stddev_samp if sample else F.stddev_pop
    stats = (df if fitted_on is None else fitted_on)
    s = scalar(
        stats,
        m=F.array(*[F.avg(quoted(c)) for c in columns]),
        d=F.array(*[dev(quoted(c)) for c in columns]),
    )
    names = df.columns
    df, s = df.withColumn("_statistics", s), F.col("_statistics")
    scaled = []
    at = {c: i for i, c in enumerate(columns)}
    for c in names:
        if c not in at:
            scaled.append(quoted(c))
            continue
        d = s.getField("d").getItem(at[c])
        d = d + F.lit(epsilon) if epsilon else F.when(d == 0, F.lit(1.0)).otherwise(d)
        scaled.append(((quoted(c) - s.getField("m").getItem(at[c])) / d).alias(c))
    return df.select(*scaled)


def column_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column, long form: one row per (by, feature). For stored scalers."""
    packed = df.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("feature"), F.avg(quoted(c)).alias("mean"), F.stddev_pop(quoted(c)).alias("std"))
        .alias(f"_{i}") for i, c in enumerate(columns)
    ])
    return packed.select(*by, F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


def l2_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide each column by its Euclidean norm."""
    s = scalar(df, norm=F.array(*[F.sqrt(F.sum(quoted(c) * quoted(c))) for c in columns]))
    at = {c: i for i, c in enumerate(columns)}
    names, df = df.columns, df.withColumn("_norms", s)
    return df.select(*[(quoted(c) / F.col("_norms.norm")[at[c]]).alias(c) if c in at else quoted(c) for c in names])


def feature_family(name: str | Column):
    """Text before the first underscore, for a name or for a column of names."""
    return name.split("_")[0] if isinstance(name, str) else F.split(name, "_").getItem(0)


def rename_channels(df: DataFrame, wells: DataFrame) -> DataFrame:
    """Replace channel identifiers in feature names by marker names; both lists are paired in order of appearance."""
    pairs = wells.select("Channel", "Antibody").distinct().orderBy("Channel", "Antibody").collect()
    channels = list(dict.fromkeys(c for p in pairs for c in p["Channel"].split("/")))
    markers = list(dict.fromkeys(a for p in pairs for a in p["Antibody"].split("/")))
    names = list(df.columns)
    for ch, m in zip(channels, markers, strict=False):
        names = [n.replace(ch, m) for n in names]
    return df.toDF(*names)


def without_marker(params: Mapping, marker: str) -> dict:
    """Parameters of an ablation run: features of one marker are dropped as well."""
    out = {**params, "preprocess": dict(params.get("preprocess") or {})}
    old = out["preprocess"].get("drop_feature_types", {}).get("feature_str")
    extra = f"^.*{re.escape(marker)}.*$"
    out["preprocess"]["drop_feature_types"] = {"feature_str": f"{old}|{extra}" if old else extra}
    return out


def repair_line_names(df: DataFrame, column: str = "CellLines") -> DataFrame:
    """Line names that lost their mark: the first ``11`` becomes ``#11``; a doubled mark is made single again."""
    marked = F.regexp_replace(F.col(column), "^(.*?)11", "$1#11")
    fixed = F.regexp_replace(marked, "^(.*?)##11", "$1#11")
    return df.withColumn(column, fixed)


def scale_columns_by(df: DataFrame, columns: Sequence[str], by: str, fitted_on: DataFrame) -> DataFrame:
    """Population scaling with one set of statistics per value of ``by`` (marker set), fitted on other rows."""
    stats = fitted_on.groupBy(by).agg(
        F.array(*[F.avg(quoted(c)) for c in columns]).alias("_m"),
        F.array(*[F.stddev_pop(quoted(c)) for c in columns]).alias("_d"),
    )
    joined = join_bounded(df, stats, by)
    at = {c: i for i, c in enumerate(columns)}
    def scaled(c: str) -> Column:
        d = F.col("_d")[at[c]]
        return ((quoted(c) - F.col("_m")[at[c]]) / F.when(d == 0, F.lit(1.0)).otherwise(d)).alias(c)
    return joined.select(*[scaled(c) if c in at else quoted(c) for c in df.columns])

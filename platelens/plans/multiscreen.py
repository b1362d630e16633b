"""Several screens: joint scaling, per-screen alignment, and distances between screens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import as_local, join_bounded, kept, scalar
from platelens.operators.features import quoted
from platelens.operators.joins import cells_with_wells_checked
from platelens.screen import KEYS


def joint_scale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8) over all screens together."""
    s = scalar(
        df if fitted_on is None else fitted_on,
        m=F.array(*[F.avg(quoted(c)) for c in columns]), d=F.array(*[F.stddev_pop(quoted(c)) for c in columns]),
    )
    at = {c: i for i, c in enumerate(columns)}
    names, df = df.columns, df.withColumn("_statistics", s)
    return df.select(*[
        ((quoted(c) - F.col("_statistics.m")[at[c]]) / (F.col("_statistics.d")[at[c]] + F.lit(1e-8))).alias(c)
        if c in at else quoted(c) for c in names
    ])


@dataclass
class ScreenAligner:
    """Brings every screen to the pooled mean and deviation; ``per_screen=False`` only scales all screens jointly.

    ``fit`` reads the cells once: the pooled values follow from those of the screens. ``transform`` reuses them for new data. A screen that was
    not seen in training is aligned with its own statistics.
    """

    per_screen: bool = True

    def fit(self, cells: DataFrame, wells: DataFrame) -> ScreenAligner:
        return self._fit(with_labels(cells, wells))

    def _fit(self, joined: DataFrame) -> ScreenAligner:
        self.features = [c for c in joined.columns if c not in KEYS]
        counts = F.array(*[F.count(quoted(c)) for c in self.features]).alias("n")
        per_screen = joined.groupBy("Screen").agg(*_moments(self.features), counts)
        local = as_local(per_screen)  # one row for each screen
        self.screens = kept(per_screen) if local is None else local
        rows = self.screens.toPandas()
        n, m, d = (np.array([[np.nan if v is None else v for v in r] for r in rows[c]], dtype=float) for c in ("n", "m", "d"))
        share = n / n.sum(axis=0)
        mean = np.nansum(share * m, axis=0)
        self.pooled = {"m": mean.tolist(), "d": np.sqrt(np.nansum(share * (d**2 + (m - mean) ** 2), axis=0)).tolist()}
        self.known = len(rows)
        self.screens = self.screens.drop("n")
        return self

    def transform(self, cells: DataFrame, wells: DataFrame) -> DataFrame:
        """``aligned_feature_i`` and the keys ID, CellLines, Mutations, Screen."""
        joined = with_labels(cells, wells)
        stats, bound = self.screens, self.known
        if self.per_screen:
            new = wells.select("Screen").distinct().join(self.screens.select("Screen"), "Screen", "left_anti")
            if more := new.count():  # only screens that training has not seen need a pass of their own
                own = join_bounded(joined, new, "Screen", "left_semi", rows=more)
                stats, bound = stats.unionByName(own.groupBy("Screen").agg(*_moments(self.features))), bound + more
        return self._aligned(joined, stats, bound)

    def _aligned(self, joined: DataFrame, stats: DataFrame, bound: int) -> DataFrame:
        keys = [c for c in ("ID", "CellLines", "Mutations", "Screen") if c in joined.columns]
        mean, dev = self.pooled["m"], self.pooled["d"]
        if self.per_screen:
            joined = join_bounded(joined, stats, "Screen", rows=bound)
        out = []
        for i, c in enumerate(self.features):
            x = quoted(c)
            if self.per_screen:
                own = F.col("d")[i] + F.lit(1e-8)
                x = (x - F.col("m")[i]) / own * F.lit(dev[i]) + F.lit(mean[i])
            out.append(((x - F.lit(mean[i])) / F.lit(dev[i] + 1e-8)).alias(f"aligned_feature_{i}"))
        return joined.select(*out, *keys)

    def fit_transform(self, cells: DataFrame, wells: DataFrame | None = None) -> DataFrame:
        """Without ``wells`` the cells carry their labels already (``with_labels``), so several aligners can share a join."""
        joined = cells if wells is None else with_labels(cells, wells)
        self._fit(joined)
        return self._aligned(joined, self.screens, self.known)


def _moments(features: Sequence[str]):
    return (F.array(*[F.avg(quoted(c)) for c in features]).alias("m"),
            F.array(*[F.stddev_pop(quoted(c)) for c in features]).alias("d"))


def with_labels(cells: DataFrame, wells: DataFrame) -> DataFrame:
    """Cells with line, mutation and screen; a cell without a complete well row is an error."""
    return cells_with_wells_checked(
        cells.drop("CellLines", "Mutations", "Screen"), wells.select("ID", "CellLines", "Mutations", "Screen")
    )


def line_means(df: DataFrame, dims: Sequence[str] | None = None, vector: str | None = None,
               keys: Sequence[str] = ("Screen", "CellLines")) -> DataFrame:
    """Long (keys, dim, mean) from wide columns or from one array column."""
    if vector is not None:
        parts = df.select(*keys, F.posexplode(vector).alias("dim", "v"))
        return parts.groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    wide = df.groupBy(*keys).agg(*[F.avg(quoted(c)).alias(f"_{i}") for i, c in enumerate(dims)])
    return wide.select(*keys, F.posexplode(F.array(*[f"_{i}" for i in range(len(dims))])).alias("dim", "mean"))


def screen_distances(means: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Mean cosine distance over shared lines for every pair of screens, (screen1 < screen2, distance, lines).

    Screens are few; pairs are formed inside a line between its screens, from one row per (line, screen).
    """
    if shared is not None:
        means = join_bounded(means, shared.select("CellLines"), "CellLines", "left_semi")
    vec = means.groupBy("CellLines", "Screen").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s.getField("mean")).alias("v")
    )
    a = vec.select("CellLines", F.col("Screen").alias("screen1"), F.col("v").alias("a"))
    b = vec.select("CellLines", F.col("Screen").alias("screen2"), F.col("v").alias("b"))
    pairs = a.join(b, "CellLines").filter(F.col("screen1") < F.col("screen2"))

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    cosine = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    per_line = pairs.select("screen1", "screen2", (1 - cosine).alias("d"))
    return per_line.groupBy("screen1", "screen2").agg(F.avg("d").alias("distance"), F.count("d").alias("lines"))


def embedding_distance(means: DataFrame, screen1: str, screen2: str) -> DataFrame:
    """Alignment of two screens: mean cosine distance between the same lines."""
    two = means.filter(F.col("Screen").isin(screen1, screen2))
    return screen_distances(two).select("distance")


def distance_matrix(distances: DataFrame, screens: DataFrame) -> DataFrame:
    """Symmetric long matrix with a zero diagonal; ``place1``/``place2`` put the closest pair first, then by name."""
    best = distances.filter(F.col("distance") > 0).agg(
        F.min_by(F.struct("screen1", "screen2"), F.struct("distance", "screen1", "screen2")).alias("v")
    ).scalar()

    def place(c: str):
        return F.when(F.col(c) == best.getField("screen1"), 0).when(F.col(c) == best.getField("screen2"), 1).otherwise(2)

    both = distances.select("screen1", "screen2", "distance").unionByName(
        distances.select(F.col("screen2").alias("screen1"), F.col("screen1").alias("screen2"), "distance")
    ).unionByName(screens.select(F.col("Screen").alias("screen1"), F.col("Screen").alias("screen2"),
                                 F.lit(0.0).alias("distance")).distinct())
    out = both.select("screen1", "screen2", "distance", place("screen1").alias("place1"), place("screen2").alias("place2"))
    return out.orderBy("place1", "screen1", "place2", "screen2")

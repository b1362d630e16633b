"""Principal components from one Gram matrix: one pass over the rows for any number of feature groups, one to project."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelens.functions.arrays import gram
from platelens.operators.features import quoted, scale_columns
from platelens.screen import KEYS


@dataclass
class FittedComponents:
    """A basis (feature x component, by falling variance): new rows are projected with the same numbers. The sign of a
    component makes its largest weight positive."""

    basis: np.ndarray
    shares: np.ndarray
    columns: list[str]
    kept: int

    @property
    def explained(self) -> list[float]:
        return self.shares[: self.kept].tolist()

    def transform(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Append component columns. Nulls are not allowed in the inputs."""
        return project(df, [(self, list(names[: self.kept]))])


def project(df: DataFrame, parts: Sequence[tuple[FittedComponents, Sequence[str]]]) -> DataFrame:
    """Append the named components of several bases: one scan, one product for each basis and batch."""
    held = [f"_k{i}" for i in range(len(df.columns))]  # names of any kind
    columns = list(dict.fromkeys(c for p, _ in parts for c in p.columns))
    at = [np.array([columns.index(c) for c in p.columns]) for p, _ in parts]
    shared = df.sparkSession.sparkContext.broadcast([p.basis[:, : len(names)] for p, names in parts])
    new = [f"_n{i}" for i in range(sum(len(names) for _, names in parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
            if not np.isfinite(x).all():
                raise ValueError("components need all values of their columns")
            out = [np.ascontiguousarray(z) for a, basis in zip(at, shared.value, strict=True) for z in (x[:, a] @ basis).T]
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, *map(pa.array, out)], [*held, *new])

    given = df.select(*[quoted(c).alias(h) for c, h in zip(df.columns, held, strict=True)], F.array(*[quoted(c).cast("double") for c in columns]).alias("_x"))
    schema = T.StructType([T.StructField(h, df.schema[c].dataType) for c, h in zip(df.columns, held, strict=True)] + [T.StructField(n, T.DoubleType()) for n in new])
    return given.mapInArrow(run, schema).toDF(*df.columns, *(n for _, names in parts for n in names))


def _basis(n: int, sums: np.ndarray, square: np.ndarray, columns: Sequence[str], alpha: float | None, k: int | None) -> FittedComponents:
    """Components from the moments of the columns. ``alpha`` keeps the first ones that reach this share of variance."""
    mean = sums / max(n, 1)
    values, basis = np.linalg.eigh((square - n * np.outer(mean, mean)) / max(n - 1, 1))
    values, basis = np.maximum(values[::-1], 0.0), basis[:, ::-1]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(columns))] < 0, -1.0, 1.0)
    shares = values / values.sum() if values.sum() > 0 else values
    kept = len(columns) if alpha is None else int(np.searchsorted(np.cumsum(shares), alpha - 1e-12) + 1)
    return FittedComponents(basis, shares, list(columns), min(kept, len(columns), k or len(columns)))


def fit_components(df: DataFrame, columns: Sequence[str], alpha: float | None = None, k: int | None = None) -> FittedComponents:
    """PCA of columns that are centred already."""
    return _basis(*gram(df, columns), columns, alpha, k)


def components_by_group(cells: DataFrame, features: Sequence[str], groups: Sequence[str], alpha: float) -> DataFrame:
    """Standardise, then PCA inside each pattern's features; unmatched features form an unnamed last group.

    Key columns always stay. One Gram matrix of all features serves every group; so does the scan that projects.
    """
    keys = [c for c in cells.columns if c not in features]
    scaled = scale_columns(cells, features)
    members = [(f"{g}_", [c for c in features if re.search(g, c)]) for g in groups]
    rest = [c for c in features if not any(c in m for _, m in members)]
    members = [(p, m) for p, m in members + [("", rest)] if m]
    n, sums, square = gram(scaled, features)
    parts = []
    for prefix, columns in members:
        at = np.array([list(features).index(c) for c in columns])
        fitted = _basis(n, sums[at], square[np.ix_(at, at)], columns, alpha, None)
        parts.append((fitted, [f"{prefix}PC{i}" for i in range(fitted.kept)]))
    return project(scaled, parts).select(*[quoted(c) for c in keys], *[quoted(c) for _, names in parts for c in names])


def profile_components(cells: DataFrame, wells: DataFrame, group: str = "ID") -> DataFrame:
    """All components of standardised mean profiles per well (or per another well label)."""
    features = [c for c in cells.columns if c not in KEYS]
    rows = cells if group == "ID" else cells.join(wells.select("ID", group), "ID")
    means = rows.groupBy(group).agg(*[F.avg(quoted(c)).alias(c) for c in features])
    scaled = scale_columns(means, features)
    fitted = fit_components(scaled, features)
    out = fitted.transform(scaled, [f"column_{i}" for i in range(len(features))])
    return out.select(group, *[f"column_{i}" for i in range(fitted.kept)])


def score_components(scores: DataFrame, extra: DataFrame | None = None, class_prefix: str = "Class_", k: int = 2):
    """First components of class-probability vectors; ``extra`` rows are projected on the same basis.

    Returns the projected table(s) and the explained variance shares.
    """
    columns = [c for c in scores.columns if re.fullmatch(re.escape(class_prefix) + r"\d+", c)]
    def centred(df: DataFrame) -> DataFrame:
        means = scores.agg(F.array(*[F.avg(c) for c in columns]).alias("m")).scalar()
        return df.select("*", *[(F.col(c) - means.getItem(i)).alias(f"_c_{c}") for i, c in enumerate(columns)])
    inputs = [f"_c_{c}" for c in columns]
    fitted = fit_components(centred(scores), inputs, k=k)
    names = [f"PCA{i + 1}" for i in range(k)]
    main = fitted.transform(centred(scores), names).drop(*inputs)
    other = None if extra is None else fitted.transform(centred(extra), names).drop(*inputs)
    return main, other, fitted.explained

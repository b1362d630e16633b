"""Sums of arrays over tasks, and the Gram matrix of many columns in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.operators.features import quoted

TREE = 32


def task_sums(df: DataFrame, add: Callable[[np.ndarray | None, pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """What ``add`` makes of all batches, added up: one array a task, then the arrays of ``TREE`` groups of tasks while they
    stream past, and those on the driver. None for a table without rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = add(total, batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, dtype=np.float64).tobytes()], pa.binary())], ["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("v"):
                v = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = df.mapInArrow(task, "v binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(TREE)))
    rows = parts.repartition(TREE, "g").drop("g").mapInArrow(added, "v binary").collect()  # ``TREE`` rows at most
    return sum((np.frombuffer(r["v"], dtype=np.float64) for r in rows[1:]), np.frombuffer(rows[0]["v"], dtype=np.float64)) if rows else None


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of columns, in one pass; nulls and NaN are an error."""
    d = len(columns)
    upper = np.triu_indices(d)

    def add(total: np.ndarray | None, batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
        if not np.isfinite(x).all():
            raise ValueError("components need all values of their columns")
        own = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[upper]])
        return own if total is None else total + own

    total = task_sums(df.select(F.array(*[quoted(c).cast("double") for c in columns]).alias("x")), add)
    if total is None:
        return 0, np.zeros(d), np.zeros((d, d))
    square = np.zeros((d, d))
    square[upper] = total[1 + d :]
    return int(total[0]), total[1 : 1 + d], square + np.triu(square, 1).T

"""Size checks that decide between broadcast and shuffle, and between one window per group and split groups.

Two limits rule the whole package. Both can be changed per session:

* ``spark.platelens.broadcastRows``: a side of a join is broadcast only when a proven upper bound of its row count is at
  or below this and its rows, by the width of their schema, stay within ``BROADCAST_BYTES``; otherwise the join shuffles and AQE splits skewed partitions.
* ``spark.platelens.hotGroupRows``: a group with more rows than this is never sorted or collected as a whole.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
LOCAL_ROWS = 10_000
BROADCAST_BYTES = 128 << 20
NESTED_BYTES = 2000  # assumed of an array, map or struct
TEXT_BYTES = 64
HOT_GROUP_ROWS = 500_000
KEPT_ROWS = 10_000_000


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.platelens.broadcastRows", str(BROADCAST_ROWS)))


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.platelens.hotGroupRows", str(HOT_GROUP_ROWS)))


def row_bytes(df: DataFrame) -> int:
    """Assumed width of a row: what fixed types take, and a flat rate for texts and nested values."""
    size = {"string": TEXT_BYTES, "binary": TEXT_BYTES, "array": NESTED_BYTES, "map": NESTED_BYTES, "struct": NESTED_BYTES}
    return 16 + sum(size.get(f.dataType.typeName(), 8) for f in df.schema.fields)


def broadcast_limit(small: DataFrame) -> int:
    """Rows of this width that may be broadcast."""
    return min(broadcast_rows(small.sparkSession), BROADCAST_BYTES // row_bytes(small))


@dataclass(frozen=True)
class GroupProfile:
    """Upper bounds: number of groups, and rows in the largest of them. Filters only lower both."""

    groups: int
    max_rows: int


def profile_groups(df: DataFrame, keys: Sequence[str]) -> GroupProfile:
    """One pass with map-side combine over the key columns alone."""
    sizes = df.groupBy(*keys).count()
    row = sizes.agg(F.count(F.lit(1)).alias("g"), F.max("count").alias("m")).first()
    return GroupProfile(row["g"], row["m"] or 0)


def as_local(small: DataFrame) -> DataFrame | None:
    """A result of at most ``LOCAL_ROWS`` rows (statistics per label, codes, thresholds), computed once and kept in the
    plan as local data; None when there are more rows. At most one row beyond the limit reaches the driver."""
    rows = small.limit(LOCAL_ROWS + 1).toArrow()
    if rows.num_rows > LOCAL_ROWS:
        return None
    return small.sparkSession.createDataFrame(rows, small.schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Without it a local master gets one of its own; on a cluster, whose
    executors would not find each other's files, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="platelens-")


def kept(df: DataFrame) -> DataFrame:
    """A result that is read several times, computed once: a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pinned(df: DataFrame) -> DataFrame:
    """A result that several branches must see alike (sketches depend on merge order): local data, else a checkpoint."""
    local = as_local(df)
    return local if local is not None else kept(df)


def kept_short(df: DataFrame, rows: float) -> DataFrame:
    """``kept`` for a result that is proven to have at most ``KEPT_ROWS`` rows; a larger one is left to be computed again."""
    return kept(df) if rows <= KEPT_ROWS else df


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of groups above the hot limit; at most rows / limit of them."""
    sizes = df.groupBy(*keys).count().filter(F.col("count") > hot_group_rows(df.sparkSession))
    return pinned(sizes.select(*keys))


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with ``small`` broadcast when a proven bound ``rows``, or a look at its size, allows it; else by shuffle.

    A shuffled join keeps all rows too: AQE splits the partitions of a skewed ``big`` side.
    """
    limit = broadcast_rows(big.sparkSession)
    nested = any(f.dataType.typeName() in ("array", "map", "struct") for f in small.schema.fields)
    if rows is None and not nested and limit >= LOCAL_ROWS:
        local = as_local(small)
        if local is not None:
            return big.join(F.broadcast(local), on, how)
    limit = broadcast_limit(small)
    fits = rows <= limit if rows is not None else small.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(small) if fits else small, on, how)


def scalar(df: DataFrame, **columns):
    """One-row aggregate of ``df`` as a scalar subquery holding a struct; evaluated once, then a literal."""
    return df.agg(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("v")).scalar()

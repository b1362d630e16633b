"""Order statistics, running sums and positions inside groups, exact and without sorting a hot group in one task.

Groups no larger than the hot limit (a measured bound) take the short way: one shuffle on the key. Larger groups are
cut into order-preserving buckets first. The cut points come from a mergeable sketch; they only balance the work, the
results are exact for any cut points because bucket counts are summed exactly and the wanted rank is located in them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelens.functions.hashing import hash_number
from platelens.functions.sizing import GroupProfile, hot_group_rows, hot_groups, join_bounded, kept_short, pinned, profile_groups

NEAREST = "nearest"
LINEAR = "linear"
BUCKETS = 256  # at least; larger groups get as many as keep a bucket well below the hot limit


def rank_position(q, n: Column, method: str) -> list[Column]:
    """1-based rank(s) whose values give quantile ``q`` of ``n`` sorted values."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    h = (n - 1) * q
    if method == NEAREST:
        return [(F.floor(h + 0.5) + 1).cast("bigint")]
    return [(F.floor(h) + 1).cast("bigint"), (F.ceil(h) + 1).cast("bigint")]


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    levels: dict[str, tuple[str, float | Callable[[Column], Column]]],
    method: str = NEAREST,
    profile: GroupProfile | None = None,
) -> DataFrame:
    """One row per group with the exact quantile ``alias -> (column, level)``; nulls are ignored.

    A level is a number, or a function of the group's non-null count for levels that depend on n.
    """
    columns = sorted({c for c, _ in levels.values()})
    df = df.select(*keys, *[F.col(f"`{c}`") for c in columns])
    profile = profile or profile_groups(*_with_key(df, keys))
    if profile.max_rows <= hot_group_rows(df.sparkSession):
        return _quantiles_of_small_groups(df, keys, levels, columns, method)
    if not keys:
        return _quantiles_of_hot_groups(df, keys, levels, method, profile)
    hot = hot_groups(df, keys)
    small = _quantiles_of_small_groups(join_bounded(df, hot, list(keys), "left_anti"), keys, levels, columns, method)
    large = join_bounded(df, hot, list(keys), "left_semi")
    return small.unionByName(_quantiles_of_hot_groups(large, keys, levels, method, profile))


def _level(level, n: Column) -> Column:
    return level(n) if callable(level) else F.lit(float(level))


def _interpolate(level: Column, n: Column, values: list[Column], method: str) -> Column:
    if method == NEAREST:
        return values[0]
    h = (n - 1) * level
    return values[0] + (h - F.floor(h)) * (values[1] - values[0])


def _quantiles_of_small_groups(df, keys, levels, columns, method):
    sorted_values = {c: F.sort_array(F.collect_list(F.col(f"`{c}`"))) for c in columns}
    # lists cannot shrink before the shuffle, so rows are moved first and each task packs its own groups
    moved = df.repartition(*keys) if keys else df
    packed = moved.groupBy(*keys).agg(*[v.alias(f"_v{i}") for i, v in enumerate(sorted_values.values())])
    out = []
    for alias, (c, level) in levels.items():
        values = F.col(f"_v{columns.index(c)}")
        n = F.size(values)
        q = _level(level, n)
        picks = [F.try_element_at(values, r.cast("int")) for r in rank_position(q, n, method)]
        out.append(F.when(n > 0, _interpolate(q, n, picks, method)).alias(alias))
    return packed.select(*keys, *out)


def _quantiles_of_hot_groups(df, keys, levels, method, profile):
    """Per column: sketch, count per bucket, locate the ranks, order only the rows of the buckets holding them.

    The cut points are pinned: the counting and the ordering branch must cut alike.
    """
    base, gk = _with_key(df, keys)
    result = base.select(*gk).distinct()
    for c in sorted({c for c, _ in levels.values()}):
        mine = {a: lv for a, (col, lv) in levels.items() if col == c}
        rows = base.select(*gk, F.col(f"`{c}`").alias("_x")).filter(F.col("_x").isNotNull())
        cuts = sorted({float(f"{p:.6f}") for lv in mine.values() for p in _brackets(lv)})
        cut = pinned(rows.groupBy(*gk).agg(
            F.count(F.lit(1)).alias("_n"),
            F.array_sort(F.array_distinct(F.percentile_approx("_x", cuts, 10_000))).alias("_cuts"),
        ))
        cut_bound = profile.groups
        bucketed = join_bounded(rows, cut, gk, rows=cut_bound).withColumn("_b", _bucket_of("_x", "_cuts"))
        sums = bucketed.groupBy(*gk, "_b", "_n").count()
        w = Window.partitionBy(*gk).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_upto", F.sum("count").over(w))
        wanted = sums.select(
            *gk, "_b", "_n", (F.col("_upto") - F.col("count")).alias("_before"), "_upto",
            F.explode(F.array(*[
                F.struct(F.lit(a).alias("a"), F.lit(i).alias("i"), r.alias("r"))
                for a, lv in mine.items()
                for i, r in enumerate(rank_position(_level(lv, F.col("_n")), F.col("_n"), method))
            ])).alias("_t"),
        ).filter((F.col("_t.r") > F.col("_before")) & (F.col("_t.r") <= F.col("_upto")))
        wanted = wanted.select(*gk, "_b", "_n", "_t.a", "_t.i", (F.col("_t.r") - F.col("_before")).alias("_local"))
        bound = cut_bound * len(mine) * 2
        need = wanted.select(*gk, "_b").distinct()
        inside = join_bounded(bucketed, need, [*gk, "_b"], "left_semi", rows=bound)
        dist = inside.groupBy(*gk, "_b", "_x").count()
        wv = Window.partitionBy(*gk, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        dist = dist.withColumn("_hi", F.sum("count").over(wv))
        hit = join_bounded(dist, wanted, [*gk, "_b"], rows=bound).filter(
            (F.col("_local") <= F.col("_hi")) & (F.col("_local") > F.col("_hi") - F.col("count"))
        )
        pieces = [
            F.max(F.when((F.col("a") == a) & (F.col("i") == i), F.col("_x"))).alias(f"_{j}_{i}")
            for j, a in enumerate(mine) for i in range(1 if method == NEAREST else 2)
        ]
        per = hit.groupBy(*gk).agg(F.max("_n").alias("_n"), *pieces)
        per = per.select(*gk, *[
            _interpolate(
                _level(lv, F.col("_n")), F.col("_n"),
                [F.col(f"_{j}_{i}") for i in range(1 if method == NEAREST else 2)], method,
            ).alias(a)
            for j, (a, lv) in enumerate(mine.items())
        ])
        result = result.join(per, gk, "left")
    return result.select(*keys, *levels)


def _brackets(level) -> list[float]:
    if callable(level):
        return [i / BUCKETS for i in range(1, BUCKETS)]
    return [min(1.0, max(0.0, level + d)) for d in (-2e-4, 2e-4)]


def _bucket_of(value: str, cuts: str) -> Column:
    return F.size(F.filter(F.col(cuts), lambda x: x < F.col(value)))


def bucket_count(spark, profile: GroupProfile) -> int:
    return max(BUCKETS, -(-4 * profile.max_rows // hot_group_rows(spark)))


def order_buckets(df: DataFrame, keys: Sequence[str], value: str, profile: GroupProfile) -> DataFrame:
    """Add ``_b``: an order-preserving bucket of ``value``; 0 for all groups below the hot limit."""
    if profile.max_rows <= hot_group_rows(df.sparkSession):
        return df.withColumn("_b", F.lit(0))
    n = bucket_count(df.sparkSession, profile)
    levels = [i / n for i in range(1, n)]
    hot = join_bounded(df, hot_groups(df, keys), list(keys), "left_semi")
    cut = pinned(hot.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(value, levels, max(10_000, 10 * n)))).alias("_cuts")
    ))
    out = join_bounded(df, cut, list(keys), "left")
    return out.withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(_bucket_of(value, "_cuts"))).drop("_cuts")


def running_before(
    df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], profile: GroupProfile | None = None
) -> DataFrame:
    """Add ``_before_<w>``: sum of each weight over rows of the group with a strictly smaller ``value``.

    ``df`` holds one row per (keys, value), that is, it is aggregated on the value already.
    """
    df, gk = _with_key(df, keys)
    profile = profile or profile_groups(df, gk)
    b = order_buckets(df, gk, value, profile)
    inner = Window.partitionBy(*gk, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = b.select("*", *[F.coalesce(F.sum(w).over(inner), F.lit(0)).alias(f"_before_{w}") for w in weights])
    if profile.max_rows > hot_group_rows(df.sparkSession):
        outer = Window.partitionBy(*gk).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = b.groupBy(*gk, "_b").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
        offsets = offsets.select(
            *gk, "_b", *[F.coalesce(F.sum(f"_s_{w}").over(outer), F.lit(0)).alias(f"_o_{w}") for w in weights]
        )
        local = join_bounded(local, offsets, [*gk, "_b"], rows=profile.groups * bucket_count(df.sparkSession, profile))
        for w in weights:
            local = local.withColumn(f"_before_{w}", F.col(f"_before_{w}") + F.col(f"_o_{w}")).drop(f"_o_{w}")
    return local.drop("_b") if keys else local.drop("_b", "_all")


def positions(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence, name: str, profile: GroupProfile | None = None
) -> DataFrame:
    """Add the 1-based position of each row inside its group, ordered by a numeric ``value`` and then ``ties``."""
    df, gk = _with_key(df, keys)
    profile = profile or profile_groups(df, gk)
    b = order_buckets(df, gk, value, profile)
    w = Window.partitionBy(*gk, "_b").orderBy(F.col(value), *ties)
    out = b.withColumn(name, F.row_number().over(w).cast("bigint"))
    if profile.max_rows > hot_group_rows(df.sparkSession):
        outer = Window.partitionBy(*gk).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = b.groupBy(*gk, "_b").count()
        offsets = offsets.select(*gk, "_b", F.coalesce(F.sum("count").over(outer), F.lit(0)).alias("_offset"))
        out = join_bounded(out, offsets, [*gk, "_b"], rows=profile.groups * bucket_count(df.sparkSession, profile))
        out = out.withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")
    return out.drop("_b") if keys else out.drop("_b", "_all")


def room_below(n: int) -> float:
    """Rows to expect below the share that :func:`below_share` keeps for the ``n`` smallest."""
    return n + 8 * n**0.5 + 40


def below_share(digest: str, size: str, n: int) -> Column:
    """Whether a digest lies in the share of the range that practically always holds the ``n`` smallest of ``size``."""
    return hash_number(F.col(digest)) * F.col(size) < F.lit(room_below(n) * 16.0**13)


def smallest_digests(df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence, n: int, profile: GroupProfile | None = None,
                     sizes: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows of every group with the smallest digests (:func:`hash_order`), without sorting the others.

    Digests are uniform, so in a group of N rows the n smallest lie below a share of little more than n / N of their
    range. Rows above it go before anything is moved. Groups that kept fewer than n of their rows, which practically never
    happens, are done in full, so the result is exact. ``sizes``: rows of every group as ``_size``, if they are known. The
    rows are read once for the sizes and once for what lies below the share.
    """
    keys = list(keys)
    if profile is not None and profile.max_rows <= 4 * n:
        return smallest_per_group(df, keys, [digest, *ties], n, profile)
    sizes = pinned(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))) if sizes is None else sizes
    if profile is None:
        row = sizes.agg(F.count(F.lit(1)).alias("g"), F.max("_size").alias("m")).first()
        profile = GroupProfile(row["g"], row["m"] or 0)
        if profile.max_rows <= 4 * n:
            return smallest_per_group(df, keys, [digest, *ties], n, profile)
    sized = join_bounded(df, sizes, keys, rows=profile.groups)
    near = kept_short(sized.filter(below_share(digest, "_size", n)), profile.groups * room_below(n))
    left = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    short = sizes.join(left, keys, "left").filter(F.coalesce("_left", F.lit(0)) < F.least(F.lit(n), F.col("_size"))).select(*keys)
    first = smallest_per_group(near.drop("_size"), keys, [digest, *ties], n, profile)
    if short.isEmpty():
        return first.select(*df.columns)
    whole = smallest_per_group(df.join(short, keys, "left_semi").select(*df.columns), keys, [digest, *ties], n, profile)
    return first.join(short, keys, "left_anti").select(*df.columns).unionByName(whole)


def smallest_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence, n: int, profile: GroupProfile | None = None, fan_in: int = 64
) -> DataFrame:
    """The ``n`` first rows of every group. Large groups are cut down in two steps so that no task sees them whole.

    The first step merges the shares of a subset of map tasks (as many subsets as keep a share below the hot limit), the
    second merges at most ``n`` survivors of each. The outcome does not depend on how rows were spread over tasks.
    """
    profile = profile or profile_groups(df, keys)
    fan_in = max(fan_in, -(-2 * profile.max_rows // hot_group_rows(df.sparkSession)))
    first = Window.partitionBy(*keys, "_share").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    if profile.max_rows <= hot_group_rows(df.sparkSession):
        return df.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")
    some = df.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    some = some.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_share", "_r")
    return some.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")

"""Seeded sampling for training and evaluation: cells per line, class balance, repeated draws."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.functions.hashing import hash_number, hash_order, hash_pick
from platelens.functions.ordered import NEAREST, below_share, grouped_quantiles, positions, room_below, smallest_digests
from platelens.functions.sizing import GroupProfile, join_bounded, kept_short, pinned, profile_groups


def cells_per_line(cells: DataFrame, keys: Sequence[str], n: int, seed=47, key: str = "cell_key") -> DataFrame:
    """Exactly ``n`` cells per group: distinct ones if there are enough, else ``n`` draws with replacement.

    Draw i of a short group takes the cell at a hash-chosen position, so the outcome is reproducible anywhere. Only
    the chosen cells, at most ``n`` per group, are ever packed together.
    """
    names = cells.columns
    profile = profile_groups(cells, keys)
    first = smallest_digests(cells.withColumn("_h", hash_order(F.col(key), seed)), keys, "_h", [key], n, profile)
    rest = [c for c in names if c not in keys]
    packed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_h", *rest))).alias("_rows"))
    text = [F.col(k).cast("string") for k in keys]
    have = F.size("_rows")

    def pick(i):
        digest = hash_order(F.concat_ws("|", *text, i.cast("string")), seed)
        return F.struct(i.alias("draw"), F.get("_rows", hash_pick(digest, have).cast("int")).alias("row"))

    distinct = F.transform("_rows", lambda r: F.struct(F.lit(0).cast("bigint").alias("draw"), r.alias("row")))
    drawn = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")), pick)
    out = packed.select(*keys, F.explode(F.when(have >= n, distinct).otherwise(drawn)).alias("_d"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_d.row.{c}").alias(c) for c in names], "_d.draw")


def line_draws(cells: DataFrame, n: int, epochs: int = 1, seed=47, key: str = "cell_key", line: str = "CellLines") -> DataFrame:
    """``n`` cells of every line for each of ``epochs``, as cells with ``copies``: how often each is drawn.

    The epochs take their blocks of ``n`` one after another from the line's cells in seeded order, and begin again where a
    line has no more; so a line of any size counts ``n`` x ``epochs``, and no cell is drawn twice before all are once. Two
    numbers of a line decide: its size, and the place in the order up to which cells are drawn once more. Cells are read
    once for the sizes and once for those that can be drawn (``ordered.smallest_digests``); only these are put in order."""
    want = n * epochs
    rows = cells.withColumn("_h", hash_order(F.col(key), seed))
    sizes = pinned(cells.groupBy(line).agg(F.count(F.lit(1)).alias("_n")))
    lines = sizes.count()
    told = join_bounded(rows, sizes, line, rows=lines)
    near = kept_short(told.filter(below_share("_h", "_n", want)), lines * room_below(want))
    rank = F.when(F.col("_n") >= want, F.lit(want)).otherwise(F.pmod(F.lit(want), F.col("_n")))
    have = near.groupBy(line).agg(F.count(F.lit(1)).alias("_left"))
    short = sizes.join(have, line, "left").filter(F.coalesce("_left", F.lit(0)) < F.least(F.lit(want), F.col("_n"))).select(line)
    if not short.isEmpty():  # practically never
        near = near.join(short, line, "left_anti").unionByName(told.join(short, line, "left_semi"))
    near = near.withColumn("_o", hash_number(F.col("_h")))
    own = Window.partitionBy(line)
    near = near.withColumn("_r", F.row_number().over(own.orderBy("_o")))
    near = near.withColumn("_cut", F.max(F.when(F.col("_r") == rank, F.col("_o"))).over(own))
    more = F.coalesce(F.col("_o") <= F.col("_cut"), F.lit(False))
    whole = F.when(F.col("_n") >= want, 0).otherwise(F.floor(F.lit(want) / F.col("_n")))
    return near.withColumn("copies", (whole + more.cast("int")).cast("int")).filter("copies > 0").drop("_h", "_o", "_n", "_r", "_cut")


def upsampled_lines(lines: Sequence[tuple[str, str]], seed=47) -> list[str]:
    """``upsample_lines`` for (line, class) pairs on the driver: names with their repeats."""
    of: dict[str, list[str]] = {}
    for name, kind in sorted(set(lines), key=lambda x: (md5(f"{x[0]}|{seed}".encode()).hexdigest()[:13], x[0])):
        of.setdefault(kind, []).append(name)
    most = max(map(len, of.values()), default=0)
    extra = [names[int(md5(f"{kind}|{copy}|{seed}".encode()).hexdigest()[:13], 16) % len(names)] for kind, names in of.items() for copy in range(1, most - len(names) + 1)]
    return sorted([name for names in of.values() for name in names] + extra)


def repeated_draws(cells: DataFrame, keys: Sequence[str], n: int, reps: int, seed=47, key: str = "cell_key"):
    """At most ``n`` cells per group in each of ``reps`` independent seeded draws; only key columns are replicated."""
    sizes = pinned(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    row = sizes.agg(F.count(F.lit(1)).alias("g"), F.max("_size").alias("m")).first()
    many = GroupProfile(row["g"] * reps, row["m"] or 0)
    sizes = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    reps_of = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    reps_of = reps_of.withColumn("_h", hash_order(F.col(key), seed, F.col("rep")))
    return smallest_digests(reps_of, [*keys, "rep"], "_h", [key], n, many, sizes).drop("_h")


def repeated_means(cells: DataFrame, keys: Sequence[str], values: Sequence[str], n: int, reps: int, seed=47):
    """Mean of each draw, then the mean over draws: the averaged held-out estimate."""
    drawn = repeated_draws(cells.select(*keys, "cell_key", *values), keys, n, reps, seed)
    per_rep = drawn.groupBy(*keys, "rep").agg(*[F.avg(v).alias(v) for v in values])
    return per_rep.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("reps"))


def upsample_lines(lines: DataFrame, seed=47, by: str = "Mutations") -> DataFrame:
    """Repeat lines of rare classes until every class has as many as the largest; ``copy`` 0 is the original."""
    sizes = lines.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).scalar()
    ranked = positions(
        lines.withColumn("_o", hash_number(hash_order(F.col("CellLines"), seed))), [by], "_o", ["CellLines"], "_pos"
    )
    extra = sizes.withColumn("_more", most - F.col("_n")).filter(F.col("_more") > 0)
    extra = extra.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_more"))))
    text = F.concat_ws("|", F.col(by), F.col("copy").cast("string"))
    extra = extra.select(by, "copy", (hash_pick(hash_order(text, seed), F.col("_n")) + 1).alias("_pos"))
    added = ranked.join(extra, [by, "_pos"])
    return lines.withColumn("copy", F.lit(0).cast("bigint")).unionByName(
        added.select(*lines.columns, F.col("copy").cast("bigint"))
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Weights that give each class the weight of the largest: the cheap form of up-sampling."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).scalar()
    return sizes.select(label, "n", (most.cast("double") / F.col("n")).alias("weight"))


def balanced_rows(rows: DataFrame, label: str, kind: str = "down", seed=47, key: str = "cell_key") -> DataFrame:
    """Equal class sizes: ``down`` keeps the smallest class size of each, ``up`` repeats rows of smaller classes.

    The kept rows are found by comparing a digest against each class's cut, so classes are never sorted as a whole.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_o", hash_number(hash_order(F.col(key), seed)))
    if kind == "down":
        least = sizes.agg(F.min("_n")).scalar()
        cut = grouped_quantiles(
            rows, [label], {"_cut": ("_o", lambda n: F.when(n > 1, (least - 1) / (n - 1)).otherwise(0.0))}, NEAREST
        )
        kept = join_bounded(rows, cut, label).filter(F.col("_o") <= F.col("_cut"))
        return kept.drop("_o", "_cut")
    if kind != "up":
        raise ValueError("kind must be 'up' or 'down'")
    most = sizes.agg(F.max("_n")).scalar()
    ranked = positions(rows, [label], "_o", [key], "_pos")
    sized = join_bounded(ranked, sizes, label)
    # row p of a class of n rows is repeated as often as the numbers p, p+n, p+2n.. fit below the largest class
    sized = sized.withColumn("_times", (F.floor((most - F.col("_pos")) / F.col("_n")) + 1).cast("int"))
    out = sized.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return out.drop("_o", "_pos", "_n", "_times")

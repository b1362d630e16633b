"""Leave-one-line-out ridge scores from sufficient statistics.

One pass over the cells gives, per line, the count, the sums and the cross products of the features. Since a line has
one label, every fold's normal equations are the class totals minus the held-out line; no fold reads the cells again.
The estimator is ridge regression on class indicators, not logistic regression, and its rows say so.

One rule for missing values, whatever the number of features: a cell counts only when all its features are there (neither
null nor NaN), in the counts as in the sums. A line without such a cell has no statistics and so no fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.functions.arrays import TREE
from platelens.functions.sizing import join_bounded, kept, scalar
from platelens.operators.features import quoted

EXPRESSION_LIMIT = 16  # up to here plain aggregates; both ways give the same statistics
BROADCAST_BYTES = 64 << 20
FOLD_COLUMNS = ["ModelGenetics", "Holdout", "label", "class", "share", "weights", "coef", "intercept", "score"]
HELD_NUMBERS = 4_000_000  # partial sums a task keeps before it hands them on


def line_statistics(cells: DataFrame, features: Sequence[str], line: str = "CellLines") -> DataFrame:
    """(line, n, sx, sxx): sums of centred features and their cross products (row-major), combined on the map side.

    Few features use plain aggregates. Many use one numpy product per Arrow batch, summed per task and then by entry.
    Cells with a missing feature take no part.
    """
    d = len(features)
    there = F.forall(F.array(*[quoted(c).cast("double") for c in features]), lambda v: v.isNotNull() & ~F.isnan(v))
    cells = cells.filter(there)
    centre = scalar(cells, m=F.array(*[F.avg(quoted(c).cast("double")) for c in features])).getField("m")
    cells = cells.withColumn("_centre", centre)  # one value of a row, not one expression for each feature
    x = [quoted(c).cast("double") - F.col("_centre")[i] for i, c in enumerate(features)]
    if d <= EXPRESSION_LIMIT:
        flat = cells.select(line, *[v.alias(f"_x{i}") for i, v in enumerate(x)])
        prods = {(i, j): F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}_{j}")
                 for i in range(d) for j in range(i, d)}
        sums = flat.groupBy(line).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(d)], *prods.values()
        )
        return sums.select(
            line, "n", F.array(*[f"_s{i}" for i in range(d)]).alias("sx"),
            F.array(*[f"_q{min(i, j)}_{max(i, j)}" for i in range(d) for j in range(d)]).alias("sxx"),
        )
    return _statistics_in_batches(cells.select(line, F.array(*x).alias("x")), d, line)


def _statistics_in_batches(packed: DataFrame, d: int, line: str) -> DataFrame:
    def vectors(pdf: pd.DataFrame):
        for name, part in pdf.groupby(line):
            m = np.vstack(part["x"].to_numpy())
            yield (name,), np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])

    arrays = _summed(packed, [f"{line} string"], vectors)
    return arrays.select(
        line, F.col("a")[0].cast("bigint").alias("n"), F.slice("a", 2, d).alias("sx"),
        F.slice("a", d + 2, d * d).alias("sxx"),
    )


def _summed(df: DataFrame, keys: Sequence[str], vectors) -> DataFrame:
    """Keys (``name type``) and ``a``, the sum of all vectors of a key. ``vectors`` gives (key values, vector) of a batch.

    Every task adds its vectors up first and hands on one array for each key. Arrays are added while they stream past in
    the order of the keys, those of ``TREE`` groups of tasks first, so no task holds more than one sum and one array.
    """
    names = [k.rsplit(" ", 1)[0] for k in keys]
    head = ", ".join(f"`{k.rsplit(' ', 1)[0]}` {k.rsplit(' ', 1)[1]}" for k in keys)

    def add_up(batches):
        total: dict[tuple, np.ndarray] = {}

        def flush():
            if total:
                yield pd.DataFrame([(*key, vec.tobytes()) for key, vec in total.items()], columns=[*names, "v"])
            total.clear()

        for pdf in batches:
            for key, vec in vectors(pdf):
                total[key] = total.get(key, 0.0) + vec
                if len(total) * len(vec) > HELD_NUMBERS:
                    yield from flush()
        yield from flush()

    def streamed(batches, last: bool):
        current, total = None, np.zeros(0)

        def result():
            return pd.DataFrame([(*current, total if last else total.tobytes())], columns=[*names, "a" if last else "v"])

        for pdf in batches:
            for *key, raw in pdf.itertuples(index=False):
                v = np.frombuffer(raw, dtype=np.float64)
                if key == current:
                    total += v
                    continue
                if current is not None:
                    yield result()
                current, total = key, v.copy()
        if current is not None:
            yield result()

    parts = df.mapInPandas(add_up, f"{head}, v binary").withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(TREE)))
    some = parts.repartition(*names, "_g").sortWithinPartitions(*names).drop("_g").mapInPandas(lambda b: streamed(b, False), f"{head}, v binary")
    return some.repartition(*names).sortWithinPartitions(*names).mapInPandas(lambda b: streamed(b, True), f"{head}, a array<double>")


def leave_one_out_ridge(stats: DataFrame, table: DataFrame, features: Sequence[str], strength: float = 1.0) -> DataFrame:
    """Per (ModelGenetics, held-out line, class): intercept, coefficients on standardised features, line score.

    ``table``: (ModelGenetics, CellLines, label, eligible). Classes get equal total weight. The totals of a class are one
    array per model, broadcast when all of them are within ``BROADCAST_BYTES`` and joined otherwise; a fold is then
    solved from its own row. A fold without training lines gives no row. ``stats`` is read more than once: keep it
    (:func:`platelens.functions.sizing.kept`).
    """
    features = list(features)
    d = len(features)
    spark = stats.sparkSession
    fit = table.filter(F.col("eligible")).join(stats, "CellLines")

    def vectors(pdf: pd.DataFrame):
        for r in pdf.itertuples(index=False):
            yield (r.ModelGenetics, r.label), np.concatenate([[r.n], r.sx, r.sxx])

    packed = fit.select("ModelGenetics", F.col("label").cast("bigint").alias("label"), "n", "sx", "sxx")
    totals = kept(_summed(packed, ["ModelGenetics string", "label bigint"], vectors))
    shared = None
    if totals.count() * (1 + d + d * d) * 8 <= BROADCAST_BYTES:
        by_model: dict[str, dict[int, np.ndarray]] = {}
        for r in totals.collect():
            by_model.setdefault(r["ModelGenetics"], {})[r["label"]] = np.array(r["a"], dtype=float)
        shared, joined = spark.sparkContext.broadcast(by_model), fit
    else:
        lists = totals.groupBy("ModelGenetics").agg(F.collect_list(F.struct("label", "a")).alias("totals"))
        joined = fit.join(lists, "ModelGenetics")

    def solve_all(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                yield solve(r)

    def solve(r: dict) -> pd.DataFrame:
        own = np.concatenate([[r["n"]], np.asarray(r["sx"]), np.asarray(r["sxx"])])
        if shared is not None:
            parts = dict(shared.value[r["ModelGenetics"]])
        else:
            parts = {t["label"]: np.array(t["a"], dtype=float) for t in r["totals"]}
        parts[r["label"]] = parts[r["label"]] - own
        parts = {c: v for c, v in parts.items() if v[0] > 0.5}
        labels = sorted(parts)
        if not labels:
            return pd.DataFrame(columns=FOLD_COLUMNS)
        whole = sum(v[0] for v in parts.values())
        scaled = {c: v * (whole / (len(labels) * v[0])) for c, v in parts.items()}
        s = sum(scaled.values())
        mean = s[1:d + 1] / s[0]
        gram = s[d + 1:].reshape(d, d) / s[0] - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(gram), 0, None))
        sd[sd == 0] = 1.0
        z = gram / np.outer(sd, sd) + (strength / s[0]) * np.eye(d)
        own_z = (np.asarray(r["sx"]) / r["n"] - mean) / sd
        out = []
        for c in labels:
            share = scaled[c][0] / s[0]
            xy = (scaled[c][1:d + 1] / s[0] - share * mean) / sd
            w = np.linalg.solve(z, xy)
            out.append((r["ModelGenetics"], r["CellLines"], r["label"], c, share, w.tolist(), (w / sd).tolist(),
                        float(share - (w / sd) @ mean), float(share + own_z @ w)))
        return pd.DataFrame(out, columns=FOLD_COLUMNS)

    schema = ("ModelGenetics string, Holdout string, label bigint, class bigint, share double, "
              "weights array<double>, coef array<double>, intercept double, score double")
    folds = joined.mapInPandas(solve_all, schema)
    return folds.withColumn("estimator", F.lit("ridge"))


def holdout_scores(stats: DataFrame, table: DataFrame, folds: DataFrame) -> DataFrame:
    """Scores of lines that never train, averaged over all folds: the score is linear, so coefficients are averaged."""
    mean = folds.select("ModelGenetics", "class", "intercept", F.posexplode("coef").alias("pos", "w"))
    mean = mean.groupBy("ModelGenetics", "class", "pos").agg(F.avg("w").alias("w"), F.avg("intercept").alias("b"))
    held = table.filter(~F.col("eligible")).join(stats, "CellLines")
    x = held.select("ModelGenetics", "CellLines", "n", F.posexplode("sx").alias("pos", "s"))
    joined = join_bounded(x, mean, ["ModelGenetics", "pos"])
    return joined.groupBy("ModelGenetics", "CellLines", "class").agg(
        (F.sum(F.col("w") * F.col("s") / F.col("n")) + F.max("b")).alias("score")
    ).withColumn("estimator", F.lit("ridge"))

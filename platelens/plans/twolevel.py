"""Two-level scorers of many folds at once: cell models per marker, mean logits per line, line models on top.

Cell models of all folds of a marker are fitted together (``manyfits.fit_folds``); one scan of a marker's cells gives the mean
logits and probabilities of every line under every fold. Line models are small (rows are lines): each fold is fitted in one
task, for all settings. A setting names ``C`` of the line model; settings share the cell models.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded, kept
from platelens.plans.fusion import entropy_weighted, evaluation_table
from platelens.plans.manyfits import FoldModel, fit_folds, fit_rows, line_sums, softmax

Parts = tuple[dict[str, FoldModel], FoldModel]  # cell models by marker, and the line model


@dataclass
class TwoLevels:
    """Fitted models by fold and setting (or why there are none)."""

    markers: list[str]
    models: list[list[Parts | str]]
    pooled: DataFrame | None = None  # lines of the rows that the models were fitted with

    def pooled_lines(self, rows: Mapping[str, DataFrame]) -> DataFrame | None:
        """Every line present in all markers under every fold: ``z`` (logits of all markers) and ``p`` (by marker)."""
        first = [next((s for s in settings if not isinstance(s, str)), None) for settings in self.models]
        return pool({m: (rows[m], [x[0][m] if x else "" for x in first]) for m in self.markers}) if any(first) else None

    def scored(self, rows: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """``CellLines``, ``label``, ``_fold``, ``_setting``, ``agg`` (line probabilities) and ``p`` (an array per marker)."""
        pooled = self.pooled if rows is None else self.pooled_lines(rows)
        lines = {(f, s): m[1] for f, settings in enumerate(self.models) for s, m in enumerate(settings) if not isinstance(m, str)}
        many = len(self.models[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    for s in range(many):
                        if (model := lines.get((r["_fold"], s))) is not None:
                            coef, base = model.plain()
                            p = softmax((coef @ np.array(r["z"]) + base)[None])[0][0]
                            out.append({"CellLines": r["CellLines"], "label": r["label"], "_fold": r["_fold"], "_setting": s, "agg": p.tolist(), "p": r["p"]})
                kind = pa.list_(pa.float64())
                fields = [("CellLines", pa.string()), ("label", batch.column("label").type), ("_fold", pa.int32()), ("_setting", pa.int32()), ("agg", kind), ("p", pa.list_(kind))]
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

        label = pooled.schema["label"].dataType.simpleString()
        return pooled.mapInArrow(run, f"CellLines string, label {label}, _fold int, _setting int, agg array<double>, p array<array<double>>")


def pool(parts: Mapping[str, tuple[DataFrame, Sequence[FoldModel | str]]]) -> DataFrame:
    """Lines present in every marker, with their mean logits and probabilities under every fold that has a model of each."""
    out = None
    for m in sorted(parts):
        rows, models = parts[m]
        means = line_sums(rows, models).select("CellLines", "_fold", "label", "z", F.array("p").alias("p"))
        if out is None:
            out = means
            continue
        both = out.join(means.drop("label").withColumnsRenamed({"z": "_z", "p": "_p"}), ["CellLines", "_fold"])
        out = both.select("CellLines", "_fold", "label", F.concat("z", "_z").alias("z"), F.concat("p", "_p").alias("p"))
    return out


def fit_two_levels(rows: Mapping[str, DataFrame], features: Mapping[str, Sequence[str]], folds: Sequence[Sequence[str]] | None,
                   settings: Sequence[Mapping], seed: int = 47, lines: Mapping[str, DataFrame] | None = None) -> TwoLevels:
    """Models of every fold (its training lines, a line named again counts again) and setting. ``lines``: cells that lines are
    pooled from, if not the training cells themselves."""
    markers = sorted(rows)
    cell = {"balance": settings[0].get("balance", "weights")}
    found = {m: fit_folds(rows[m], features[m], folds, cell, seed) for m in markers}
    number = len(found[markers[0]])
    reason = [next((found[m][f] for m in markers if isinstance(found[m][f], str)), None) for f in range(number)]
    if all(reason):
        return TwoLevels(markers, [[r] * len(settings) for r in reason])
    usable = {m: [found[m][f] if reason[f] is None else reason[f] for f in range(number)] for m in markers}
    pooled = kept(pool({m: ((lines or rows)[m], usable[m]) for m in markers}))
    if folds is None:
        training = pooled.withColumn("times", F.lit(1))
    else:
        named = [(f, line, own.count(line)) for f, own in enumerate(folds) for line in dict.fromkeys(own)]
        training = join_bounded(pooled, pooled.sparkSession.createDataFrame(named, "_fold int, CellLines string, times int"), ["_fold", "CellLines"], rows=len(named))
    penalties = [float(s.get("C", 1.0)) for s in settings]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("CellLines")
        z = np.stack(part["z"].to_list())
        names = [f"z_{i}" for i in range(z.shape[1])]
        models = fit_rows(names, z, part["label"].to_numpy(), part["times"].to_numpy(dtype=np.float64), penalties)
        f = int(part["_fold"].iloc[0])
        if isinstance(models, str):
            return pd.DataFrame([{"_fold": f, "_setting": 0, "reason": models}]).reindex(columns=LINE_MODEL)
        return pd.DataFrame([{"_fold": f, "_setting": s, "reason": None, "classes": [str(c) for c in m.classes], "centre": m.centre, "spread": m.spread, "coef": m.coef.ravel().tolist(),
                              "intercept": m.intercept.tolist(), "gradient": m.gradient} for s, m in enumerate(models)], columns=LINE_MODEL)

    schema = "_fold int, _setting int, reason string, classes array<string>, centre array<double>, spread array<double>, coef array<double>, intercept array<double>, gradient double"
    fitted = training.groupBy("_fold").applyInPandas(fit, schema).collect()  # a row a fold and setting
    kind = type(next(x for x in usable[markers[0]] if isinstance(x, FoldModel)).classes[0])
    out: list[list[Parts | str]] = [[r or "training rows hold 0 class(es)"] * len(settings) for r in reason]
    for r in fitted:
        if r["reason"] is not None:
            out[r["_fold"]] = [r["reason"]] * len(settings)
            continue
        names = [f"z_{i}" for i in range(len(r["centre"]))]
        model = FoldModel(names, [kind(c) for c in r["classes"]], r["centre"], r["spread"], np.array(r["coef"]).reshape(len(r["classes"]), -1), np.array(r["intercept"]), r["gradient"], 0)
        out[r["_fold"]][r["_setting"]] = ({m: usable[m][r["_fold"]] for m in markers}, model)
    return TwoLevels(markers, out, pooled)


LINE_MODEL = ["_fold", "_setting", "reason", "classes", "centre", "spread", "coef", "intercept", "gradient"]


def class_columns(scored: DataFrame, classes: int) -> DataFrame:
    return scored.withColumns({f"Class_{i}": F.get("agg", F.lit(i)) for i in range(classes)})


def long_probabilities(scored: DataFrame, markers: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, CellLines, True, source, class, p): ``agg`` for the line model, and the markers."""
    pairs = lambda a: F.transform(a, lambda p, i: F.struct(i.alias("class"), p.alias("p")))
    sources = F.array(F.struct(F.lit("agg").alias("source"), pairs(F.col("agg")).alias("c")), *[F.struct(F.lit(m).alias("source"), pairs(F.col("p")[j]).alias("c")) for j, m in enumerate(markers)])
    rows = scored.select(*keys, "CellLines", F.col("label").alias("True"), F.inline(sources))
    return rows.select(*keys, "CellLines", "True", "source", F.inline("c"))


def with_entropy(long: DataFrame, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """The same and the entropy-weighted mean over markers (source ``entropy``)."""
    fused = entropy_weighted(long.filter("source <> 'agg'").withColumnRenamed("source", "Antibody"), [*keys, "CellLines", "True"], classes)
    return long.unionByName(fused.withColumn("source", F.lit("entropy")).select(*long.columns))


def evaluation_of(scored: DataFrame, markers: Sequence[str], classes: int) -> DataFrame:
    long = with_entropy(long_probabilities(scored, markers), classes)
    return evaluation_table([long], classes, ["agg", "entropy", *markers])

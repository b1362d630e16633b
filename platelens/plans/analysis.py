"""Analysis facades: named in the parameters, run on a preprocessed screen."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from platelens.functions.metrics import binary_metrics
from platelens.functions.sizing import join_bounded, kept
from platelens.operators.joins import union_all
from platelens.plans import folds as fold_tables
from platelens.plans.balance import upsampled_lines
from platelens.plans.components import profile_components
from platelens.plans.fitters import FITTERS, FitResult, _map_params, _Task
from platelens.plans.scorers import SCORERS
from platelens.plans.twolevel import fit_two_levels, long_probabilities, with_entropy


class PCA:
    """Components of standardised mean profiles per well or other label."""

    def __init__(self, screen):
        self.screen, self.fitted = screen, None

    def fit(self, group: str = "ID") -> PCA:
        self.fitted = profile_components(self.screen.cells, self.screen.wells, group)
        return self

    def run(self) -> dict[str, DataFrame]:
        return {"tables": self.fit().fitted}


class MAP:
    """Phenotype scores: scorer and fitter named under ``analysis.MAP``; scores are always of held-out lines."""

    def __init__(self, screen):
        self.screen, self.params = screen, screen.params
        options = (screen.params.get("analysis") or {}).get("MAP")
        if options is None:
            raise ValueError("analysis.MAP is missing")
        model = options.get("model")
        name = model if isinstance(model, str) else next(iter(model))
        if name not in SCORERS:
            raise KeyError(f"unknown model {name}; known: {sorted(SCORERS)}")
        if options.get("fitter") not in FITTERS:
            raise KeyError(f"unknown fitter {options.get('fitter')}; known: {sorted(FITTERS)}")
        self.scorer, self.fitter = SCORERS[name], FITTERS[options["fitter"]]
        self.options = {} if isinstance(model, str) else dict(model[name] or {})
        self.seed = options.get("seed", 47)
        self.fitted: FitResult | dict[str, FitResult] | None = None

    def fit(self) -> MAP:
        self.fitted = self.fitter(self.screen, lambda: self.scorer(self.options, self.seed), self.params)
        return self

    def make_table(self) -> DataFrame:
        """Predictions; runs per mutation are stacked with ``ModelGenetics``."""
        if self.fitted is None:
            raise ValueError("call fit first")
        if isinstance(self.fitted, FitResult):
            return self.fitted.predicted
        shared = next(iter(self.fitted.values())).whole
        if shared is not None:
            return shared
        return union_all([r.predicted.withColumn("ModelGenetics", F.lit(m)) for m, r in self.fitted.items()])

    def run(self) -> dict[str, DataFrame]:
        return {"tables": self.fit().make_table()}


def parameter_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of settings, one row each; the axes are short lists."""
    names = list(axes)
    return spark.createDataFrame([tuple(v) for v in itertools.product(*axes.values())], names)


def stability(screen, params: Mapping, grid: Sequence[Mapping], replicates: int, positive: int = 1) -> DataFrame:
    """Metrics of every setting and replicate: (replicate, group, metric, value, settings...).

    Every replicate splits the lines in halves with its own seed, trains both ways and pools the held-out tables. All
    replicates and halves are folds of one run, and settings (of the line model) share its cell models, so the cells are
    read as often as for a single fold. ``Reason`` is null, or names the half that has no two classes to train on: metrics
    are then of the other model's held-out lines alone, and a replicate without any model has one row without metrics.
    """
    task = _Task.of(screen, params)
    spark, seed = task.wells.sparkSession, _map_params(params).get("seed", 47)
    kinds = dict(task.lines())
    halves: dict[tuple[int, int], list[str]] = {(rep, half): [] for rep in range(replicates) for half in (0, 1)}
    for r in fold_tables.replicate_halves(task.wells, replicates).filter("role = 'train'").select("rep", "half", "CellLines").collect():  # lines x replicates
        halves[r["rep"], r["half"]].append(r["CellLines"])
    folds = list(halves)
    trained = [upsampled_lines([(line, kinds[line]) for line in halves[f]], seed) for f in folds]
    fitted = fit_two_levels(task.train, task.features, trained, grid, seed, task.rows)
    for df in task.cached:
        df.unpersist()
    models = [own[0] for own in fitted.models]
    if all(isinstance(m, str) for m in models):
        raise ValueError("no replicate has two classes to train on")
    lost: dict[int, list[str]] = {rep: [] for rep in range(replicates)}
    for (rep, half), m in zip(folds, models, strict=True):
        if isinstance(m, str):
            lost[rep].append(f"half {half}: {m}")
    test = [(f, line, rep) for f, (rep, half) in enumerate(folds) for line in halves[rep, 1 - half]]
    held = spark.createDataFrame(test, "_fold int, CellLines string, _rep int")
    classes = max(len(m[1].classes) for m in models if not isinstance(m, str))
    scored = join_bounded(fitted.scored(), held, ["_fold", "CellLines"], rows=len(test))
    keys = ["_setting", "_rep"]
    long = with_entropy(long_probabilities(scored, fitted.markers, keys), classes, keys).filter(F.col("class") == positive)
    long = long.select(*keys, F.col("source").alias("group"), "True", F.col("p").alias("score"))
    metrics = binary_metrics(kept(long), [*keys, "group"])
    names = [(rep, s, *setting.values(), "; ".join(lost[rep]) or None) for rep in range(replicates) for s, setting in enumerate(grid)]
    like = parameter_grid(spark, **{k: [v] for k, v in grid[0].items()}).schema
    run = spark.createDataFrame(names, StructType([StructField("_rep", IntegerType()), StructField("_setting", IntegerType()), *like.fields, StructField("Reason", StringType())]))
    out = F.broadcast(run).join(metrics, keys, "left")
    return out.select((F.col("_rep") + 1).alias("replicate"), "group", "metric", "value", F.col("_rep").alias("random_seed"), *grid[0], "Reason")

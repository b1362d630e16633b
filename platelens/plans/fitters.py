"""Fitters: which lines train, which are predicted, and the folds of a run.

Logistic models and forests of one marker set are fitted for all folds (and all mutations) at once and scored in one scan
(``plans.manyfits``, ``plans.forest``). Of other models each fold is one distributed fit, so a loop runs on the driver over folds (lines or
halves), never over cells; a few folds run at a time (``analysis.MAP.parallelism``), as in cross-validation. The training cells are persisted across
the folds of a run (``analysis.MAP.persist: false`` reads them again instead); call ``FitResult.release`` when predictions
have been used. With ``data_loader.n_cells`` set, marker-set models train on a bounded seeded sample per line, so the cost
of a fit does not grow with the number of cells; predictions always use all cells.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from platelens.functions.hashing import hash_order
from platelens.functions.ordered import smallest_digests
from platelens.functions.sizing import join_bounded
from platelens.operators.joins import union_all
from platelens.operators.ordering import centre_at_half
from platelens.plans import folds as fold_tables
from platelens.plans.balance import line_draws, upsampled_lines
from platelens.plans.folds import SPORADIC, WILD_TYPE
from platelens.plans.labels import encode_labels, encode_wild_type_first
from platelens.plans.manyfits import TooFewClasses, member_table
from platelens.plans.scorers import MultiAntibody, Scorer, importance_table
from platelens.plans.twolevel import class_columns, fit_two_levels
from platelens.screen import MarkerScreens, Screen

FITTERS: dict[str, Callable] = {}


def fitter(fn: Callable) -> Callable:
    FITTERS[fn.__name__] = fn
    return fn


@dataclass
class FitResult:
    """``fitted`` models and the lines each was ``fitted_on``, ``predicted`` rows, feature importances per fold, scalers
    and training lines per fold. ``whole``: the table that holds the rows of all mutations of the run."""

    fitted: list = field(default_factory=list)
    fitted_on: list = field(default_factory=list)
    predicted: DataFrame | None = None
    importance: DataFrame | None = None
    scalers: list = field(default_factory=list)
    training_lines: list = field(default_factory=list)
    cached: list = field(default_factory=list)
    whole: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached cells of this run."""
        for df in self.cached:
            df.unpersist()


def _map_params(params: Mapping) -> Mapping:
    return (params.get("analysis") or {}).get("MAP") or {}


def _labels(screen: Screen, params: Mapping) -> DataFrame:
    """Wells with an integer ``label``: response map if given, else wild type first."""
    options = _map_params(params)
    loader = options.get("data_loader") or {}
    response = loader.get("response") or options.get("response") or "Mutations"
    response = response if isinstance(response, str) else response[0]
    mapping = (loader.get("response_map") or {}).get(response)
    wells = screen.wells.withColumn("label", F.col(response))
    if mapping is not None:  # a label without a code is an error: leave its wells out by a preprocessing step
        return encode_labels(wells.drop("label"), response, mapping)
    return encode_wild_type_first(wells, "label")


@dataclass
class _Task:
    """Labelled cells per marker, ready for folds: ``rows`` to predict, ``train`` to fit. Wells and cells are joined once and
    kept for the run; all markers of one table share that join."""

    rows: dict[str, DataFrame]
    train: dict[str, DataFrame]
    features: dict[str, list[str]]
    wells: DataFrame
    multi: bool
    cached: list[DataFrame]

    @classmethod
    def of(cls, screen, params: Mapping) -> _Task:
        multi = isinstance(screen, MarkerScreens)
        screens = screen if multi else {"_": screen}
        options = _map_params(params)
        bound = (options.get("data_loader") or {}).get("training_cells")
        limit = _training_cells(params) if multi or bound is not None else None
        draws = _draws(params) if multi and bound is None else None
        limit = None if draws is not None else limit
        cached: list[DataFrame] = []

        def held(df: DataFrame) -> DataFrame:
            if options.get("persist", True):
                cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df

        named = held(union_all([_labels(s, params).withColumn("_marker", F.lit(m)) for m, s in screens.items()]))
        short = named.select("ID", "CellLines", "Mutations", "label", "_marker")
        undivided = {m: s.undivided() for m, s in screens.items()}
        whole = next(iter(undivided.values()))
        if whole is not None and all(w is whole for w in undivided.values()):  # one join serves all markers
            told = held(join_bounded(whole.cells.drop("CellLines", "Mutations"), short, "ID", rows=whole.bounds().groups))
            rows = {m: told.filter(F.col("_marker") == m).drop("_marker") for m in screens}
        else:
            rows = {m: held(join_bounded(s.cells.drop("CellLines", "Mutations"), short.filter(F.col("_marker") == m).drop("_marker"), "ID", rows=s.bounds().groups))
                    for m, s in screens.items()}
        train = dict(rows)
        if limit is not None or draws is not None:
            for m in screens:
                if "cell_key" not in rows[m].columns:
                    raise ValueError("data_loader.n_cells draws cells by their cell_key, which these cells don't have")
                train[m] = held(line_draws(rows[m], *draws, options.get("seed", 47)) if draws is not None else _line_sample(rows[m], limit, options.get("seed", 47)))
        return cls(rows, train, {m: s.features for m, s in screens.items()}, named.drop("_marker"), multi, cached)

    def lines(self) -> list[tuple[str, str]]:
        """(line, mutation), sorted; one model is fitted per line, so the list is short by construction."""
        return sorted((r[0], r[1]) for r in fold_tables.lines_of(self.wells).collect())

    def training(self, lines: Sequence[str]) -> dict[str, DataFrame]:
        return {m: df.filter(F.col("CellLines").isin(*lines)) for m, df in self.train.items()}

    def part(self, lines: Sequence[str], inside: bool) -> dict[str, DataFrame]:
        hit = F.col("CellLines").isin(*lines)
        return {m: df.filter(hit if inside else ~hit) for m, df in self.rows.items()}


def _draws(params: Mapping) -> tuple[int, int] | None:
    """Cells drawn of every line, and how many times over: ``data_loader.n_cells`` and the model's ``train.n_epochs``."""
    n = (_map_params(params).get("data_loader") or {}).get("n_cells")
    return None if n is None else (int(n), _training_cells(params) // int(n))


def _training_cells(params: Mapping) -> int | None:
    """Cells of a line that training looks at, at most: ``data_loader.training_cells``, or else ``data_loader.n_cells``
    for each of ``train.n_epochs``. Without either, all cells train; ``n_cells`` without ``n_epochs`` is an error."""
    options = _map_params(params)
    loader = options.get("data_loader") or {}
    if loader.get("training_cells") is not None:
        return int(loader["training_cells"])
    n = loader.get("n_cells")
    if n is None:
        return None
    model = options.get("model")
    settings = next(iter(model.values())) if isinstance(model, Mapping) else {}
    epochs = ((settings or {}).get("train") or {}).get("n_epochs")
    if epochs is None:
        raise ValueError("data_loader.n_cells needs train.n_epochs, or set data_loader.training_cells")
    return int(n) * int(epochs)


def _line_sample(rows: DataFrame, limit: int, seed) -> DataFrame:
    """At most ``limit`` cells per line in seeded order; only (line, digest) is moved to find each line's cut."""
    digest = hash_order(F.col("cell_key"), seed)
    last = smallest_digests(rows.select("CellLines", digest.alias("_h")), ["CellLines"], "_h", [], limit)
    last = last.groupBy("CellLines").agg(F.max("_h").alias("_last"))
    return join_bounded(rows, last, "CellLines").filter(digest <= F.col("_last")).drop("_last")


def fit_split(task: _Task, make: Callable[[], Scorer], train: Sequence[str]):
    """Fit on the named lines, score all others; the scaler comes from the training lines alone."""
    model = make()
    fit_on, rest = task.training(train), task.part(train, False)
    if isinstance(model, MultiAntibody):
        model.fit(fit_on, task.features)
        return model, model.predict(rest)
    (only,) = task.features.values()
    model.fit(next(iter(fit_on.values())), only)
    keys = ["ID", "CellLines", "Mutations", "label"]
    return model, model.predict(next(iter(rest.values()))).drop(*[c for c in only if c not in keys])


def _holdout(lines: Sequence[tuple[str, str]], mutation: str | None, extra: Sequence[str]) -> set[str]:
    """Lines that never train: sporadic ones, the named ones and, for a single mutation, those of other mutations."""
    mine = {WILD_TYPE, mutation}
    out = {c for c, m in lines if m == SPORADIC} | set(extra)
    return out | ({c for c, m in lines if m not in mine} if mutation else set())


def run_parallel(spark, work: Callable, jobs: Sequence, params: Mapping) -> list:
    """Run independent fits a few at a time; results keep the order of the jobs."""
    width = max(1, min(int(_map_params(params).get("parallelism", 4)), len(jobs)))
    with ThreadPool(width) as workers:
        return workers.map(inheritable_thread_target(spark)(work), jobs, chunksize=1)


def _fit_all(task: _Task, make, trained: Sequence[Sequence[str]], params: Mapping) -> list:
    """(model, predictions) per fold. Predictions have a column ``Reason``: null, or why a row has no score. A fold
    whose training lines do not hold two classes has no model (None), and its lines come without scores."""
    def one(train: Sequence[str]):
        try:
            return fit_split(task, make, train)
        except TooFewClasses as e:
            return None, str(e)

    done = run_parallel(task.wells.sparkSession, one, trained, params)
    scored = next((rows for model, rows in done if model is not None), None)
    if scored is None:
        raise ValueError("no fold has two classes to train on")
    return [
        (model, rows.withColumn("Reason", F.lit(None).cast("string")) if model is not None else _unscored(task, train, scored, rows))
        for (model, rows), train in zip(done, trained, strict=True)
    ]


def _unscored(task: _Task, train: Sequence[str], like: DataFrame, reason: str) -> DataFrame:
    """The rows that a fold would have scored, in the columns of ``like``, with null scores and the reason."""
    if task.multi:
        rows = task.wells.filter(~F.col("CellLines").isin(*train)).select("CellLines", F.col("label").alias("True")).distinct()
    else:
        rows = next(iter(task.part(train, False).values()))
    given = [c for c in ("ID", "cell_key", "CellLines", "Mutations", "label", "True") if c in rows.columns]
    return rows.select(
        *[F.col(c) if c in given else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns],
        F.lit(reason).alias("Reason"),
    )


def _record(result: FitResult, model, lines: Sequence[str]):
    result.fitted.append(model)
    result.fitted_on.append(list(lines))
    result.scalers.append(_scaler_of(model))
    return model.importance()


def _scaler_of(model) -> dict | None:
    if isinstance(model, MultiAntibody):
        return {m: (c.centre, c.spread) for m, c in model.cell_models.items()}
    return {"_": (model.centre, model.spread)} if hasattr(model, "centre") else None


@dataclass
class _Fold:
    """Training lines of one model, and what its rows are named by."""

    names: dict
    lines: list[str]


def _one_out_folds(task: _Task, params, mutation, holdout) -> list[_Fold]:
    lines = task.lines()
    held = _holdout(lines, mutation, holdout)
    pool = [c for c, _ in lines if c not in held]
    return [_Fold({"Holdout": line}, [c for c in pool if c != line]) for line in pool]


def _half_folds(task: _Task, params, mutation, holdout) -> list[_Fold]:
    options = _map_params(params)
    reps, seed = int(options.get("reps", 1)), options.get("seed", 47)
    held = _holdout(task.lines(), mutation, holdout)
    table = fold_tables.reciprocal_halves(task.wells, reps, seed, sorted(held))
    chosen = table.filter(F.col("role") == "train").select("rep", "half", "CellLines").collect()
    return [_Fold({"Rep": rep, "Half": half}, sorted(r["CellLines"] for r in chosen if (r["rep"], r["half"]) == (rep, half)))
            for rep in range(reps) for half in (0, 1)]


def _result(folds: Sequence[_Fold], models: Sequence, predicted: DataFrame, task: _Task) -> FitResult:
    by_line = all("Holdout" in fold.names for fold in folds)
    result = FitResult(training_lines=[f.names["Holdout"] for f in folds] if by_line else [f.lines for f in folds], predicted=predicted, cached=task.cached)
    importances = {}
    for fold, model in zip(folds, models, strict=True):
        if model is not None:
            importances["-".join(map(str, fold.names.values()))] = _record(result, model, fold.lines)
    if any(importances.values()):
        result.importance = importance_table(task.wells.sparkSession, importances)
    return result


def _run_folds(task: _Task, make, params, folds: Sequence[_Fold]) -> FitResult:
    """One model after another, a few at a time."""
    parts, models = [], []
    for fold, (model, predicted) in zip(folds, _fit_all(task, make, [f.lines for f in folds], params), strict=True):
        if model is not None and "Half" in fold.names and "Ypred" in predicted.columns and not task.multi:
            predicted = centre_at_half(predicted.withColumn("_s", F.lit(0)), ["_s"], "Ypred").drop("_s")
        parts.append(predicted.withColumns({n: F.lit(v) for n, v in fold.names.items()}))
        models.append(model)
    return _result(folds, models, union_all(parts), task)


def _fit_at_once(task: _Task, make, folds: Sequence[_Fold]) -> tuple[list, DataFrame]:
    """Models of all folds (None without two classes), and the table of all predictions: each fold scores the lines that
    it did not train on. One scan of the cells, whatever the number of folds."""
    spark, like = task.wells.sparkSession, make()
    (marker, rows), = task.rows.items()
    found = like.fit_many(task.train[marker], task.features[marker], [f.lines for f in folds])
    models = [None if isinstance(m, str) else make().take(m) for m in found]
    if not any(models):
        raise ValueError("no fold has two classes to train on")
    table, bound = member_table(spark, [f.lines for f in folds])
    none = F.lit(bytearray((len(folds) + 7) // 8))
    told = join_bounded(rows, table, "CellLines", "left", rows=bound).withColumn("member", F.coalesce("member", none))
    keep = [c for c in rows.columns if c not in task.features[marker] or c in ("ID", "CellLines", "Mutations", "label")]
    scored = like.score_many(told, found, "member", keep)
    names = [(f, *fold.names.values(), m if isinstance(m, str) else None) for f, (fold, m) in enumerate(zip(folds, found, strict=True))]
    schema = StructType([StructField("_fold", IntegerType()), *(StructField(n, IntegerType() if isinstance(v, int) else StringType()) for n, v in folds[0].names.items()), StructField("Reason", StringType())])
    named = join_bounded(scored, spark.createDataFrame(names, schema), "_fold", rows=len(names))
    if "Half" in folds[0].names and "Ypred" in named.columns:
        named = centre_at_half(named, ["_fold"], "Ypred")
    return models, named.drop("_fold")


def _two_levels(task: _Task, make, folds: Sequence[_Fold], params) -> FitResult:
    """Two-level models of all folds at once, and the held-out lines of each, highest Class_0 first."""
    like = make()
    kinds = dict(task.lines())
    seed = _map_params(params).get("seed", 47)
    trained = [upsampled_lines([(line, kinds[line]) for line in f.lines], seed) if like.options.get("upsample", True) else f.lines for f in folds]
    fitted = fit_two_levels(task.train, task.features, trained, [like.options], like.seed, task.rows)
    models = [None if isinstance(own[0], str) else make().take(own[0]) for own in fitted.models]
    if not any(models):
        raise ValueError("no fold has two classes to train on")
    spark = task.wells.sparkSession
    lines = task.wells.select("CellLines", F.col("label").alias("_label")).distinct()
    names = [(f, *fold.names.values(), own[0] if isinstance(own[0], str) else None) for f, (fold, own) in enumerate(zip(folds, fitted.models, strict=True))]
    schema = StructType([StructField("_fold", IntegerType()), *(StructField(n, IntegerType() if isinstance(v, int) else StringType()) for n, v in folds[0].names.items()), StructField("Reason", StringType())])
    mine = [(f, line) for f, fold in enumerate(folds) for line in fold.lines]
    named = spark.createDataFrame(names, schema)
    held = join_bounded(lines.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(len(folds) - 1)))), named, "_fold", rows=len(names))
    held = join_bounded(held, spark.createDataFrame(mine, "_fold int, CellLines string"), ["_fold", "CellLines"], "left_anti", rows=len(mine))
    classes = max(len(m.line_model.classes) for m in models if m is not None)
    scored = class_columns(fitted.scored(), classes).drop("p", "agg", "_setting")
    out = held.join(scored.withColumn("_scored", F.lit(True)), ["_fold", "CellLines"], "left").filter("_scored or Reason is not null")
    wide = out.select(*[f"Class_{i}" for i in range(classes)], "CellLines", F.coalesce("label", "_label").alias("True"), *folds[0].names, "Reason")
    return _result(folds, models, wide.orderBy(*folds[0].names, F.desc("Class_0")), task)


def _fold_run(plan: Callable[..., list[_Fold]], screen, make, params, holdout=()) -> FitResult:
    task = _Task.of(screen, params)
    folds = plan(task, params, None, holdout)
    if task.multi and isinstance(make(), MultiAntibody):
        return _two_levels(task, make, folds, params)
    if task.multi or not make().many:
        return _run_folds(task, make, params, folds)
    models, predicted = _fit_at_once(task, make, folds)
    return _result(folds, models, predicted, task)


def _per_mutation(plan: Callable[..., list[_Fold]], screen, make, params) -> dict[str, FitResult]:
    """A run for each mutation; the cells are prepared once, and folds of all mutations are fitted together if they can."""
    task = _Task.of(screen, params)
    folds = {m: plan(task, params, m, ()) for m in fold_tables.model_genetics(screen.wells)}
    if task.multi and isinstance(make(), MultiAntibody):
        return {m: _two_levels(task, make, own, params) for m, own in folds.items()}
    if task.multi or not make().many:
        return {m: _run_folds(task, make, params, own) for m, own in folds.items()}
    every = [_Fold({**f.names, "ModelGenetics": m}, f.lines) for m, own in folds.items() for f in own]
    models, predicted = _fit_at_once(task, make, every)
    out, at = {}, 0
    for m, own in folds.items():
        out[m] = _result(own, models[at : at + len(own)], predicted.filter(F.col("ModelGenetics") == m).drop("ModelGenetics"), task)
        out[m].whole = predicted
        at += len(own)
    return out


@fitter
def leave_one_out(screen, make, params, holdout=()) -> FitResult:
    """One fold per line outside the holdout; predicts that line and every holdout line."""
    return _fold_run(_one_out_folds, screen, make, params, holdout)


@fitter
def leave_one_out_mut(screen, make, params) -> dict[str, FitResult]:
    """Leave-one-out of each mutation against wild type; other mutations and sporadic lines are only predicted."""
    return _per_mutation(_one_out_folds, screen, make, params)


@fitter
def sample_split(screen, make, params, holdout=()) -> FitResult:
    """Reciprocal halves, repeated; each model predicts everything outside its training lines."""
    return _fold_run(_half_folds, screen, make, params, holdout)


@fitter
def sample_split_mut(screen, make, params) -> dict[str, FitResult]:
    """Reciprocal halves of each mutation against wild type."""
    return _per_mutation(_half_folds, screen, make, params)

"""Scoring models. A scorer is fitted on labelled cells and scores any cells.

User-defined scorers subclass :class:`Scorer` and register with :func:`scorer`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.operators.features import quoted
from platelens.plans.forest import Forest, fit_forests, score_forests
from platelens.plans.manyfits import FoldModel, TooFewClasses, fit_folds, score_folds
from platelens.plans.twolevel import TwoLevels, class_columns, evaluation_of, fit_two_levels

SCORERS: dict[str, type] = {}


def scorer(cls: type) -> type:
    SCORERS[cls.__name__] = cls
    return cls


class Scorer:
    """``options``: settings of this model. ``fit`` takes rows with ``label`` and the feature columns.

    ``many``: the model has ``fit_many`` and ``score_many``, which fit all folds of a run together and score them in one scan."""

    many = False

    def __init__(self, options: Mapping | None = None, seed: int = 47):
        self.options, self.seed = dict(options or {}), seed

    def fit(self, rows: DataFrame, features: Sequence[str]) -> Scorer:
        raise NotImplementedError

    def predict(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def importance(self) -> list[tuple[str, float]] | None:
        return None


@scorer
class Logistic(Scorer):
    """Multinomial logistic regression: balance, standardise, fit. Output ``Ypred0..k`` per row.

    ``C`` is the inverse strength against the summed loss. Fold runners fit all folds at once (``plans.manyfits``).
    """

    many = True

    def fit(self, rows: DataFrame, features: Sequence[str]) -> Logistic:
        (model,) = fit_folds(rows, features, None, self.options, self.seed)
        return self.take(model)

    def take(self, model: FoldModel | str) -> Logistic:
        """Become a fitted model."""
        if isinstance(model, str):
            raise TooFewClasses(model)
        self.model, self.features, self.classes, self.centre, self.spread = model, model.features, model.classes, model.centre, model.spread
        return self

    def fit_many(self, rows: DataFrame, features: Sequence[str], folds: Sequence[Sequence[str]]) -> list[FoldModel | str]:
        return fit_folds(rows, features, folds, self.options, self.seed)

    def score_many(self, rows: DataFrame, models: Sequence[FoldModel | str], member: str, keep: Sequence[str]) -> DataFrame:
        classes = max(len(m.classes) for m in models if isinstance(m, FoldModel))
        return score_folds(rows, models, member, keep).select("_fold", *[quoted(c) for c in keep], *self.score_columns(classes))

    def _probabilities(self, rows: DataFrame, logits: bool = False) -> DataFrame:
        return score_folds(rows, [self.model], logits=logits).drop("_fold")

    def predict(self, rows: DataFrame) -> DataFrame:
        cols = [F.col("_p")[i].alias(f"Ypred{i}") for i in range(len(self.classes))]
        return self._probabilities(rows).select(*[quoted(c) for c in rows.columns], *cols)

    def logits(self, rows: DataFrame) -> DataFrame:
        """Rows with arrays ``_p`` and ``_z`` in class order."""
        return self._probabilities(rows, logits=True)

    def score_columns(self, classes: int) -> list[Column]:
        """The scores of this kind of model from the array ``_p`` of at most so many classes."""
        return [F.get("_p", F.lit(i)).alias(f"Ypred{i}") for i in range(classes)]

    def coefficients(self) -> list[list[float]]:
        return self.model.coef.tolist()

    def importance(self) -> list[tuple[str, float]]:
        """First row of coefficients, largest first; with two classes, the contrast of the second to the first."""
        rows = self.coefficients()
        row = [b - a for a, b in zip(rows[0], rows[1], strict=True)] if len(rows) == 2 else rows[0]
        return sorted(zip(self.features, row, strict=True), key=lambda kv: -kv[1])


@scorer
class BinaryLogistic(Logistic):
    """Only the probability of the second class seen in training, as ``Ypred``."""

    def predict(self, rows: DataFrame) -> DataFrame:
        return super().predict(rows).withColumnRenamed("Ypred1", "Ypred").select(*rows.columns, "Ypred")

    def score_columns(self, classes: int) -> list[Column]:
        return [F.get("_p", F.lit(1)).alias("Ypred")]


@scorer
class RandomForest(Scorer):
    """Random forest (``plans.forest``); ``Ypred`` is the predicted class label. Trees end at pure nodes unless
    ``max_depth`` is set."""

    many = True

    def fit(self, rows: DataFrame, features: Sequence[str]) -> RandomForest:
        (model,) = fit_forests(rows, features, None, self.options, self.seed)
        return self.take(model)

    def take(self, model: Forest | str) -> RandomForest:
        """Become a fitted model."""
        if isinstance(model, str):
            raise TooFewClasses(model)
        self.model, self.features, self.classes = model, model.features, model.classes
        return self

    def fit_many(self, rows: DataFrame, features: Sequence[str], folds: Sequence[Sequence[str]]) -> list[Forest | str]:
        return fit_forests(rows, features, folds, self.options, self.seed)

    def score_many(self, rows: DataFrame, models: Sequence[Forest | str], member: str, keep: Sequence[str]) -> DataFrame:
        return score_forests(rows, models, member, keep).select("_fold", *[quoted(c) for c in keep], F.col("_class").alias("Ypred"))

    def predict(self, rows: DataFrame) -> DataFrame:
        return score_forests(rows, [self.model]).select(*[quoted(c) for c in rows.columns], F.col("_class").alias("Ypred"))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.importances.tolist(), strict=True), key=lambda kv: -kv[1])


@scorer
class BinaryRandomForest(RandomForest):
    """The same forest for two classes."""


@scorer
class MultiAntibody(Scorer):
    """Two-level scorer over marker sets.

    Level 1: one multinomial logistic model of cells per marker. Pooling: mean cell logits per line and marker,
    concatenated over markers in sorted order. Level 2: logistic model of lines on the pooled vector. This is a
    linear re-design for Spark; it does not claim the scores of a neural network.

    Training cells may come with ``copies`` (``balance.line_draws``: as many draws of every line), and a fold may name a
    line more than once (``balance.upsampled_lines``: as many lines of every class); both count as weights.
    """

    def fit(self, rows: Mapping[str, DataFrame], features: Mapping[str, Sequence[str]]) -> MultiAntibody:
        (model,) = fit_two_levels(rows, features, None, [self.options], self.seed).models[0]
        return self.take(model)

    def take(self, parts: tuple[dict[str, FoldModel], FoldModel] | str) -> MultiAntibody:
        """Become a fitted scorer of these models."""
        if isinstance(parts, str):
            raise TooFewClasses(parts)
        cells, line = parts
        self.markers = sorted(cells)
        self.cell_models = {m: Logistic({}, self.seed).take(cells[m]) for m in self.markers}
        self.classes, self.line_features = self.cell_models[self.markers[0]].classes, line.features
        self.line_model = Logistic({}, self.seed).take(line)
        return self

    def scored(self, rows: Mapping[str, DataFrame]) -> DataFrame:
        """The lines of ``rows`` as ``TwoLevels.scored`` gives them."""
        return TwoLevels(self.markers, [[(({m: c.model for m, c in self.cell_models.items()}), self.line_model.model)]]).scored(rows)

    def predict(self, rows: Mapping[str, DataFrame]) -> DataFrame:
        """``Class_i``, ``CellLines``, ``True``, highest Class_0 first."""
        return class_columns(self.scored(rows), len(self.line_model.classes)).select(
            *[f"Class_{i}" for i in range(len(self.line_model.classes))], "CellLines", F.col("label").alias("True")).orderBy(F.desc("Class_0"))

    def evaluate(self, rows: Mapping[str, DataFrame]) -> DataFrame:
        """Evaluation table: line-level, entropy-weighted and per-marker probabilities side by side."""
        return evaluation_of(self.scored(rows), self.markers, len(self.classes))


def importance_table(spark, per_fold: Mapping[str, list[tuple[str, float]]]) -> DataFrame:
    """(fold, feature, value); as many rows as fitted coefficients."""
    rows = [(f, n, float(v)) for f, pairs in per_fold.items() if pairs for n, v in pairs]
    return spark.createDataFrame(rows, "fold string, feature string, value double")


def with_labels(cells: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """Cells with the label of their well."""
    return join_bounded(cells, labels, "ID", rows=rows)

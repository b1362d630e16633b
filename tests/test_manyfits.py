"""Many folds at once: equal to one fit per fold by the distributed solver, in turns and in trees; forests against plain walks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from platelens import Screen
from platelens.plans import balance, forest, manyfits
from platelens.plans.analysis import MAP

FEATURES = ["a", "b.c", "d"]
LINES = {"WT0": 0, "WT1": 0, "WT2": 0, "FUS0": 1, "FUS1": 1, "SOD0": 2, "SOD1": 2}


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    rows = []
    for line, label in LINES.items():
        for i in range(int(rng.integers(30, 90))):
            x = rng.normal(size=3) * [1, 200, 0.01] + [0.6 * label, 5000 - 60 * label, 0]
            rows.append((line, f"{line}:{i}", label, *map(float, x)))
    df = spark.createDataFrame(rows, "CellLines string, cell_key string, label long, a double, `b.c` double, d double")
    return df.repartition(3).persist()


FOLDS = [[c for c in LINES if c != out] for out in LINES] + [["WT0", "WT1", "FUS0"], ["WT0", "FUS1"], ["FUS0", "FUS1"], []]


def one_by_one(rows, options, k):
    """The same model of one fold by the distributed solver."""
    if options.get("balance", "down") == "down":
        rows = balance.balanced_rows(rows, "label", "down", 47)
    pdf = rows.toPandas()
    x, classes = pdf[FEATURES].to_numpy(), sorted(set(pdf["label"]))
    assert len(classes) == k
    part = [x[pdf["label"] == c] for c in classes]
    centre = np.mean([p.mean(0) for p in part], axis=0)
    spread = np.sqrt(np.mean([p.var(0) + (p.mean(0) - centre) ** 2 for p in part], axis=0))
    most = max(map(len, part))
    scaled = pd.DataFrame((x - centre) / spread, columns=["x0", "x1", "x2"]).assign(y=[float(classes.index(c)) for c in pdf["label"]], w=[most / len(part[classes.index(c)]) for c in pdf["label"]])
    data = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="x").transform(rows.sparkSession.createDataFrame(scaled))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", family="multinomial", regParam=1 / (options.get("C", 1.0) * most * k), standardization=False, maxIter=1000, tol=1e-14).fit(data)
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray(), centre, spread


@pytest.mark.parametrize("options", [{}, {"balance": "weights", "C": 0.1}, {"C": 20.0}])
def test_folds_at_once_equal_one_fit_each(cells, options, monkeypatch):
    found = manyfits.fit_folds(cells, FEATURES, FOLDS, options)
    assert found[-1] == "training rows hold 0 class(es)" and found[-2] == "training rows hold 1 class(es)"
    for lines, model in list(zip(FOLDS, found, strict=True))[:: 3 if options else 2]:
        if isinstance(model, str):
            continue
        coef, intercept, centre, spread = one_by_one(cells.filter(F.col("CellLines").isin(*lines)), options, len(model.classes))
        np.testing.assert_allclose(model.centre, centre, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(model.spread, spread, rtol=1e-9)
        np.testing.assert_allclose(model.coef, coef, atol=1e-6)
        np.testing.assert_allclose(model.intercept, intercept - intercept.mean(), atol=1e-6)
        assert model.gradient < 1e-8
    monkeypatch.setattr(manyfits, "NUMBERS", 60)  # folds take turns
    monkeypatch.setattr(manyfits, "TREE", 1)  # sums in two levels
    again = manyfits.fit_folds(cells, FEATURES, FOLDS[:3], options)
    for a, b in zip(found, again, strict=False):
        np.testing.assert_allclose(a.coef, b.coef, atol=1e-9)


def test_separable_folds_converge(spark):
    rows = [(f"L{i % 4}", f"k{i}", i % 2, float(i % 2) * 8 + 0.01 * i, 7.0) for i in range(80)]
    df = spark.createDataFrame(rows, "CellLines string, cell_key string, label long, x double, same double")
    (model,) = manyfits.fit_folds(df, ["x", "same"], None, {"C": 1e4})
    assert model.gradient < 1e-8 and abs(model.coef[0, 1]) < 1e-9 and model.steps < 60


def test_cuts_keep_the_first_of_each_class(cells):
    table, bound = manyfits.member_table(cells.sparkSession, FOLDS)
    packed = manyfits.pack(cells.join(table, "CellLines"), FEATURES, [0, 1, 2], 47, [0.0] * 3, [1.0] * 3, len(FOLDS))
    sizes = manyfits.class_sizes(packed, 3)
    for most in (None, 5):
        cut = manyfits.class_cuts(packed, sizes, most)
        blocks = [r for batch in packed.blocks.toArrow().to_batches() for r in manyfits.read_blocks(batch, len(FOLDS))]
        pdf = pd.concat([pd.DataFrame({"y": r.y, "o": r.o, "folds": list(r.times[r.pattern])}) for r in blocks])
        for f, lines in enumerate(FOLDS):
            own = pdf[[m[f] == 1 for m in pdf["folds"]]]
            sized = own.groupby("y").size()
            least = min([*sized, most or 10**9]) if len(sized) else 0
            for c, part in own.groupby("y"):
                assert sorted(part["o"])[:least] == sorted(o for o in part["o"] if o <= cut[f][c])


def test_all_folds_are_scored_in_one_scan(spark, cells):
    wells = spark.createDataFrame([(f"w-{c}", c, {0: "WT", 1: "FUS", 2: "SOD1"}[m]) for c, m in LINES.items()] + [("w-s", "s0", "sporadic")], "ID string, CellLines string, Mutations string")
    rows = cells.withColumn("ID", F.concat(F.lit("w-"), "CellLines")).drop("CellLines", "label")
    rows = rows.union(rows.limit(9).withColumn("ID", F.lit("w-s")).withColumn("cell_key", F.concat(F.lit("s"), "cell_key")))
    for model in ("BinaryLogistic", "RandomForest"):
        options = {"model": {model: {} if model == "BinaryLogistic" else {"n_estimators": 4}}, "fitter": "leave_one_out_mut", "seed": 47, "persist": False}
        fit = MAP(Screen(rows, wells, {"analysis": {"MAP": options}})).fit()
        table = fit.make_table()
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
        got = table.toPandas()
        for m, n in (("FUS", 5), ("SOD1", 5)):
            own = got[got["ModelGenetics"] == m]
            assert set(own["Holdout"]) == {c for c in LINES if c[:3] in ("WT" + c[2:3], m[:3])} and own["Holdout"].nunique() == n
            for line, part in own.groupby("Holdout"):
                assert set(part["CellLines"]) == {line, "s0", *(c for c in LINES if not c.startswith(("WT", m[:3])))}
        assert got["Reason"].isna().all() and got["Ypred"].notna().all()


# --- forests


def gini(counts):
    n = counts.sum()
    return n - (counts**2).sum() / n if n else 0.0


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 200), rng.normal(size=200).round(1), rng.normal(size=200)])
    y = rng.integers(0, 3, 200)
    code, values = forest.ranked(x)
    for criterion in ("gini", "entropy"):
        tree, falls, wrong = forest.grow(code, values, y, 3, np.random.default_rng(0), {"max_features": None, "bootstrap": False, "criterion": criterion, "min_samples_leaf": 2, "max_depth": 6})
        rows = {0: np.arange(200)}
        for node in range(len(tree.feature)):
            at, f = rows[node], tree.feature[node]
            assert np.array_equal(tree.counts[node], np.bincount(y[at], minlength=3))
            best = 0.0
            for j in range(3):
                for t in np.unique(x[at, j])[:-1]:
                    left, right = np.bincount(y[at][x[at, j] <= t], minlength=3), np.bincount(y[at][x[at, j] > t], minlength=3)
                    if min(left.sum(), right.sum()) >= 2:
                        fall = [forest.impurity(np.array([c], dtype=float), criterion)[0] for c in (tree.counts[node], left, right)]
                        best = max(best, fall[0] - fall[1] - fall[2])
            if f < 0:
                continue
            go = x[at, f] > tree.threshold[node]
            rows[tree.left[node]], rows[tree.left[node] + 1] = at[~go], at[go]
            own = [forest.impurity(tree.counts[c][None], criterion)[0] for c in (node, tree.left[node], tree.left[node] + 1)]
            assert own[0] - own[1] - own[2] == pytest.approx(best) or best == 0.0
        assert falls.sum() == pytest.approx(1)


def test_gini_of_counts():
    counts = np.array([[3.0, 1.0], [0.0, 5.0], [2.0, 2.0]])
    np.testing.assert_allclose(forest.impurity(counts, "gini"), [gini(c) for c in counts])


def walk(tree, row):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.left[node] + (row[tree.feature[node]] > tree.threshold[node])
    return tree.counts[node] / tree.counts[node].sum()


def test_forests_of_folds(cells):
    found = forest.fit_forests(cells, FEATURES, FOLDS[:2] + [[]], {"n_estimators": 7}, 47)
    assert found[2] == "training rows hold 0 class(es)"
    alone = forest.fit_forests(cells.filter(F.col("CellLines").isin(*FOLDS[0])).repartition(5), FEATURES, None, {"n_estimators": 7}, 47)[0]
    assert [t.threshold.tolist() for t in alone.trees] == [t.threshold.tolist() for t in found[0].trees]  # however cells are dealt
    assert found[0].wrong == [0] * 7 and found[0].importances.sum() == pytest.approx(1) and len({len(t.feature) for t in found[0].trees}) > 1
    table, _ = manyfits.member_table(cells.sparkSession, FOLDS[:2] + [[]])
    told = cells.join(table, "CellLines", "left").withColumn("member", F.coalesce("member", F.lit(bytearray(1))))
    scored = forest.score_forests(told, found, "member").toPandas()
    for f in (0, 1):
        own = scored[scored["_fold"] == f]
        assert set(own["CellLines"]) == set(LINES) - set(FOLDS[f])
        for _, r in own.head(40).iterrows():
            want = np.mean([walk(t, r[FEATURES].to_numpy(dtype=float)) for t in found[f].trees], axis=0)
            np.testing.assert_allclose(r["_p"], want)
            assert r["_class"] == found[f].classes[int(np.argmax(want))]
    none = scored[scored["_fold"] == 2]
    assert len(none) == len(told.toPandas()) and none["_p"].isna().all()


def test_forest_settings(cells):
    with pytest.raises(ValueError, match="unknown forest settings"):
        forest.fit_forests(cells, FEATURES, None, {"n_tree": 5})
    few = forest.fit_forests(cells, FEATURES, None, {"n_estimators": 2, "max_rows": 10, "max_depth": 1, "bootstrap": False})[0]
    assert all(len(t.feature) == 3 and t.counts[0].tolist() == [10, 10, 10] for t in few.trees)
    assert forest.features_tried("log2", 300) == 8 and forest.features_tried(0.5, 4) == 2 and forest.features_tried("sqrt", 300) == 17


def test_many_values_become_quantiles(monkeypatch):
    monkeypatch.setattr(forest, "CODES", 16)
    x = np.random.default_rng(1).normal(size=(500, 1))
    code, values = forest.ranked(x)
    assert len(values[0]) == 16 and (x[:, 0] <= values[0][code[:, 0]]).all()
    below = np.array([4])
    assert forest.between(values[0], below, below + 3)[0] == values[0][4]

"""Post-hoc statistics against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens.functions import metrics
from platelens.operators import aggregates, joins, ordering
from platelens.operators.figures import bar_table, heatmap_cells, heatmap_table, long_scores, scatter_table
from platelens.plans import attribution, conformal, correction, multiscreen
from platelens.plans.fusion import entropy_weighted


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(0)
    n = 40
    p = rng.dirichlet([1, 1, 1], size=n)
    return pd.DataFrame({
        "CellLines": [f"L{i:02d}" for i in range(n)], "Mutations": np.resize(["WT", "FUS", "SOD1", "sporadic"], n),
        "True": rng.integers(0, 3, n).astype("int32"), "Class_0": p[:, 0], "Class_1": p[:, 1], "Class_2": p[:, 2],
        "NCells": rng.integers(500, 1500, n),
    })


@pytest.fixture(scope="module")
def scores(spark, table):
    return spark.createDataFrame(table).persist()


def test_count_correction_equals_rank_deficient_ols(scores, table):
    x = np.column_stack([np.ones(len(table)), table["NCells"], pd.get_dummies(table["Mutations"]).to_numpy(float)])
    groups = sorted(set(table["Mutations"]))
    raw = {}
    for c in ("Class_0", "Class_1", "Class_2"):
        y = table[c].to_numpy()
        beta = np.linalg.pinv(x) @ y
        effect = table["Mutations"].map(dict(zip(groups, beta[2:], strict=True))).to_numpy()
        raw[c] = y - x @ beta + beta[0] + beta[1] * 1000 + effect
    got = correction.correct_score(scores).toPandas().set_index("CellLines").loc[table["CellLines"], "Score_corrected"]
    assert np.allclose(got, raw["Class_1"], atol=1e-9)
    e = np.exp(np.column_stack(list(raw.values())))
    soft = correction.correct_classes(scores).toPandas().set_index("CellLines").loc[table["CellLines"]]
    assert np.allclose(soft[[f"{c}_corrected" for c in raw]].to_numpy(), e / e.sum(1, keepdims=True), atol=1e-9)


def test_correction_without_variation_leaves_scores(spark):
    df = spark.createDataFrame([("a", "WT", 10, 0.2), ("b", "FUS", 20, 0.7)], "CellLines string, Mutations string, NCells int, Class_1 double")
    assert [r["Score_corrected"] for r in correction.correct_score(df).orderBy("CellLines").collect()] == [0.2, 0.7]


def test_conformal_against_direct(scores, table):
    p = table[["Class_0", "Class_1", "Class_2"]].to_numpy()
    nc = 1 - p[np.arange(len(p)), table["True"]]
    got = {r["quantile"]: r["threshold"] for r in conformal.thresholds(scores, [0.5, 0.9, 0.99]).collect()}
    n = len(nc)
    for q, t in got.items():
        assert t == pytest.approx(np.quantile(nc, min(1, q * (n + 1) / n)))
    sets = conformal.sets_split(scores, scores, 0.9).toPandas().set_index("CellLines").loc[table["CellLines"]]
    for i, (_, row) in enumerate(sets.iterrows()):
        assert list(row["PredictionSet"]) == [str(k) for k in range(3) if p[i, k] >= 1 - got[0.9]]
        assert row["Covered"] == (str(table["True"][i]) in row["PredictionSet"])
    assert sets["Covered"].mean() >= 0.9


def test_cross_conformal_uses_the_other_half(scores):
    out = conformal.sets_cross(scores, 0.8, 1)
    assert out.columns == ["CellLines", "True", "PredictionSet", "Covered"] and out.count() == 40
    halves = conformal.line_halves(scores, 1).groupBy("half").count().toPandas()
    assert sorted(halves["count"]) == [20, 20]
    again = conformal.sets_cross(scores.repartition(7), 0.8, 1)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    cov = conformal.coverage(out).first()
    assert 0 <= cov["coverage"] <= 1 and cov["mean_size"] <= 3


def test_simplex_grid(spark):
    grid = conformal.simplex_grid(spark, 3, 0.05).toPandas()
    assert len(grid) == 231 and np.allclose(grid.sum(1), 1) and not grid.duplicated().any()
    assert conformal.simplex_grid(spark, 2, 0.01).count() == 101
    assert len(conformal.simplex_grid(spark, 1, 0.5).collect()) == 1
    four = conformal.simplex_grid(spark, 4, 0.1)
    assert four.count() == math.comb(13, 3)


def test_regions_are_grid_points_above_threshold(spark, scores):
    limits = conformal.thresholds(scores, [0.75])
    t = limits.first()["threshold"]
    got = conformal.regions(limits, 3, 0.05).toPandas()
    grid = conformal.simplex_grid(spark, 3, 0.05).toPandas()
    for k in range(3):
        assert (got["class"] == k).sum() == (grid[f"Class_{k}"] >= 1 - t - 1e-12).sum()
    none = conformal.regions(limits.withColumn("threshold", F.lit(-0.5)), 3, 0.05)
    assert none.count() == 0


def test_entropy_weights(spark):
    rows = [("a", "m1", 0, 1.0), ("a", "m1", 1, 0.0), ("a", "m2", 0, 0.5), ("a", "m2", 1, 0.5),
            ("b", "m1", 0, 0.5), ("b", "m1", 1, 0.5), ("b", "m2", 0, 0.5), ("b", "m2", 1, 0.5)]
    df = spark.createDataFrame(rows, "CellLines string, Antibody string, class int, p double")
    got = {(r["CellLines"], r["class"]): r["p"] for r in entropy_weighted(df, ["CellLines"], 2).collect()}
    assert got[("a", 0)] == pytest.approx(1.0, abs=1e-6) and got[("b", 0)] == pytest.approx(0.5)


def test_binary_metrics_and_missing_class(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    rows = [("g", int(a), float(b)) for a, b in zip(y, s, strict=True)] + [("one", 1, 0.4), ("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "group string, `True` int, score double")
    got = {(r["group"], r["metric"]): r["value"] for r in metrics.binary_metrics(df, ["group"]).collect()}
    assert got[("g", "accuracy")] == pytest.approx(((s > 0.5) == y).mean())
    c = np.clip(s, 1e-15, 1 - 1e-15)
    assert got[("g", "cross_entropy")] == pytest.approx(-(y * np.log(c) + (1 - y) * np.log(1 - c)).mean())
    assert got[("one", "auc")] is None and got[("one", "accuracy")] == 0.0


def test_marker_of_result(spark):
    df = spark.createDataFrame([("binary-COX IV-Gal-3-488",), ("binary-FUS-EEA1-647",), ("other",)], "file string")
    got = {r["file"]: r["Marker"] for r in metrics.marker_of_result(df).collect()}
    assert got == {"binary-COX IV-Gal-3-488": "3", "binary-FUS-EEA1-647": "FUS"}


def test_figure_tables(scores):
    names = {0: "WT", 1: "FUS", 2: "SOD1"}
    long = long_scores(scores, names)
    assert long.count() == 120 and set(long.toPandas()["ModelGenetics"]) == set(names.values())
    assert set(long_scores(scores).toPandas()["ModelGenetics"]) == {"0", "1", "2"}
    bars = bar_table(scores, names).toPandas()
    own = bars[bars["TrueClass"] == bars["PredictedClass"]]
    assert len(own) == 40 and np.allclose(own["Probability"], own["TrueClassProb"])
    flat = heatmap_cells(long).toPandas()
    assert flat["value"].min() == 0 and flat["value"].max() == 1
    assert heatmap_table(long, False).count() == 3
    flat_row = ordering.scale_rows(long.withColumn("Class_1", F.lit(0.2)))
    assert set(flat_row.toPandas()["Class_1_scaled"]) == {0.5}
    spots = scatter_table(long).toPandas()
    assert set(spots[spots["Mutations"] == "WT"]["mutation_position"]) == {0.0}
    assert set(spots[spots["Mutations"] == spots["ModelGenetics"]]["mutation_position"]) <= {0.0, 0.2}
    order = ordering.order_lines(long).toPandas()
    assert len(order) == 40


def test_medians_and_mode(spark, scores, table):
    med = aggregates.scores_by_line(scores.withColumn("CellLines", F.col("Mutations")), "median").toPandas()
    want = table.groupby("Mutations")["Class_1"].median()
    assert np.allclose(med.set_index("CellLines")["Class_1"].loc[want.index], want)
    with pytest.raises(ValueError):
        aggregates.scores_by_line(scores, "nonsense")
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "CellLines string, `True` int")
    assert {r["CellLines"]: r["True"] for r in aggregates.most_common(df, ["CellLines"], "True").collect()} == {"a": 1, "b": 5}


def test_checked_join_fails_on_missing_well(spark):
    cells = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "ID string, x double")
    wells = spark.createDataFrame([("a", "L1")], "ID string, CellLines string")
    with pytest.raises(Exception, match="complete well row"):
        joins.cells_with_wells_checked(cells, wells).collect()
    looked = joins.look_up(cells, {"a": "one"}, "ID", "v").orderBy("ID").collect()
    assert [r["v"] for r in looked] == ["one", None]


def test_attributions(spark):
    means = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 4.0)], "CellLines string, feature string, mean double")
    coefs = spark.createDataFrame([("a", "x", 10.0), ("b", "x", 20.0), ("c", "x", 60.0)], "Holdout string, feature string, coef double")
    fast = attribution.linear_train_eval(means, coefs).orderBy("CellLines").collect()
    full = coefs.join(means, "feature").select("Holdout", "CellLines", "feature", (F.col("mean") * F.col("coef")).alias("value"))
    slow = attribution.train_eval_attributions(full).orderBy("CellLines").collect()
    assert [(r["eval"], r["train"]) for r in fast] == [(r["eval"], r["train"]) for r in slow] == [(10, 40), (40, 70), (240, 60)]
    alone = attribution.train_eval_attributions(full.filter("Holdout = 'a' and CellLines = 'a'")).first()
    assert alone["train"] == 0.0


def test_alignment_removes_screen_shift(spark):
    rng = np.random.default_rng(5)
    rows, wells = [], []
    for s, shift, scale in (("S1", 0.0, 1.0), ("S2", 8.0, 3.0)):
        for j in range(4):
            well = f"{s}-L{j}"
            wells.append((well, f"L{j}", "WT", s))
            x = (rng.normal(size=(30, 3)) * 0.1 + np.eye(4)[j][:3] * 2) * scale + shift
            rows += [(well, *map(float, r)) for r in x]
    cells = spark.createDataFrame(rows, "ID string, a double, b double, c double")
    meta = spark.createDataFrame(wells, "ID string, CellLines string, Mutations string, Screen string")

    def distance(aligner):
        out = aligner.fit_transform(cells, meta)
        means = multiscreen.line_means(out, [c for c in out.columns if c.startswith("aligned")])
        return multiscreen.screen_distances(means).first()["distance"]

    assert distance(multiscreen.ScreenAligner()) < 0.05 < distance(multiscreen.ScreenAligner(per_screen=False))
    fitted = multiscreen.ScreenAligner().fit(cells.filter("ID like 'S1%'"), meta)
    assert fitted.transform(cells, meta).count() == 240

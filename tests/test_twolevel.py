"""Draws, up-sampled lines and two-level folds: weights equal rows written out, folds at once equal one at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens import MarkerScreens
from platelens.plans import balance, folds, manyfits
from platelens.plans.analysis import MAP, stability
from platelens.plans.fitters import _Task
from platelens.plans.scorers import MultiAntibody
from platelens.plans.twolevel import fit_two_levels

GROUPS = {"WT": 4, "FUS": 4, "SOD1": 2, "sporadic": 1}
LINES = [(f"{m}{j}", m) for m, n in GROUPS.items() for j in range(n)]


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(1)
    cells, wells = [], []
    for line, m in LINES:
        for marker in ("M1", "M2"):
            wells.append((f"{marker}-{line}", line, m, marker))
            x = rng.normal(size=(int(rng.integers(5, 40)), 3)) + [{"WT": 0.0, "FUS": 1.0, "SOD1": -1.0, "sporadic": 0.5}[m], 0.0, 0.0]
            cells += [(f"{marker}-{line}", f"{marker}-{line}:{i}", *map(float, r)) for i, r in enumerate(x)]
    c = spark.createDataFrame(cells, "ID string, cell_key string, a double, b double, c double").persist()
    w = spark.createDataFrame(wells, "ID string, CellLines string, Mutations string, Antibody string").persist()
    mapping = {"WT": 0, "FUS": 1, "SOD1": 1, "sporadic": 1}
    options = {"model": {"MultiAntibody": {"train": {"n_epochs": 2}}}, "fitter": "sample_split", "seed": 47, "response": "Mutations", "data_loader": {"response_map": {"Mutations": mapping}, "n_cells": 6}}
    return MarkerScreens.split(c, w, {"analysis": {"MAP": options}})


def test_every_line_counts_alike(parts):
    task = _Task.of(parts, parts.params)
    for m in ("M1", "M2"):
        pdf = task.train[m].groupBy("CellLines").agg(F.sum("copies").alias("n"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.count(F.lit(1)).alias("cells")).toPandas()
        have = task.rows[m].groupBy("CellLines").count().toPandas().set_index("CellLines")["count"]
        assert (pdf["n"] == 12).all() and (pdf["most"] - pdf["least"] <= 1).all()
        assert (pdf["cells"].to_numpy() == np.minimum(have[pdf["CellLines"]].to_numpy(), 12)).all()
    for df in task.cached:
        df.unpersist()


def test_draws_follow_the_seeded_order(spark):
    df = spark.createDataFrame([("L", f"k{i}") for i in range(5)], "CellLines string, cell_key string")
    order = [r.cell_key for r in df.orderBy(F.md5(F.concat_ws("|", "cell_key", F.lit("9")))).collect()]
    assert {r.cell_key: r.copies for r in balance.line_draws(df, 3, 4, 9).collect()} == {k: 2 + (i < 2) for i, k in enumerate(order)}
    assert {r.cell_key: r.copies for r in balance.line_draws(df, 3, 1, 9).collect()} == {k: 1 for k in order[:3]}
    assert {r.copies for r in balance.line_draws(df, 5, 2, 9).collect()} == {2}


def test_lines_are_upsampled_alike_on_driver_and_cluster(spark):
    df = spark.createDataFrame(LINES, "CellLines string, Mutations string")
    for seed in (1, 47):
        assert balance.upsampled_lines(LINES, seed) == sorted(r.CellLines for r in balance.upsample_lines(df, seed).collect())


def test_copies_equal_rows_written_out(parts):
    """Copies of cells and repeats of lines give the model of the rows repeated so often."""
    task = _Task.of(parts, parts.params)
    rows, features = task.train["M1"], ["a", "b", "c"]
    repeats = [["WT0", "WT0", "WT1", "FUS0", "SOD10", "SOD10", "SOD10"], ["WT2", "FUS1"]]
    found = manyfits.fit_folds(rows, features, repeats, {"balance": "weights"})
    for lines, model in zip(repeats, found, strict=True):
        times = F.element_at(F.create_map(*[x for line in set(lines) for x in (F.lit(line), F.lit(lines.count(line)))]), F.col("CellLines"))
        written = rows.filter(F.col("CellLines").isin(*lines)).withColumn("_r", F.explode(F.array_repeat(F.lit(0), (F.col("copies") * times).cast("int")))).drop("copies", "_r")
        (plain,) = manyfits.fit_folds(written, features, None, {"balance": "weights"})
        np.testing.assert_allclose(model.coef, plain.coef, atol=1e-8)
        np.testing.assert_allclose(model.centre, plain.centre, atol=1e-9)
    with pytest.raises(ValueError, match="balance 'weights'"):
        manyfits.fit_folds(rows, features, repeats, {})


def test_pooled_lines_are_means(parts):
    task = _Task.of(parts, parts.params)
    models = manyfits.fit_folds(task.rows["M1"].drop("copies"), ["a", "b", "c"], [["WT0", "FUS0"], [], ["WT1", "FUS1", "SOD10"]], {"balance": "weights"})
    pooled = manyfits.line_sums(task.rows["M1"], models).toPandas()
    cells = task.rows["M1"].toPandas()
    assert set(pooled["_fold"]) == {0, 2} and len(pooled) == 2 * len(LINES)
    for _, r in pooled.iterrows():
        raw, base = models[r["_fold"]].plain()
        z = cells[cells["CellLines"] == r["CellLines"]][["a", "b", "c"]].to_numpy() @ raw.T + base
        np.testing.assert_allclose(r["z"], z.mean(axis=0), atol=1e-9)
        np.testing.assert_allclose(r["p"], manyfits.softmax(z)[0].mean(axis=0), atol=1e-9)


def test_folds_and_settings_at_once_equal_one_at_a_time(parts):
    task = _Task.of(parts, parts.params)
    trained = [["WT0", "WT1", "FUS0", "FUS0", "SOD10"], ["WT2", "WT3", "FUS1"], ["WT0"]]
    settings = [{"C": 0.1}, {"C": 3.0}]
    many = fit_two_levels(task.train, task.features, trained, settings, 47, task.rows)
    assert many.models[2] == ["training rows hold 1 class(es)"] * 2
    for f in (0, 1):
        for s, setting in enumerate(settings):
            one = fit_two_levels(task.train, task.features, [trained[f]], [setting], 47, task.rows)
            np.testing.assert_allclose(one.models[0][0][1].coef, many.models[f][s][1].coef, atol=1e-7)
            assert many.models[f][s][1].gradient < 1e-8
            model = MultiAntibody(setting, 47).take(one.models[0][0])
            a = model.predict(task.rows).toPandas().set_index("CellLines").sort_index()
            b = many.scored().filter((F.col("_fold") == f) & (F.col("_setting") == s)).toPandas().set_index("CellLines").sort_index()
            np.testing.assert_allclose(a[["Class_0", "Class_1"]].to_numpy(), np.stack(b["agg"].to_list()), atol=1e-7)


def test_replicates_are_the_halves_of_their_seeds(parts):
    got = folds.replicate_halves(parts.wells, 3).toPandas()
    for rep in range(3):
        want = folds.reciprocal_halves(parts.wells, 1, rep).toPandas()
        keys = ["half", "CellLines", "role"]
        assert sorted(map(tuple, got[got["rep"] == rep][keys].to_numpy())) == sorted(map(tuple, want[keys].to_numpy()))


def test_stability_recomputed_from_the_scores(parts):
    """Metrics of a replicate equal those of the held-out tables of its two models."""
    grid = [{"C": 0.2}, {"C": 2.0}]
    out = stability(parts, parts.params, grid, replicates=3).toPandas()
    assert len(out) == 2 * 3 * 4 * 3 and out["Reason"].isna().all()
    task = _Task.of(parts, parts.params)
    halves = folds.reciprocal_halves(parts.wells, 1, 1).filter("role = 'train'").toPandas()
    sides = [sorted(halves[halves["half"] == h]["CellLines"]) for h in (0, 1)]
    kinds, tables = dict(LINES), []
    for train, test in (sides, sides[::-1]):
        lines = balance.upsampled_lines([(c, kinds[c]) for c in train], 47)
        own = fit_two_levels(task.train, task.features, [lines], [grid[1]], 47, task.rows)
        model = MultiAntibody(grid[1], 47).take(own.models[0][0])
        tables.append(model.evaluate(task.part(test, True)).toPandas())
    table = pd.concat(tables)
    for source in ("agg", "entropy", "M1", "M2"):
        p, y = table[f"class_1_{source}"].to_numpy(), table["True"].to_numpy()
        own = out[(out["replicate"] == 2) & (out["C"] == 2.0) & (out["group"] == source)].set_index("metric")["value"]
        won = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
        assert own["auc"] == pytest.approx(np.mean(won)) and own["accuracy"] == pytest.approx(((p > 0.5) == y).mean())
        assert own["cross_entropy"] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), abs=1e-6)


def test_two_level_fold_runner(parts):
    result = MAP(parts).fit().fitted
    out = result.predicted.toPandas()
    assert list(out.columns) == ["Class_0", "Class_1", "CellLines", "True", "Rep", "Half", "Reason"]
    for half, lines in enumerate(result.training_lines):
        assert set(out[out["Half"] == half]["CellLines"]) == {c for c, _ in LINES} - set(lines)
    assert np.allclose(out["Class_0"] + out["Class_1"], 1)
    result.release()

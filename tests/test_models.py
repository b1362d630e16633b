"""Folds, scorers and analyses on a small screen with a known signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens import MarkerScreens, Screen
from platelens.plans import balance, folds, labels, sufficient
from platelens.plans.analysis import MAP, PCA, stability
from platelens.plans.fitters import _Task, fit_split
from platelens.plans.scorers import SCORERS, BinaryLogistic, Logistic, MultiAntibody, Scorer, scorer
from platelens.sources.sinks import load_codes, load_model, save_codes, save_model

GROUPS = {"WT": 4, "FUS": 4, "SOD1": 2, "sporadic": 1}


def frames(seed=0, n=12):
    rng = np.random.default_rng(seed)
    cells, wells = [], []
    for m, count in GROUPS.items():
        for j in range(count):
            line = f"{m}{j}"
            for marker in ("M1", "M2"):
                well = f"{marker}-{line}"
                wells.append((well, line, m, marker, n))
                shift = {"WT": 0.0, "FUS": 3.0, "SOD1": -3.0, "sporadic": 1.0}[m]
                x = rng.normal(size=(n, 3)) + np.array([shift, 0.0, 0.0])
                cells += [(well, f"{well}:{i}", *map(float, row)) for i, row in enumerate(x)]
    return cells, wells


@pytest.fixture(scope="module")
def screen(spark):
    cells, wells = frames()
    c = spark.createDataFrame(cells, "ID string, cell_key string, f_a double, f_b double, g_c double")
    w = spark.createDataFrame(wells, "ID string, CellLines string, Mutations string, Antibody string, NCells int")
    return Screen(c.persist(), w.persist())


def with_params(screen, model, fitter, mapping=None, **extra):
    options = {"model": model, "fitter": fitter, "seed": 47, "response": "Mutations", **extra}
    if mapping:
        options["data_loader"] = {"response_map": {"Mutations": mapping}}
    return Screen(screen.cells, screen.wells, {"analysis": {"MAP": options}})


def only(screen, *mutations):
    return screen.keep_wells(screen.wells.filter(F.col("Mutations").isin(*mutations)))


def test_split_is_stratified_seeded_and_partition_free(screen, spark):
    first = folds.stratified_split(screen.wells, 0.5, 1).toPandas()
    per = first[first["split"] == "train"].groupby("Mutations").size().to_dict()
    assert per == {"WT": 2, "FUS": 2, "SOD1": 1}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = folds.stratified_split(screen.wells.repartition(5), 0.5, 1).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(map(tuple, first.values)) == set(map(tuple, again.values))
    assert set(map(tuple, first.values)) != set(map(tuple, folds.stratified_split(screen.wells, 0.5, 2).toPandas().values))


def test_halves_never_train_what_they_predict(screen):
    table = folds.reciprocal_halves(screen.wells, reps=2, seed=3).toPandas()
    assert set(table["role"]) == {"train", "predict"}
    assert (table[table["Mutations"] == "sporadic"]["role"] == "predict").all()
    trained = table[table["role"] == "train"].groupby(["rep", "CellLines"]).size()
    assert (trained == 1).all() and len(trained) == 2 * 10


def test_fold_tables(screen):
    meta = screen.wells
    assert folds.model_genetics(meta) == ["FUS", "SOD1"]
    table = folds.eligibility(meta, ["FUS", "SOD1"])
    sizes = folds.fold_sizes(table, meta.groupBy("CellLines").agg(F.sum("NCells").alias("cells"))).toPandas()
    fus = sizes[sizes["ModelGenetics"] == "FUS"]
    assert len(fus) == 8 and set(fus["train_lines"]) == {7} and set(fus["predict_lines"]) == {4}
    roles = folds.leave_one_out_folds(table).toPandas()
    assert roles[roles["Mutations"] == "sporadic"]["Holdout"].isna().all()


def test_unmapped_label_fails(screen):
    with pytest.raises(Exception, match="no code for Mutations"):
        labels.encode_labels(screen.wells, "Mutations", {"WT": 0}).collect()
    first = labels.encode_wild_type_first(screen.wells, "Mutations").select("Mutations").distinct().toPandas()
    assert sorted(first["Mutations"]) == [0, 1, 2, 3]


def test_response_per_marker_needs_equal_labels(screen):
    params = {"analysis": {"MAP": {"response": "Mutations"}}}
    parts = MarkerScreens.split(screen.cells, screen.wells, params)
    assert {m: df.count() for m, df in parts.response().items()} == {"M1": 132, "M2": 132}
    broken = MarkerScreens.split(screen.cells, screen.wells.filter("ID != 'M1-sporadic0'"), params)
    with pytest.raises(ValueError):
        broken.response()
    with pytest.raises(ValueError):
        Screen(screen.cells, screen.wells, {}).response()


def test_upsampled_lines_equalise(screen):
    up = balance.upsample_lines(folds.lines_of(screen.wells)).groupBy("Mutations").count().toPandas()
    assert set(up["count"]) == {4}


def test_logistic_probabilities_and_importance(screen):
    rows = screen.labelled("CellLines", "Mutations").filter(F.col("Mutations").isin("WT", "FUS", "SOD1"))
    rows = labels.encode_labels(rows, "Mutations", {"WT": 0, "FUS": 1, "SOD1": 3})
    model = Logistic({}).fit(rows, screen.features)
    out = model.predict(rows).toPandas()
    p = out[["Ypred0", "Ypred1", "Ypred2"]].to_numpy()
    assert np.allclose(p.sum(1), 1) and model.classes == [0, 1, 3]
    assert (np.array(model.classes)[p.argmax(1)] == out["label"]).mean() > 0.85
    assert np.abs(model.coefficients()[1]).argmax() == 0 and len(model.importance()) == 3
    down = balance.balanced_rows(rows, "label").toPandas()
    x = down[screen.features].to_numpy()
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.spread, x.std(0))


def test_leave_one_out_map(screen):
    s = with_params(screen, {"BinaryLogistic": {}}, "leave_one_out_mut")
    result = MAP(s).fit()
    assert set(result.fitted) == {"FUS", "SOD1"}
    table = result.make_table().toPandas()
    fus = table[table["ModelGenetics"] == "FUS"]
    assert set(fus["Holdout"]) == {f"{m}{i}" for m in ("WT", "FUS") for i in range(4)}
    for line, part in fus.groupby("Holdout"):
        assert set(part["CellLines"]) == {line, "SOD10", "SOD11", "sporadic0"}
    own = fus[fus["CellLines"] == fus["Holdout"]].groupby("Mutations")["Ypred"].mean()
    assert own["FUS"] > 0.8 > 0.2 > own["WT"]
    imp = result.fitted["FUS"].importance.toPandas()
    assert len(imp) == 8 * 3 and set(imp["feature"]) == {"f_a", "f_b", "g_c"}
    for r in result.fitted.values():
        r.release()


def test_sample_split_is_centred_and_reproducible(screen):
    s = with_params(only(screen, "WT", "FUS", "sporadic"), {"BinaryLogistic": {}}, "sample_split", {"WT": 0, "FUS": 1, "sporadic": 1}, reps=2)
    one = MAP(s).run()["tables"].toPandas()
    assert one.groupby(["Rep", "Half"])["Ypred"].mean().to_numpy() == pytest.approx([0.5] * 4)
    two = MAP(s).run()["tables"].toPandas()
    keys = ["Rep", "Half", "CellLines", "Ypred"]
    a, b = (t[keys].sort_values(keys).reset_index(drop=True) for t in (one, two))
    assert np.allclose(a["Ypred"], b["Ypred"], atol=1e-6)


def test_two_level_scorer(screen, tmp_path):
    params = with_params(screen, {"MultiAntibody": {}}, "sample_split", {"WT": 0, "FUS": 1, "sporadic": 1}).params
    parts = MarkerScreens.split(screen.cells, only(screen, "WT", "FUS", "sporadic").wells, params)
    result = MAP(parts).fit().fitted
    out = result.predicted.toPandas()
    assert np.allclose(out[["Class_0", "Class_1"]].sum(1), 1)
    for lines, half in zip(result.training_lines, (0, 1), strict=True):
        assert not set(lines) & set(out[out["Half"] == half]["CellLines"])
    known = out[~out["CellLines"].str.startswith("sporadic")]
    assert ((known["Class_1"] > 0.5) == (known["True"] == 1)).mean() > 0.8
    task = _Task.of(parts, params)
    save_model(result.fitted[0], str(tmp_path / "model"))
    again = load_model(screen.cells.sparkSession, str(tmp_path / "model"))
    held = task.part(["WT0", "FUS0", "sporadic0"], True)
    pd.testing.assert_frame_equal(again.predict(held).toPandas(), result.fitted[0].predict(held).toPandas())
    table = result.fitted[0].evaluate(task.part(["WT0", "FUS0"], True)).toPandas()
    assert list(table.columns) == ["CellLines", "True", *[f"class_{i}_{s}" for s in ("agg", "entropy", "M1", "M2") for i in (0, 1)]]
    assert np.allclose(table["class_0_entropy"] + table["class_1_entropy"], 1)


@pytest.mark.parametrize("kind", ["Logistic", "BinaryLogistic", "RandomForest"])
def test_stored_models_give_the_same_rows(screen, spark, tmp_path, kind):
    rows = labels.encode_labels(only(screen, "WT", "FUS").labelled("CellLines", "Mutations"), "Mutations", {"WT": 0, "FUS": 1})
    model = SCORERS[kind]({"n_estimators": 5} if kind == "RandomForest" else {"C": 2.0}).fit(rows, screen.features)
    save_model(model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert type(again) is type(model) and again.classes == model.classes and again.options == model.options and again.importance() == model.importance()
    keys = ["cell_key"]
    a, b = (m.predict(screen.cells).toPandas().sort_values(keys).reset_index(drop=True) for m in (model, again))
    pd.testing.assert_frame_equal(a, b)
    spark.read.parquet(str(tmp_path / "m" / "models")).withColumn("version", F.lit(99)).write.parquet(str(tmp_path / "n" / "models"))
    with pytest.raises(ValueError, match="layout 99"):
        load_model(spark, str(tmp_path / "n"))


def test_new_screens_get_stored_codes(screen, spark, tmp_path):
    wells = screen.wells.withColumn("Screen", F.col("Antibody"))
    for column in ("Screen", "CellLines"):
        save_codes(labels.label_codes(wells, column), str(tmp_path / column))
    codes = tuple(load_codes(spark, str(tmp_path / c)) for c in ("Screen", "CellLines"))
    whole = labels.encode_domains(wells).select("ID", "domain", "label").toPandas().set_index("ID")
    part = wells.filter("Antibody = 'M2' and Mutations <> 'FUS'")
    own = labels.encode_domains(part, codes=codes).select("ID", "domain", "label").toPandas().set_index("ID")
    pd.testing.assert_frame_equal(own.sort_index(), whole.loc[sorted(own.index)])
    with pytest.raises(Exception, match="no code for CellLines=new"):
        labels.encode_domains(part.withColumn("CellLines", F.lit("new")), codes=codes).collect()


def test_training_sample_is_bounded_per_line(screen):
    params = with_params(screen, {"MultiAntibody": {"train": {"n_epochs": 2}}}, "sample_split", {"WT": 0, "FUS": 1}).params
    params["analysis"]["MAP"]["data_loader"]["n_cells"] = 3
    parts = MarkerScreens.split(screen.cells, only(screen, "WT", "FUS").wells, params)
    task = _Task.of(parts, params)
    sizes = task.train["M1"].groupBy("CellLines").count().toPandas()
    assert set(sizes["count"]) == {6} and task.rows["M1"].filter("CellLines = 'WT0'").count() == 12
    out = MAP(parts).fit().fitted.predicted.toPandas()
    assert set(out["CellLines"]) == {f"{m}{i}" for m in ("WT", "FUS") for i in range(4)}


def test_user_loader(spark, screen):
    class Fixed:
        def __init__(self, spark, params):
            pass

        def load(self, antibody):
            return screen.wells.filter(F.col("Antibody") == antibody), screen.cells

    s = Screen.load(spark, {}, "M2", loader=Fixed)
    assert s.keep_wells(s.wells).cells.count() == 132


def test_stability_table(screen):
    params = with_params(screen, {"MultiAntibody": {}}, "sample_split", {"WT": 0, "FUS": 1}).params
    parts = MarkerScreens.split(screen.cells, screen.wells.filter("Mutations in ('WT', 'FUS')"), params)
    out = stability(parts, params, [{"C": 1.0}], replicates=1).toPandas()
    assert len(out) == 4 * 3 and set(out["group"]) == {"agg", "entropy", "M1", "M2"}
    assert out[(out["metric"] == "auc") & (out["group"] == "agg")]["value"].iloc[0] > 0.8


def test_stability_reports_a_half_without_two_classes(screen):
    params = with_params(screen, {"MultiAntibody": {}}, "sample_split", {"WT": 0, "FUS": 1}).params
    few = screen.wells.filter("Mutations = 'WT' or CellLines = 'FUS0'")
    out = stability(MarkerScreens.split(screen.cells, few, params), params, [{"C": 1.0}], replicates=1).toPandas()
    assert len(out) == 12 and out["Reason"].str.contains("half 0: training rows hold 1 class").all()


def test_training_cells_bound_one_marker_too(screen):
    s = with_params(Screen(screen.cells, only(screen, "WT", "FUS").wells), {"RandomForest": {}}, "sample_split", {"WT": 0, "FUS": 1})
    s.params["analysis"]["MAP"]["data_loader"]["training_cells"] = 5
    task = _Task.of(s, s.params)
    assert {r["count"] for r in task.train["_"].groupBy("CellLines").count().collect()} == {5}
    assert task.rows["_"].filter("CellLines = 'WT0'").count() == 24


def test_folds_without_two_classes_come_without_scores(screen):
    """A mutation with one line cannot be on both sides of a split: its fold has no model, but its rows and the reason."""
    few = Screen(screen.cells, screen.wells.filter("CellLines in ('WT0', 'WT1', 'FUS0')"))
    s = with_params(few, {"BinaryLogistic": {}}, "leave_one_out", {"WT": 0, "FUS": 1})
    out = MAP(s).fit().fitted
    table = out.predicted.toPandas()
    assert len(out.fitted) == 2 and set(table["Holdout"]) == {"WT0", "WT1", "FUS0"}
    lost = table[table["Holdout"] == "FUS0"]
    assert set(lost["CellLines"]) == {"FUS0"} and lost["Ypred"].isna().all() and lost["Reason"].str.contains("1 class").all()
    kept = table[table["Holdout"] != "FUS0"]
    assert kept["Ypred"].notna().all() and kept["Reason"].isna().all()
    with pytest.raises(ValueError, match="no fold"):
        MAP(with_params(Screen(few.cells, few.wells.filter("Mutations = 'WT'")), {"BinaryLogistic": {}}, "leave_one_out")).fit()


def test_unmapped_labels_and_missing_keys_are_errors(screen):
    s = with_params(Screen(screen.cells, screen.wells), {"BinaryLogistic": {}}, "leave_one_out", {"WT": 0, "FUS": 1})
    with pytest.raises(Exception, match="no code for Mutations"):
        MAP(s).fit().make_table().collect()
    pair = screen.wells.filter("Mutations in ('WT', 'FUS')")
    bare = with_params(Screen(screen.cells.drop("cell_key"), pair), {"BinaryLogistic": {}}, "leave_one_out", {"WT": 0, "FUS": 1})
    with pytest.raises(ValueError, match="cell_key"):
        MAP(bare).fit()
    deep = with_params(Screen(screen.cells, pair), {"RandomForest": {"max_depth": 0}}, "leave_one_out", {"WT": 0, "FUS": 1})
    with pytest.raises(ValueError, match="max_depth"):
        MAP(deep).fit()


def test_sampling_counts_the_cells_themselves(screen):
    """Too small a count in the well table doesn't keep wells from being sampled."""
    from platelens.operators.samples import subsample_rows_by_id

    odd = Screen(screen.cells, screen.wells.withColumn("NCells", F.lit(1)))
    assert subsample_rows_by_id(odd, n=5).cells.groupBy("ID").count().agg(F.max("count")).first()[0] == 5


def test_raw_coefficients_give_the_fitted_scores(screen, spark):
    from platelens.plans.attribution import fitted_coefficients

    s = with_params(only(screen, "WT", "FUS"), {"BinaryLogistic": {}}, "sample_split", {"WT": 0, "FUS": 1})
    result = MAP(s).fit().fitted
    table = fitted_coefficients(result, spark).toPandas()
    assert len(table) == len(result.fitted) * 2 * 3
    model = result.fitted[0]
    rows = s.cells.limit(20)
    scored = model.predict(rows).toPandas()
    own = table[table["fold"] == 0]
    logit = [np.array([scored[f] * c for f, c in zip(g["feature"], g["coef"], strict=True)]).sum(axis=0) + g["intercept"].iloc[0] for _, g in own.groupby("class")]
    np.testing.assert_allclose(scored["Ypred"], 1 / (1 + np.exp(logit[0] - logit[1])), atol=1e-9)


def test_forest_and_registry(screen):
    s = with_params(only(screen, "WT", "FUS"), {"RandomForest": {"n_estimators": 5, "max_depth": 3}}, "leave_one_out", {"WT": 0, "FUS": 1})
    task = _Task.of(s, s.params)
    model, out = fit_split(task, lambda: SCORERS["BinaryRandomForest"]({"n_estimators": 5}), ["WT0", "WT1", "FUS0", "FUS1"])
    got = out.toPandas()
    assert set(got["CellLines"]) == {"WT2", "WT3", "FUS2", "FUS3"} and set(got["Ypred"]) <= {0, 1}
    assert sum(v for _, v in model.importance()) == pytest.approx(1)

    @scorer
    class Constant(Scorer):
        def fit(self, rows, features):
            return self

        def predict(self, rows):
            return rows.withColumn("Ypred", F.lit(0.5))

    s = with_params(only(screen, "WT", "FUS"), "Constant", "sample_split", {"WT": 0, "FUS": 1})
    assert set(MAP(s).fit().make_table().toPandas()["Ypred"]) == {0.5}
    del SCORERS["Constant"]
    with pytest.raises(KeyError):
        MAP(with_params(screen, "Nothing", "sample_split"))
    assert issubclass(BinaryLogistic, Logistic) and MultiAntibody in SCORERS.values()


def test_pca_facade(screen):
    out = PCA(screen).run()["tables"]
    assert out.columns == ["ID", "column_0", "column_1", "column_2"] and out.count() == 22


def test_line_statistics_both_ways(screen, monkeypatch):
    rows = screen.labelled("CellLines")
    plain = {r["CellLines"]: r for r in sufficient.line_statistics(rows, screen.features).collect()}
    monkeypatch.setattr(sufficient, "EXPRESSION_LIMIT", 0)
    batched = {r["CellLines"]: r for r in sufficient.line_statistics(rows, screen.features).collect()}
    for line, a in plain.items():
        assert a["n"] == batched[line]["n"] == 24
        assert np.allclose(a["sx"], batched[line]["sx"]) and np.allclose(a["sxx"], batched[line]["sxx"])


def test_ridge_folds_match_direct_solution(screen):
    stats = sufficient.line_statistics(screen.labelled("CellLines"), screen.features)
    table = folds.eligibility(screen.wells, ["FUS"]).withColumn("label", (F.col("Mutations") != "WT").cast("bigint"))
    got = sufficient.leave_one_out_ridge(stats, table, screen.features, 2.0).toPandas()
    pdf = screen.labelled("CellLines", "Mutations").toPandas()
    centre = pdf[screen.features].mean().to_numpy()
    pool = pdf[pdf["Mutations"].isin(["WT", "FUS"])]
    for line in ("WT0", "FUS3"):
        train = pool[pool["CellLines"] != line]
        x, y = train[screen.features].to_numpy() - centre, (train["Mutations"] != "WT").to_numpy().astype(float)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        mean = (w[:, None] * x).sum(0) / w.sum()
        sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
        z = (x - mean) / sd
        b = np.linalg.solve((w[:, None] * z).T @ z + 2.0 * np.eye(3), (w[:, None] * z).T @ (y - 0.5))
        test = pool[pool["CellLines"] == line][screen.features].to_numpy() - centre
        want = 0.5 + (((test - mean) / sd) @ b).mean()
        row = got[(got["Holdout"] == line) & (got["class"] == 1)].iloc[0]
        assert row["score"] == pytest.approx(want, abs=1e-9)
    held = sufficient.holdout_scores(stats, table, sufficient.leave_one_out_ridge(stats, table, screen.features, 2.0)).toPandas()
    assert set(held["CellLines"]) == {"SOD10", "SOD11", "sporadic0"}
    sx = pdf[pdf["CellLines"] == "SOD10"][screen.features].mean().to_numpy() - centre
    one = got[got["class"] == 1]
    want = np.mean([r["intercept"] + sx @ np.array(r["coef"]) for _, r in one.iterrows()])
    assert held[(held["CellLines"] == "SOD10") & (held["class"] == 1)]["score"].iloc[0] == pytest.approx(want)


def test_frames_are_complete():
    cells, wells = frames()
    assert len(cells) == 22 * 12 and len(pd.DataFrame(wells)) == 22


@pytest.mark.parametrize("features", [2, 16, 17, 20])
def test_line_statistics_do_not_depend_on_the_number_of_features(spark, features):
    """Both ways of summing leave out cells with a missing feature, in the counts as in the sums."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, features))
    rows = [(f"L{i % 3}", *[float(v) for v in r]) for i, r in enumerate(x)]
    rows[4] = (rows[4][0], None, *rows[4][2:])
    rows[9] = (rows[9][0], *rows[9][1:-1], float("nan"))
    names = [f"f{i}" for i in range(features)]
    df = spark.createDataFrame(rows, ", ".join(["CellLines string", *(f"{n} double" for n in names)])).repartition(5)
    got = {r["CellLines"]: r for r in sufficient.line_statistics(df, names).collect()}
    whole = np.array([i not in (4, 9) for i in range(60)])
    centred = x - x[whole].mean(axis=0)
    for k in range(3):
        own = centred[whole & (np.arange(60) % 3 == k)]
        r = got[f"L{k}"]
        assert r["n"] == len(own)
        np.testing.assert_allclose(r["sx"], own.sum(axis=0), atol=1e-9)
        np.testing.assert_allclose(r["sxx"], (own.T @ own).ravel(), atol=1e-9)


def test_ridge_folds_do_not_depend_on_how_totals_travel(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"L{i % 8}", *[float(v) for v in rng.normal(size=3) + (i % 2)]) for i in range(200)]
    cells = spark.createDataFrame(rows, "CellLines string, a double, b double, c double")
    lines = spark.createDataFrame([("m", f"L{k}", k % 2, True) for k in range(8)], "ModelGenetics string, CellLines string, label bigint, eligible boolean")
    stats = sufficient.line_statistics(cells, ["a", "b", "c"])

    def run():
        found = sufficient.leave_one_out_ridge(stats, lines, ["a", "b", "c"]).orderBy("Holdout", "class").collect()
        return [(r["Holdout"], r["class"], round(r["score"], 9), round(r["intercept"], 9)) for r in found]

    first = run()
    monkeypatch.setattr(sufficient, "BROADCAST_BYTES", 0)
    assert run() == first and len(first) == 16

"""Preprocessing steps on small frames with nulls, constants and awkward names; the params compiler."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens import MarkerScreens, Screen, merge_screens
from platelens.operators import features as feat
from platelens.operators import samples
from platelens.operators.registry import STEPS, step
from platelens.plans.compiler import needed_columns, run_preprocess
from platelens.plans.components import components_by_group, fit_components, profile_components, score_components


@pytest.fixture
def nulls(spark):
    """100 cells: null shares 0, 0.1, 0.11 and 1, a constant, a constant with nulls; names with marks and dots."""
    n = 100
    rows = [
        (f"P-{i % 4}-1", f"k{i}", float(i), None if i < 10 else float(i), None if i < 11 else float(i), None, 3.0,
         None if i % 2 else 7.0, float(i * i % 13))
        for i in range(n)
    ]
    schema = ("ID string, cell_key string, `Area_[µm²]` float, `Spot 1.5` float, Intensity_Sum float, Empty float, "
              "Flat float, Gaps float, Intensity_A float")
    cells = spark.createDataFrame(rows, schema)
    wells = cells.groupBy("ID").agg(F.count(F.lit(1)).alias("NCells")).withColumn("Drugs", F.lit("DMSO"))
    return Screen(cells, wells)


def test_drop_na_is_strict_and_fills_with_mean(nulls):
    out = feat.drop_na_features(nulls, na_prop=0.1)
    assert out.features == ["Area_[µm²]", "Spot 1.5", "Flat", "Intensity_A"]
    first = out.cells.filter("cell_key = 'k0'").first()
    assert first["Spot 1.5"] == pytest.approx(np.mean(np.arange(10, 100)))
    assert dict(out.cells.dtypes)["Spot 1.5"] == "float"


def test_drop_constant_counts_null_as_a_value(nulls):
    out = feat.drop_constant_features(nulls)
    assert "Flat" not in out.features and "Empty" not in out.features and "Gaps" in out.features
    assert "ID" in out.cells.columns


def test_pattern_steps_need_anchors(nulls):
    with pytest.raises(ValueError):
        feat.select_feature_types(nulls, "Intensity")
    with pytest.raises(ValueError):
        feat.drop_feature_types(nulls, "^Intensity")
    assert feat.select_feature_types(nulls, "^.*Intensity.*$").features == ["Intensity_Sum", "Intensity_A"]
    assert "Intensity_A" not in feat.drop_feature_types(nulls, "^.*_A$").features


def test_sample_filters_null_label_is_dropped(spark):
    cells = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "ID string, x double")
    wells = spark.createDataFrame([("a", "WT", 1), ("b", None, 1), ("c", "SOD1", 1)], "ID string, Mutations string, NCells int")
    out = samples.drop_sample_by_feature if callable(samples.drop_sample_by_feature) else None
    kept = out(Screen(cells, wells), drop_key=[{"Mutations": ["SOD1"]}])
    assert [r["ID"] for r in kept.cells.collect()] == ["a"]


def test_standardize_handles_constant(nulls):
    z = feat.standardize_features(feat.drop_na_features(nulls, na_prop=0.1)).cells.toPandas()
    assert abs(z["Area_[µm²]"].mean()) < 1e-6 and z["Area_[µm²]"].std() == pytest.approx(1, rel=1e-5)
    assert (z["Flat"].abs() < 1e-3).all()


def test_compiler_equals_plain_order_and_prunes(nulls, spark):
    params = {
        "drop_na_features": {"na_prop": 0.2},
        "drop_cells_by_feature_qt": {"feature_filters": {"Area_[µm²]": 0.05}},
        "select_feature_types": {"feature_str": "^.*Intensity.*$|^.*Spot.*$"},
        "drop_feature_types": {"feature_str": "^.*Sum.*$"},
        "drop_constant_features": {},
    }
    assert set(needed_columns(list(params.items()), nulls.features)) == {"Area_[µm²]", "Spot 1.5", "Intensity_A"}
    fast = run_preprocess(nulls, params).cells.toPandas().sort_values("cell_key").reset_index(drop=True)
    slow = nulls
    for name, kwargs in params.items():
        slow = STEPS[name](slow, **kwargs)
    slow = slow.cells.toPandas().sort_values("cell_key").reset_index(drop=True)
    pd.testing.assert_frame_equal(fast[slow.columns], slow)
    with pytest.raises(KeyError):
        run_preprocess(nulls, {"no_such_step": {}})


def test_user_step(nulls):
    @step
    def halve(screen, column):
        return screen.with_cells(screen.cells.withColumn(column, F.col(column) / 2))

    out = run_preprocess(nulls, {"halve": {"column": "Flat"}})
    assert out.cells.first()["Flat"] == 1.5
    del STEPS["halve"]


def test_per_marker_preprocessing_and_merge(spark, nulls):
    a = Screen(nulls.cells, nulls.wells, {"preprocess": {"drop_constant_features": {}}, "analysis": {"MAP": {}}})
    b = Screen(nulls.cells, nulls.wells, {"preprocess": {"drop_na_features": {"na_prop": 0.5}}, "analysis": {"MAP": {}}})
    merged = merge_screens({"A": a, "B": b})
    assert merged.params["antibodies"] == ["A", "B"] and set(merged.params["preprocess"]) == {"A", "B"}
    done = merged.preprocess()
    assert "Flat" not in done["A"].features and "Flat" in done["B"].features and done.preprocessed
    same = merge_screens({"A": a, "B": a})
    assert same.params["preprocess"] == {"drop_constant_features": {}}
    other = Screen(nulls.cells, nulls.wells, {"analysis": {"MAP": {"seed": 1}}})
    with pytest.raises(ValueError):
        merge_screens({"A": a, "C": other})
    assert isinstance(merged, MarkerScreens)


def test_ablation_params():
    out = feat.without_marker({"preprocess": {"drop_feature_types": {"feature_str": "^.*Sum.*$"}}}, "488")
    assert out["preprocess"]["drop_feature_types"]["feature_str"] == "^.*Sum.*$|^.*488.*$"


def test_components_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    names = ["a_1", "a_2", "b_1", "b_2", "c"]
    pdf = pd.DataFrame(x, columns=names)
    pdf.insert(0, "ID", [f"w{i % 20}" for i in range(200)])
    df = spark.createDataFrame(pdf)
    z = (x - x.mean(0)) / x.std(0)
    full = fit_components(feat.scale_columns(df, names), names)
    want = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(full.explained, want / want.sum(), atol=1e-8)
    grouped = components_by_group(df, names, ["^a_"], 0.99)
    got = [c for c in grouped.columns if c != "ID"]
    rest = np.cumsum(np.sort(np.linalg.eigvalsh(np.cov(z[:, 2:].T)))[::-1]) / 3 * (199 / 200)
    share = rest / rest[-1]
    assert sum(c.startswith("PC") for c in got) == int(np.searchsorted(share, 0.99 - 1e-12) + 1)
    assert any(c.startswith("^a_") for c in got)
    wells = spark.createDataFrame([(f"w{i}", f"l{i % 5}") for i in range(20)], "ID string, CellLines string")
    prof = profile_components(df, wells).toPandas()
    assert len(prof) == 20 and prof.drop(columns="ID").var(ddof=0).sum() == pytest.approx(5)
    assert profile_components(df, wells, "CellLines").count() == 5


def test_score_components_project_with_same_basis(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 2, 3], size=50)
    pdf = pd.DataFrame(p, columns=["Class_0", "Class_1", "Class_2"])
    df = spark.createDataFrame(pdf)
    main, again, explained = score_components(df, df)
    a, b = main.toPandas(), again.toPandas()
    assert np.allclose(a["PCA1"], b["PCA1"]) and abs(a["PCA1"].mean()) < 1e-9
    c = p - p.mean(0)
    w = np.linalg.eigvalsh(c.T @ c)[::-1]
    assert explained == pytest.approx((w / w.sum())[:2].tolist())

"""How often rows are read, and that the ways for many wells give the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelens import MarkerScreens, Screen
from platelens.operators.samples import _trimmed_in_place, drop_cells_by_feature_qt
from platelens.plans import balance, multiscreen
from platelens.plans.fitters import _Task

LINES, CELLS = 3, 3000


def counted(df):
    """The same rows, and a counter of the rows read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.fixture(scope="module")
def cells(spark):
    n = LINES * CELLS
    return spark.range(n).select((F.col("id") % LINES).cast("string").alias("CellLines"), F.col("id").cast("string").alias("cell_key"), (F.hash("id") % 97).cast("double").alias("x")).persist()


def test_draws_read_the_cells_twice(cells):
    rows, seen = counted(cells)
    out = balance.line_draws(rows, 20, 2).groupBy("CellLines").agg(F.sum("copies").alias("n")).collect()
    assert {r.n for r in out} == {40} and len(out) == LINES
    assert seen.value <= 2 * LINES * CELLS


def test_repeated_draws_read_the_cells_twice(cells):
    rows, seen = counted(cells)
    out = balance.repeated_means(rows, ["CellLines"], ["x"], 25, 4).collect()
    assert len(out) == LINES and {r.reps for r in out} == {4}
    assert seen.value <= 2 * LINES * CELLS


def test_draws_of_equal_digests_are_all_counted(spark):
    """Cells without a key have one digest; a line may then lie below the share as a whole, or not at all."""
    df = spark.range(1000).select(F.lit("L").alias("CellLines"), F.lit(None).cast("string").alias("cell_key"))
    assert balance.line_draws(df, 10, 1).count() == 1000


def _screens(spark, counter):
    wells = [(f"{m}-{line}", line, mutation, m) for m in ("M1", "M2") for line, mutation in (("a", "WT"), ("b", "FUS"))]
    w = spark.createDataFrame(wells, "ID string, CellLines string, Mutations string, Antibody string").persist()
    c = w.select("ID", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i")).select("ID", F.concat_ws(":", "ID", "i").alias("cell_key"), F.col("i").cast("double").alias("x")).persist()
    rows, seen = counter(c)
    params = {"analysis": {"MAP": {"model": {"MultiAntibody": {"train": {"n_epochs": 2}}}, "response": "Mutations", "data_loader": {"n_cells": 5}}}}
    return rows, w, seen, params


def test_markers_share_one_join(spark):
    rows, w, seen, params = _screens(spark, counted)
    parts = MarkerScreens.split(rows, w, params)
    for s in parts.values():
        assert s.undivided() is not None and s.with_cells(s.cells.limit(1)).undivided() is None
    seen_before = seen.value
    task = _Task.of(parts, params)
    for m in ("M1", "M2"):
        got = task.rows[m].collect()
        assert len(got) == 100 and {r.ID for r in got} == {f"{m}-a", f"{m}-b"}
        assert {(r.CellLines, r.n) for r in task.train[m].groupBy("CellLines").agg(F.sum("copies").alias("n")).collect()} == {("a", 10), ("b", 10)}
    assert seen.value - seen_before <= 200
    for df in task.cached:
        df.unpersist()


def test_trim_in_place_equals_bounds(spark):
    rng = np.random.default_rng(3)
    data = [(None if rng.random() < 0.02 else f"w{int(rng.integers(0, 30))}", i, None if rng.random() < 0.1 else float(rng.integers(0, 40)), None if i % 50 == 7 else float("nan") if i % 31 == 0 else float(rng.normal())) for i in range(2000)]
    data += [("empty", -1, None, 1.0), ("one", -2, 2.0, 3.0)]
    df = spark.createDataFrame(data, "ID string, Screen long, `a b` double, c double").persist()
    wells = df.select("ID").distinct().filter("ID is not null")
    filters = {"a b": 0.1, "c": 0.2}
    want = drop_cells_by_feature_qt(Screen(df, wells), feature_filters=filters).cells
    got = _trimmed_in_place(df, filters)
    assert got.columns == want.columns
    assert sorted(r.Screen for r in got.collect()) == sorted(r.Screen for r in want.collect())
    spark.conf.set("spark.platelens.broadcastRows", "0")
    try:
        plan = drop_cells_by_feature_qt(Screen(df, wells), feature_filters=filters).cells
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("hashpartitioning(ID") == 1
    finally:
        spark.conf.unset("spark.platelens.broadcastRows")


def test_aligners_share_labelled_cells(spark):
    rows, w, seen, _ = _screens(spark, counted)
    w = w.withColumn("Screen", F.col("Antibody"))
    labelled = multiscreen.with_labels(rows.drop("cell_key"), w).persist()
    for per_screen in (False, True):
        own = multiscreen.ScreenAligner(per_screen).fit_transform(labelled)
        both = multiscreen.ScreenAligner(per_screen).fit_transform(rows.drop("cell_key"), w)
        assert own.columns == both.columns
        assert sorted(map(str, own.collect())) == sorted(map(str, both.collect()))
    before = seen.value
    multiscreen.ScreenAligner(True).fit_transform(labelled).collect()
    assert seen.value == before
    labelled.unpersist()


def test_plates_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    """Lines of all plates in one write, whatever the number of plates (one with a null status has none)."""
    from platelens.catalog.loading import a05

    rows = [(i, i % 3, float(i), "ANR"[i % 3], "FO"[i % 2]) for i in range(60)] + [(99, 1, 1.0, "A", None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr("platelens.catalog.loading.shared_folder", lambda spark: f"{tmp_path}/kept")
    got = a05(spark, str(tmp_path)).collect()
    assert {(r.Screen, r.PlateID, r.lines) for r in got} == {(f, f + s, 10) for f in "ANR" for s in "FO"}
    assert not [d for d in (tmp_path / "kept").iterdir() if not d.name.startswith("plates-")]


def test_a_row_comes_back_from_python_once(spark):
    """Scores of all folds of a row travel together, in the order of the folds."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from platelens.plans.manyfits import member_table, scan_folds

    folds = [["a"], ["b"], []]
    table, _ = member_table(spark, folds)
    rows = spark.createDataFrame([("a", 1.0, "k1"), ("b", 2.0, "k2"), ("c", 3.0, "k3"), ("b", 4.0, "k4")], "CellLines string, x double, key string").join(table, "CellLines", "left")
    rows = rows.withColumn("member", F.coalesce("member", F.lit(bytearray(1))))
    out = scan_folds(rows, ["x"], 3, "member", ["CellLines", "key"], [T.StructField("v", T.DoubleType())], lambda: lambda x: lambda f, at: [pa.array(x[at, 0] * 10 + f)])
    assert sorted(map(tuple, out.collect())) == [("a", "k1", 1, 11.0), ("a", "k1", 2, 12.0), ("b", "k2", 0, 20.0), ("b", "k2", 2, 22.0), ("b", "k4", 0, 40.0), ("b", "k4", 2, 42.0),
                                                 ("c", "k3", 0, 30.0), ("c", "k3", 1, 31.0), ("c", "k3", 2, 32.0)]
    assert "Generate" in out._jdf.queryExecution().optimizedPlan().toString()

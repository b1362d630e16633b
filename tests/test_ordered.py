"""Order statistics, running sums and positions: the split way for hot groups must equal numpy and the short way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens.functions.metrics import auroc, mutation_auroc
from platelens.functions.ordered import LINEAR, NEAREST, grouped_quantiles, positions, running_before, smallest_per_group
from platelens.operators.samples import drop_cells_by_feature_qt, subsample_rows_by_id
from platelens.plans.balance import balanced_rows, cells_per_line
from platelens.screen import Screen


def skewed(seed=0, ties=True):
    """Wells of 1, 2, 20 and 101 cells, and one with a third of everything."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in {"a": 1, "b": 2, "c": 20, "d": 101, "e": 101, "hot": 700}.items():
        v = rng.normal(size=n)
        parts.append(pd.DataFrame({"ID": name, "x": np.round(v, 1) if ties else v, "y": rng.random(n)}))
    out = pd.concat(parts, ignore_index=True)
    out["cell_key"] = out.index.astype(str)
    out.loc[out.index % 17 == 0, "y"] = np.nan
    return out


def nearest(values, q):
    v = np.sort(values)
    return v[int(np.floor((len(v) - 1) * q + 0.5))]


@pytest.mark.parametrize("mode", ["plain", "split"])
@pytest.mark.parametrize("method", [NEAREST, LINEAR])
def test_quantiles_match_numpy(request, spark, mode, method):
    if mode == "split":
        request.getfixturevalue("hot")
    pdf = skewed()
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    levels = {"lo": ("x", 0.05), "hi": ("x", 0.95), "ymid": ("y", 0.5)}
    got = {r["ID"]: r for r in grouped_quantiles(df, ["ID"], levels, method).collect()}
    for name, part in pdf.groupby("ID"):
        for alias, (c, q) in levels.items():
            v = part[c].dropna().to_numpy()
            if not len(v):
                assert got[name][alias] is None
                continue
            want = nearest(v, q) if method == NEAREST else np.quantile(v, q)
            assert got[name][alias] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_global_quantile_with_level_depending_on_n(request, spark, mode):
    if mode == "split":
        request.getfixturevalue("hot")
    pdf = skewed(3, ties=False)
    df = spark.createDataFrame(pdf[["x"]])
    out = grouped_quantiles(df, [], {"t": ("x", lambda n: F.least(F.lit(1.0), F.lit(0.9) * (n + 1) / n))}, LINEAR)
    n = len(pdf)
    assert out.first()["t"] == pytest.approx(np.quantile(pdf["x"], 0.9 * (n + 1) / n), abs=1e-12)


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_running_sums_and_positions(request, spark, mode):
    if mode == "split":
        request.getfixturevalue("hot")
    pdf = skewed(1)
    df = spark.createDataFrame(pdf[["ID", "x", "cell_key"]])
    counts = df.groupBy("ID", "x").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["ID"], r["x"]): r["_before_n"] for r in running_before(counts, ["ID"], "x", ["n"]).collect()}
    for (name, x), before in got.items():
        assert before == int((pdf[pdf["ID"] == name]["x"] < x).sum())
    placed = positions(df, ["ID"], "x", ["cell_key"], "p").toPandas()
    assert len(placed) == len(pdf)
    for _, part in placed.groupby("ID"):
        ordered = part.sort_values(["x", "cell_key"])
        assert ordered["p"].tolist() == list(range(1, len(part) + 1))


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_auroc_matches_pair_counting(request, spark, mode):
    if mode == "split":
        request.getfixturevalue("hot")
    pdf = skewed(2)
    pdf["pos"] = pdf.index % 3 == 0
    df = spark.createDataFrame(pdf[["ID", "x", "pos"]])
    got = {r["ID"]: r["auroc"] for r in auroc(df, ["ID"], "x", F.col("pos")).collect()}
    for name, part in pdf.groupby("ID"):
        p, q = part[part["pos"]]["x"].to_numpy(), part[~part["pos"]]["x"].to_numpy()
        if len(p) == 0 or len(q) == 0:
            assert got[name] is None
            continue
        wins = (p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()
        assert got[name] == pytest.approx(wins / (len(p) * len(q)))


def test_smallest_per_group_is_exact_when_hot(hot):
    pdf = skewed(4)
    df = hot.createDataFrame(pdf[["ID", "x", "cell_key"]]).repartition(7)
    got = smallest_per_group(df, ["ID"], ["x", "cell_key"], 25, fan_in=3).toPandas()
    want = pdf.sort_values(["x", "cell_key"]).groupby("ID").head(25)
    assert set(got["cell_key"]) == set(want["cell_key"])


def make_screen(spark, pdf):
    wells = pdf.groupby("ID").size().rename("NCells").reset_index()
    return Screen(spark.createDataFrame(pdf[["ID", "cell_key", "x"]]), spark.createDataFrame(wells))


def trimmed(spark, pdf):
    out = drop_cells_by_feature_qt(make_screen(spark, pdf), feature_filters={"x": 0.05})
    return set(out.cells.toPandas()["cell_key"])


def test_trim_same_rows_either_way(spark, request):
    pdf = skewed(5)
    want = set()
    for _, part in pdf.groupby("ID"):
        lo, hi = nearest(part["x"], 0.05), nearest(part["x"], 0.95)
        want |= set(part[(part["x"] >= lo) & (part["x"] <= hi)]["cell_key"])
    assert trimmed(spark, pdf) == want
    request.getfixturevalue("hot")
    assert trimmed(spark, pdf) == want


def test_sampling_does_not_depend_on_partitions_or_path(spark, request):
    pdf = skewed(6)

    def picks(parts):
        s = make_screen(spark, pdf)
        s = s.with_cells(s.cells.repartition(parts))
        return set(subsample_rows_by_id(s, n=30, seed=5).cells.toPandas()["cell_key"])

    first = picks(1)
    assert len(first) == 1 + 2 + 20 + 30 * 3
    assert picks(9) == first
    assert first != set(subsample_rows_by_id(make_screen(spark, pdf), n=30, seed=6).cells.toPandas()["cell_key"])
    request.getfixturevalue("hot")
    assert picks(5) == first


def test_subsample_without_cell_key(spark):
    pdf = skewed(7)
    s = make_screen(spark, pdf)
    out = subsample_rows_by_id(s.with_cells(s.cells.drop("cell_key")), n=10).cells.groupBy("ID").count().toPandas()
    assert dict(zip(out["ID"], out["count"], strict=True)) == {"a": 1, "b": 2, "c": 10, "d": 10, "e": 10, "hot": 10}


@pytest.mark.parametrize("mode", ["plain", "split"])
def test_balanced_rows(request, spark, mode):
    if mode == "split":
        request.getfixturevalue("hot")
    pdf = skewed(8)
    df = spark.createDataFrame(pdf[["ID", "cell_key"]].rename(columns={"ID": "label"})).filter("label != 'a'")
    down = balanced_rows(df, "label", "down").groupBy("label").count().toPandas()
    assert set(down["count"]) == {2}
    up = balanced_rows(df, "label", "up")
    assert set(up.groupBy("label").count().toPandas()["count"]) == {700}
    assert up.select("cell_key").distinct().count() == df.count()


def test_cells_per_line_exact_n(spark):
    pdf = skewed(9)
    df = spark.createDataFrame(pdf[["ID", "cell_key"]])
    got = cells_per_line(df, ["ID"], 50).toPandas()
    assert set(got.groupby("ID").size()) == {50}
    assert got[got["ID"] == "hot"]["cell_key"].is_unique
    owner = dict(zip(pdf["cell_key"], pdf["ID"], strict=True))
    assert all(owner[k] == i for i, k in zip(got["ID"], got["cell_key"], strict=True))


def test_mutation_auroc_skips_missing_class(spark):
    rows = [("l1", "WT", "m1", 0.1), ("l2", "ASIA", "m1", 0.9), ("l3", "ASIA", "m2", 0.4)]
    df = spark.createDataFrame(rows, "CellLines string, Mutations string, ModelGenetics string, Class_1 double")
    got = mutation_auroc(df, ["ModelGenetics"]).collect()
    assert [(r["ModelGenetics"], r["Mutation"], r["AUROC"]) for r in got] == [("m1", "ASIA", 1.0)]


@pytest.mark.parametrize("n", [5, 1200])
def test_smallest_digests_are_exact(spark, n):
    """Also above the size up to which Spark limits the rows of a window by itself."""
    from platelens.functions.hashing import hash_order
    from platelens.functions.ordered import smallest_digests

    df = spark.range(6000).select(F.when(F.col("id") < 5500, "big").otherwise("small").alias("k"), F.col("id").cast("string").alias("key"))
    df = df.withColumn("h", hash_order(F.col("key"), 47)).repartition(6)
    got = smallest_digests(df, ["k"], "h", ["key"], n).groupBy("k").agg(F.sort_array(F.collect_list("h")).alias("h")).collect()
    want = df.toPandas()
    for r in got:
        assert r["h"] == sorted(want[want["k"] == r["k"]]["h"])[:n]
    assert {r["k"] for r in got} == {"big", "small"}

"""Components from one Gram matrix against numpy, at the width of a real screen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelens.functions import arrays
from platelens.plans.components import components_by_group, fit_components


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 300)) @ rng.normal(size=(300, 300)) + rng.normal(size=300) * 50
    names = [f"{'Nucleus' if i % 3 == 0 else 'Cell' if i % 3 == 1 else 'other'}.f {i}" for i in range(300)]
    df = spark.createDataFrame([(f"w{i}", *map(float, r)) for i, r in enumerate(x)], ["ID", *names]).repartition(7).persist()
    return df, names, x


def test_gram_equals_numpy(wide, spark):
    df, names, x = wide
    n, sums, square = arrays.gram(df, names)
    assert n == 400
    np.testing.assert_allclose(sums, x.sum(axis=0), rtol=1e-9)
    np.testing.assert_allclose(square, x.T @ x, rtol=1e-9)
    n, sums, square = arrays.gram(df.limit(0), names[:3])
    assert n == 0 and not sums.any() and not square.any()
    with pytest.raises(Exception, match="need all values"):
        arrays.gram(df.withColumn("bad", F.lit(None).cast("double")), ["bad"])


def test_components_by_group_equal_numpy(wide):
    df, names, x = wide
    groups = ["^Nucleus", "^Cell"]
    out = components_by_group(df, names, groups, 0.9).toPandas().set_index("ID").loc[[f"w{i}" for i in range(400)]]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for prefix, mark in (("^Nucleus_", "Nucleus"), ("^Cell_", "Cell"), ("", "other")):
        own = z[:, [i for i, n in enumerate(names) if n.startswith(mark)]]
        u, s, vt = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
        kept = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9) + 1)
        cols = [c for c in out.columns if (c.startswith(prefix) if prefix else c.startswith("PC"))]
        assert cols == [f"{prefix}PC{i}" for i in range(kept)]
        got = out[cols].to_numpy()
        scale = got.std(axis=0) / (own @ vt[:kept].T).std(axis=0)
        np.testing.assert_allclose(np.abs((got * (own @ vt[:kept].T)).mean(axis=0)) / (got.std(axis=0) * (own @ vt[:kept].T).std(axis=0)), 1, atol=1e-6)
        np.testing.assert_allclose(scale, scale[0], rtol=1e-6)


def test_projection_plan_has_one_scan(wide):
    df, names, _ = wide
    plan = components_by_group(df, names, ["^Nucleus", "^Cell"], 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_shares_fall_and_sum_to_one(wide):
    df, names, _ = wide
    fitted = fit_components(df, names[:10], k=3)
    assert len(fitted.explained) == 3 and fitted.explained == sorted(fitted.explained, reverse=True) and fitted.shares.sum() == pytest.approx(1)

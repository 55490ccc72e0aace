"""Multiple imputation: what is known stays, the spread is that of the posterior, pooling follows its rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import imputation as im


@pytest.fixture(scope="module")
def table(spark):
    """y = 1 + 2 x + noise of variance 1, b with log odds x; a third of y and a quarter of b missing by x."""
    draw = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        x = float(draw.standard_normal())
        y, b = 1 + 2 * x + draw.standard_normal(), int(draw.random() < 1 / (1 + np.exp(-x)))
        rows.append((i, x, float(y), b, None if draw.random() < 1 / (1 + np.exp(-x)) * 0.66 else float(y),
                     None if draw.random() < 0.25 else b))
    return rows, spark.createDataFrame(rows, "id int, x double, y0 double, b0 int, y double, b int").drop("y0", "b0")


def test_complete_proper_and_unbiased(table):
    rows, df = table
    out = im.impute_multiple(df.repartition(3), {"y": "pmm", "b": "logreg"}, "id", m=5, iters=3, seed=4)
    got = out.toPandas().sort_values(["imputation", "id"])
    assert out.columns == ["imputation", "id", "x", "y", "b"] and len(got) == 5 * len(rows) and not got.isna().any().any()
    known = {r[0]: r[4] for r in rows if r[4] is not None}
    kept = got[got.id.isin(known)]
    assert (kept.y == kept.id.map(known)).all() and set(got.y) <= set(known.values()) and set(got.b) == {0.0, 1.0}
    parts = [g for _, g in got.groupby("imputation")]
    assert len({round(g.y.mean(), 9) for g in parts}) == 5 and len({g.b.sum() for g in parts}) > 1
    truth = np.mean([r[2] for r in rows])
    biased = np.mean(list(known.values()))
    within = np.mean([g.y.var() / len(g) for g in parts])
    between = np.var([g.y.mean() for g in parts], ddof=1)
    pooled = np.mean([g.y.mean() for g in parts])
    assert abs(biased - truth) > 0.3 > 0.12 > abs(pooled - truth) and 0 < between < within
    slope = np.mean([np.polyfit(g.x, g.y, 1)[0] for g in parts])
    assert slope == pytest.approx(2, abs=0.12)
    share = np.mean([r[3] for r in rows])
    assert np.mean([g.b.mean() for g in parts]) == pytest.approx(share, abs=0.03)
    again = im.impute_multiple(df, {"y": "pmm", "b": "logreg"}, "id", m=5, iters=3, seed=4).toPandas().sort_values(["imputation", "id"])
    assert np.allclose(got.y, again.y) and (got.b.to_numpy() == again.b.to_numpy()).all()


def test_posterior_draws_have_the_stated_covariance():
    h = np.array([[4.0, 1.0], [1.0, 9.0]])
    rng = np.random.default_rng(1)
    got = np.cov(np.array([im._posterior(h, 2.0, rng) for _ in range(20_000)]).T)
    assert got == pytest.approx(4 * np.linalg.inv(h), abs=0.03)


def test_pooling(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.7), ("a", 3.0, 0.6), ("b", 1.0, 0.2), ("b", 1.0, 0.2)],
                               "term string, estimate double, variance double")
    got = {r.term: r for r in im.pool(df).collect()}
    assert (got["a"].estimate, got["a"].within, got["a"].between) == (2.0, pytest.approx(0.6), 1.0)
    assert got["a"].total == pytest.approx(0.6 + 4 / 3) and got["a"].df == pytest.approx(2 * (1 + 0.6 / (4 / 3)) ** 2)
    assert got["b"].total == pytest.approx(0.2) and got["b"].df is None
    assert df.agg(F.count("*")).first()[0] == 5

"""Deep forests: whole size, trees against a plain fit, means of the trees as scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.growing import best_of, grow
from riskframe.operators import forest as fo, models as m
from riskframe.plans import models_q
from riskframe.plans.catalog import QUERIES

NAMES = ["x", "z"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = [(i, float(draw.randrange(12)), draw.randrange(3) / 2) for i in range(600)]
    return [(i, x, z, int(draw.random() < 0.1 + 0.6 * (x > 5) + 0.2 * (z == 1))) for i, x, z in out]


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, x double, z double, y int")


def test_query_fits_the_whole_forest(spark, monkeypatch):
    sizes = []

    def noted(df, features, label, trees=250, min_leaf=10, depth=20, *a, **k):
        sizes.append((trees, depth, min_leaf))
        return m_fit(df, features, label, 3, min_leaf, 3)
    m_fit = m.fit_risk_rf
    monkeypatch.setattr(models_q.m, "fit_risk_rf", noted)
    assert QUERIES["m16_score_out_of_fold"](spark, "/root/testdata/sf0.001").count() == 1
    assert sizes == [(250, 20, 10)] * 2


def plain(rows, least, depth):
    """Mean outcome of the leaf of every id, by trying every split of the rows."""
    def gain(side, rest):
        return sum(sum(r[3] for r in s) ** 2 / len(s) for s in (side, rest))
    best = None
    for j in (1, 2) if depth else ():
        known = sorted({r[j] for r in rows})
        for a, b in zip(known, known[1:]):
            left, right = ([r for r in rows if (r[j] < (a + b) / 2) == low] for low in (True, False))
            if min(len(left), len(right)) < least:
                continue
            got = gain(left, right) - sum(r[3] for r in rows) ** 2 / len(rows)
            if got > (best[0] + 1e-9 if best else 1e-9):
                best = (got, left, right)
    if not best:
        mean = sum(r[3] for r in rows) / len(rows)
        return {r[0]: mean for r in rows}
    return plain(best[1], least, depth - 1) | plain(best[2], least, depth - 1)


def test_a_tree_matches_a_plain_fit(rows):
    bins = np.array([[int(r[1]) + 1 for r in rows], [int(2 * r[2]) + 1 for r in rows]])
    y, n = np.array([float(r[3]) for r in rows]), np.ones(len(rows))

    def gain(u, v, whole, size):
        with np.errstate(divide="ignore", invalid="ignore"):
            out = u * u / v + (whole - u) ** 2 / (size - v) - whole * whole / size
        return np.where((v < 10) | (size - v < 10), -np.inf, out)
    for depth in (1, 3, 12):
        found, leaf = grow(bins, [13, 4], y, n, depth, lambda a, b: best_of(a, b, [13, 4], gain, 1e-9))
        assert (found["a"] / found["b"])[leaf] == pytest.approx([plain(rows, 10, depth)[r[0]] for r in rows])
        assert found["b"].min() >= 10


def test_forest_is_whole_and_scores_by_its_trees(spark, rows, monkeypatch):
    df = table(spark, rows)
    model = m.fit_risk_rf(df, NAMES, "y")
    assert isinstance(model, fo.Forest) and model.trees.count() == 250
    got = {r.id: r.risk for r in m.score(model, df.repartition(3)).collect()}
    rate = {k: np.mean([r[3] for r in rows if (r[1] > 5, r[2] == 1) == k]) for k in ((a, b) for a in (True, False) for b in (True, False))}
    assert len(got) == len(rows) and all(abs(got[r[0]] - rate[r[1] > 5, r[2] == 1]) < 0.25 for r in rows)
    monkeypatch.setattr(fo, "TREE_BYTES", 1)  # every tree is a block of its own
    few = m.fit_risk_rf(df.repartition(5), NAMES, "y", trees=3)
    again = m.fit_risk_rf(df, NAMES, "y", trees=3)
    one, two = ({r.id: r.risk for r in m.score(x, df).collect()} for x in (few, again))
    assert one == two and len(set(one.values())) > 4
    assert m.importance(model, df, NAMES).where("feature = 'x'").first().importance > 0.7
    assert df.agg(F.count("*")).first()[0] == len(rows)


def test_other_labels_and_gaps(spark, rows):
    assert fo.fit_forest(table(spark, rows).withColumn("y", F.col("y") * 2), NAMES, "y", 1, 10, 20, 1) is None
    with pytest.raises(Exception, match="lacks a feature"):
        fo.fit_forest(table(spark, [*rows, (900, None, 0.0, 1)]), NAMES, "y", 1, 10, 20, 1)

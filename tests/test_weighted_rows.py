"""Boosted trees are fitted to equal rows once, by their number, and come out as on the rows themselves."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import models as m


@pytest.fixture(scope="module")
def cases(spark):
    """4,000 rows of 120 cells and fewer, with a signal; half of all rows are equal."""
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    df = spark.range(4000).withColumn("hot", F.col("id") < 2000)
    df = df.select("id", F.when(F.col("hot"), 7).otherwise(F.col("id") % 10).cast("double").alias("a"),
                   F.when(F.col("hot"), 1).otherwise(F.col("id") % 3).cast("int").alias("b"), (F.col("id") % 2).cast("int").alias("c"))
    rate = 0.2 + 0.05 * F.col("a") + 0.08 * (F.col("b") == 2).cast("int") * F.col("c")
    return df.withColumn("y", (u < rate).cast("int")).withColumn("cohort", (F.col("id") % 5 == 0).cast("int")).cache()


def test_rows_are_counted_and_frequent_ones_dealt(spark, cases):
    out = m.weighted_rows(cases, ["a", "b", "y"])
    cells = {(r.a, r.b, r.y): r["count"] for r in cases.groupBy("a", "b", "y").count().collect()}
    mean = 4000 / len(cells)
    rows = out.collect()
    assert set(out.columns) == {"a", "b", "y", m.WEIGHT} and len(rows) <= 2 * len(cells)
    assert max(r[m.WEIGHT] for r in rows) <= mean + 1e-9 < max(cells.values())
    got = {}
    for r in rows:
        got[(r.a, r.b, r.y)] = got.get((r.a, r.b, r.y), 0) + r[m.WEIGHT]
    assert got == pytest.approx(cells)


def test_rows_stay_where_few_are_equal(spark, cases):
    assert m.weighted_rows(cases, ["id", "a", "y"]) is None
    assert m.weighted_rows(cases.where("id < 0"), ["a", "y"]) is None
    assert m.weighted_rows(cases.withColumn("s", F.lit("x")), ["a", "s"]) is None
    nulls = spark.createDataFrame([(None, 1)] * 40 + [(0.5, 0)] * 40, "a double, y int")
    assert sorted(((r.a, r.y) for r in m.weighted_rows(nulls, ["a", "y"]).distinct().collect()), key=str) == [(0.5, 0), (None, 1)]


@pytest.mark.parametrize("fit", [lambda df: m.fit_counterfactual(df, ["a", "b", "c"], "y", "cohort", rounds=8, depth=4),
                                 lambda df: m.fit_risk_gbt(df, ["a", "b", "c"], "y", rounds=4, depth=4)])
def test_model_is_that_of_the_rows(cases, monkeypatch, fit):
    new = fit(cases)
    monkeypatch.setattr(m, "FEWER", 10**9)
    old = fit(cases)
    assert new.stages[-1].getOrDefault("weightCol") == m.WEIGHT and not old.stages[-1].isDefined("weightCol")
    assert new.stages[-1].getNumTrees == old.stages[-1].getNumTrees
    both = m.score(new, m.score(old, cases, "before"), "now")
    assert both.where("abs(before - now) > 1e-9").count() == 0 and both.agg(F.count_distinct("now")).first()[0] > 10


def test_searches_are_those_of_the_rows(cases, monkeypatch):
    grid = {"maxDepth": [2, 4], "minInstancesPerNode": [1, 60, 700, 1500]}

    def both():
        found = m.grid_search(cases, ["a", "b", "c"], "y", "id", grid, rounds=2, k=2).collect()
        rounds = m.cv_rounds(cases, ["a", "b", "c"], "y", "id", rounds=3, k=2, depth=3).collect()
        return {(r.maxDepth, r.minInstancesPerNode): (r.auc, r.sd) for r in found} | {r.round: (r.auc, r.sd) for r in rounds}

    new = both()
    monkeypatch.setattr(m, "FEWER", 10**9)
    old = both()
    assert new.keys() == old.keys() and all(new[k] == pytest.approx(old[k], abs=1e-9) for k in old)
    assert len({round(new[4.0, float(n)][0], 6) for n in (1, 60, 700, 1500)}) >= 3

"""Rows with a missing outcome, risk or cohort: what each summary counts."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate, features, join, models, resample, standardize, summarize


def cases(spark, rows):
    return spark.createDataFrame(rows, "case_id string, entity int, period int, cohort int, outcome int, risk double")


def test_observed_and_expected_are_over_the_same_rows(spark):
    df = cases(spark, [("a", 1, 1, 1, 1, None), ("b", 1, 1, 1, 0, 0.5), ("c", 1, 1, 0, 1, 0.5), ("d", 1, 1, 0, None, 0.9)])
    r = standardize.relative_risk(df).first()
    assert (r.oe_1, r.oe_0) == (0.0, 2.0)
    assert standardize.oe_by(df, ["cohort"], skip_nulls=False).filter("oe_ratio IS NOT NULL").count() == 0
    assert standardize.relative_risk(df, skip_nulls=False).first().rr is None
    assert resample.bootstrap_rr(df, reps=1, method="poisson").filter("rep = 0").first().rr == 0.0


def test_rate_has_known_outcomes_only(spark):
    df = cases(spark, [("a", 1, 1, 1, 1, 0.5), ("b", 1, 1, 0, 1, 0.5), ("c", 1, 1, 0, 0, 0.5), ("d", 1, 2, 0, None, 0.5)])
    profile = df.select("entity").distinct()
    exceed = profile.withColumn("p", F.lit(0.0))
    assert standardize.entity_risk(df, profile, exceed).first().rate == pytest.approx(2 / 3)
    assert standardize.rr_summary(df).first().rate == pytest.approx(2 / 3)


def test_expectation_within_entity_ignores_unknown_outcomes(spark):
    df = cases(spark, [("a", 1, 1, 1, 1, None), ("b", 1, 1, 1, None, None), ("c", 1, 1, 0, 1, None), ("d", 1, 1, 0, 0, None)])
    assert standardize.oe_within_entity(df, "entity", "cohort", "outcome", ["period"]).first().oe_ratio == pytest.approx(2.0)


def test_labels_that_are_missing_are_not_counted(spark):
    df = spark.createDataFrame([(0.55, 1), (0.55, 0), (0.55, None), (0.55, None)], "p double, y int")
    ci = evaluate.calibration_ci(df, "p", "y").first()
    assert (ci.n, ci.pct) == (2, 50.0)
    assert evaluate.calibration(df, "p", "y", [0.0, 1.0], se=True).first().se == pytest.approx(math.sqrt(0.125))
    assert models.fit_intercept(df, "y").first().estimate == pytest.approx(0.0)


def test_rows_without_group_are_in_no_cell(spark):
    df = cases(spark, [("a", 1, 1, None, 0, None), ("b", 1, 1, None, None, None), ("c", 1, 1, 0, 0, None)])
    row = summarize.summary_matrix(df, "outcome", "cohort", {"n": F.count(F.lit(1)).cast("string")}).first()
    assert (row.control_alive, row.case_alive, row.case_dead) == ("1", None, None)


def test_bandwidth_is_that_of_the_group(spark):
    rows = [(g, float(x) * (100 if g else 1)) for g in (0, 1) for x in range(-5, 6)]
    df = spark.createDataFrame(rows, "g int, x double")
    alone = summarize.density(df.filter("g = 0"), "x", [0.0]).first().density
    both = summarize.density(df, "x", [0.0], by="g").filter("g = 0").first().density
    assert both == pytest.approx(alone)


def test_large_grid_meets_every_row_once(spark):
    rows, grid = spark.range(7).toDF("a"), spark.range(5000).toDF("b")
    out = join.expand_by(rows, grid)
    assert (out.count(), out.distinct().count()) == (35000, 35000)
    assert join.expand_by(rows, grid.limit(3)).count() == 21


def test_levels_are_judged_by_column(spark):
    df = spark.range(1500).select(F.col("id").alias("wide"), (F.col("id") % 2).alias("two"))
    assert len(features.levels_of(df, ["wide", "two"])["wide"]) == 1500
    for cols in (["wide"], ["wide", "two"]):
        with pytest.raises(ValueError):
            features.levels_of(df, cols, most=1000)

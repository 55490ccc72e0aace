"""Ratios on hand-written cases and identities that must hold."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import standardize as d, summarize as a
from riskframe.sources.admissions import admissions

SF = "/root/testdata/sf0.001"


def cases(spark, rows):
    return spark.createDataFrame(rows, "entity int, cohort int, outcome int, risk double")


def test_missing_and_zero_sides(spark):
    df = cases(spark, [(1, 0, 1, 0.5), (1, 1, 0, 0.5), (2, 0, 1, 0.5), (3, 0, 0, 0.5), (3, 1, 1, 0.5), (4, 1, 1, 0.0), (4, 0, 1, 0.5)])
    rr = {r.entity: r.rr for r in d.relative_risk(df).collect()}
    assert rr == {1: 0.0, 2: None, 3: None, 4: None}


def test_rr_is_one_when_risk_equals_outcome(spark):
    df = admissions(spark, SF, ["entity", "cohort", "outcome"]).withColumn("risk", F.col("outcome").cast("double"))
    assert {r.rr for r in d.relative_risk(df).collect()} <= {1.0, None}


def test_expected_sums_to_total_risk(spark):
    df = admissions(spark, SF, ["entity", "cohort", "outcome", "risk"])
    total = df.agg(F.sum("risk")).first()[0]
    assert d.oe_by(df, ["entity", "cohort"]).agg(F.sum("expect")).first()[0] == pytest.approx(total)


def test_odds_ratio_needs_four_cells(spark):
    df = cases(spark, [(1, 0, 0, 0.0), (1, 0, 1, 0.0), (1, 1, 0, 0.0), (1, 1, 1, 0.0), (1, 1, 1, 0.0), (2, 0, 0, 0.0), (2, 1, 1, 0.0)])
    out = {r.entity: (r.n_cells, r.odds_ratio) for r in d.odds_ratio_by(df, "entity", "cohort", "outcome").collect()}
    assert out == {1: (4, 2.0), 2: (2, None)}


def test_profile_keeps_an_entity_without_a_cohort(spark):
    df = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 0, 3), (2, 0, None, 1)], "entity int, cohort int, vent int, bed int")
    out = {r.entity: r.asDict() for r in d.entity_profile(df, "entity", "cohort", ["vent"], ["bed"]).collect()}
    assert out[1]["case_vent"] == 0.0 and out[1]["control_vent"] == 1.0 and out[1]["bed"] == 3
    assert out[2]["case_n"] is None and out[2]["control_n"] == 1 and out[2]["control_vent"] is None


def test_replicate_summaries_skip_null(spark):
    reps = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0)], "entity int, rep int, rr double")
    s = a.summarize_replicates(reps).first()
    assert (s.median, s.min, s.max, s.range) == (2.0, 1.0, 3.0, 2.0)
    assert a.exceed_prob(reps, 2.0).first().exceed == 0.5


def test_thin_cells_fall_back_to_the_entity_rate(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 0, "a"), (1, 1, 1, "b")], "entity int, cohort int, outcome int, x string")
    assert d.oe_within_entity(df, "entity", "cohort", "outcome", ["x"]).first().expect == 0.5

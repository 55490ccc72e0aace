"""Properties of fits: shrinkage, closed forms, imputation and scoring."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import effects as fx, evaluate as e, features as f, models as m
from riskframe.sources import io
from riskframe.sources.admissions import admissions

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ones(spark):
    return admissions(spark, SF, ["entity", "cohort", "outcome", "vent"]).filter("cohort = 1").cache()


def test_partial_pooling_shrinks_towards_the_mean(ones):
    fit = fx.fit_random_intercept(ones, "entity", "outcome")
    assert fit.converged
    mean = fit.beta["(Intercept)"]
    crude = {r.entity: r.effect0 for r in fx.crude_logit(ones, "entity", "outcome").collect()}
    for r in fit.effects.collect():
        if crude[r.entity] is not None:
            assert abs(r.effect0) <= abs(crude[r.entity] - mean) + 1e-3
    sizes = {r.entity: r.n for r in ones.groupBy("entity").agg(F.count("*").alias("n")).collect()}
    zero = {r.entity: r.effect0 for r in fit.effects.collect() if crude[r.entity] is None}
    small, large = min(zero, key=sizes.get), max(zero, key=sizes.get)
    assert abs(zero[small]) <= abs(zero[large])


def test_unpooled_effects_are_log_odds(spark):
    df = admissions(spark, SF, ["entity", "outcome"])
    fit = fx.fit_entity_effects(df, "entity", "outcome", pooling="none", tol=1e-6)
    crude = {r.entity: r.effect0 for r in fx.crude_logit(df, "entity", "outcome").collect()}
    assert all(r.effect0 == pytest.approx(crude[r.entity], abs=2e-3) for r in fit.effects.collect())


def test_entity_effects_are_recovered(spark):
    df = spark.range(60000).select((F.col("id") % 30).alias("entity"), (F.floor(F.col("id") / 30) % 2).alias("x"), "id")
    lp = F.when(F.col("entity") < 15, -1.0).otherwise(0.0) + F.col("x") * 0.5
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    df = df.withColumn("y", (u < 1 / (1 + F.exp(-lp))).cast("int"))
    fit = fx.fit_random_intercept(df, "entity", "y", ["x"])
    assert fit.beta["x1"] == pytest.approx(0.5, abs=0.06) and fit.tau2[0] == pytest.approx(0.25, abs=0.06)
    low = fit.effects.filter("entity < 15").agg(F.avg("effect0")).first()[0]
    assert low == pytest.approx(-0.5, abs=0.08)


def test_singular_entity_gives_null(spark):
    rows = [(1, 1, y) for y in (0, 1, 1)] + [(2, c, y) for c in (0, 1) for y in (0, 1, 1)]
    out = {r.entity: r.estimate for r in fx.logit_by(spark.createDataFrame(rows, "entity int, c int, y int"), "entity", "y", "c").collect()}
    assert out[1] is None and out[2] == pytest.approx(0.0, abs=1e-6)


def test_imputation_fills_and_keeps_what_was_known(spark):
    df = admissions(spark, "/root/testdata/sf0.001", ["case_id", "age", "vent", "male", "comorb", "ses"])
    df = df.withColumn("ses4", (F.col("ses") == 4).cast("int")).drop("ses")
    out = f.impute_chained(df, {"ses4": "logreg", "comorb": "pmm"}, "case_id", iters=1).cache()
    assert out.count() == df.count() and out.filter("comorb IS NULL OR ses4 IS NULL").count() == 0
    known = df.filter("comorb IS NOT NULL").select("case_id", F.col("comorb").alias("c0"))
    assert out.join(known, "case_id").filter("comorb <> c0").count() == 0
    donors = {r[0] for r in known.select("c0").distinct().collect()}
    assert {r[0] for r in out.select("comorb").distinct().collect()} <= donors


def test_design_drops_first_level_of_later_factors(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "b", "y", None), (3, "b", "y", 2.0)], "id int, f string, g string, v double")
    out = f.design_matrix(df, ["f", "v", "g"], ["f", "g"], "id")
    assert out.columns == ["id", "fa", "fb", "v", "gy", "features"] or out.columns == ["id", "fb", "v", "features"]
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_scoring_and_saved_model(spark, tmp_path):
    df = admissions(spark, "/root/testdata/sf0.001", ["case_id", "outcome", "age", "vent"]).withColumn(
        "y", ((F.col("age") > 40) | (F.col("vent") == 1)).cast("int"))
    model = m.fit_risk_rf(df, ["age", "vent"], "y", trees=5, depth=4)
    scored = m.score(model, df)
    assert e.auc(scored, "risk", "y").first().auc > 0.99
    io.save_model(model, str(tmp_path / "model"))
    again = m.score(io.load_model(str(tmp_path / "model")), df)
    assert scored.agg(F.sum("risk")).first()[0] == pytest.approx(again.agg(F.sum("risk")).first()[0])
    held = m.score_out_of_fold(df, lambda d: m.fit_risk_gbt(d, ["age", "vent"], "y", rounds=2), 2, "y", "case_id", 1)
    assert held.count() == df.count()


def test_intercept_model(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    row = m.fit_intercept(df, "y").first()
    assert row.estimate == pytest.approx(math.log(1 / 3))


def _logit_by_hand(rows, at):
    """Newton steps for one entity; rows (x..., n, d)."""
    import numpy as np
    x = np.array([[1.0, *r[:-2]] for r in rows])
    n, d = (np.array([float(r[i]) for r in rows]) for i in (-2, -1))
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.lstsq((x * (n * p * (1 - p))[:, None]).T @ x, x.T @ (d - n * p), rcond=1e-10)[0]
    return b[at]


def test_separate_fits_end_in_a_state(spark):
    """Large finite estimates stay, separated and singular entities are told from them."""
    cells = {
        "plain": [(0, 0, 9, 3), (1, 0, 8, 5), (0, 1, 7, 4), (1, 1, 6, 5)],
        "large": [(0, 0, 10**6, 1), (1, 0, 10**6, 10**6 - 1), (0, 1, 10, 5)],
        "complete": [(0, 0, 5, 0), (1, 0, 5, 5)],
        "partly": [(0, 0, 9, 3), (1, 0, 4, 4), (0, 1, 7, 4)],
        "constant": [(1, 0, 9, 3), (1, 1, 8, 5)],
        "aliased": [(0, 1, 9, 3), (1, 1, 8, 5)],
        "one outcome": [(0, 0, 9, 0), (1, 1, 8, 0)]}
    rows = [(e, *c) for e, some in cells.items() for c in some]
    df = spark.createDataFrame(rows, "e string, c int, v int, n int, d int")
    cases = df.selectExpr("e", "c", "v", "inline(array(struct(1 AS y, d AS times), struct(0 AS y, n - d AS times)))").where("times > 0")
    small = cases.where("times < 1000").selectExpr("e", "c", "v", "y", "explode(sequence(1, int(times))) AS i")
    large = cases.where("times >= 1000").selectExpr("e", "c", "v", "y", "explode(sequence(1, int(times))) AS i")
    got = {r.e: (r.estimate, r.state, r.score) for r in fx.logit_by(small.unionByName(large), "e", "y", "c", numerics=["v"]).collect()}
    assert {e: s for e, (_, s, _) in got.items()} == {
        "plain": "converged", "large": "converged", "complete": "separated", "partly": "separated", "constant": "singular",
        "aliased": "converged", "one outcome": "separated"}
    assert got["plain"][0] == pytest.approx(_logit_by_hand(cells["plain"], 1), abs=1e-6)
    assert got["large"][0] == pytest.approx(2 * math.log(10**6 - 1), rel=1e-6)
    assert got["aliased"][0] == pytest.approx(math.log(5 * 6 / (3 * 3)), abs=1e-6)
    assert all((e is None) == (s != "converged") and (s != "converged" or score < 1e-6) for e, s, score in got.values())

"""M and D15-D17: fitted models. Closed forms give SQL for saturated models; other fits report metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import complete
from ..lineage import cut, spread, store
from ..operators import effects as fx, evaluate as e, features as f, models as m, standardize as d, summarize as a
from ..sources.schema import ATTRIBUTES, FAILURES
from .registry import query
from .summaries_q import rounded

PLAIN = ["age", "comorb", "male", "vent", *FAILURES]
FEATURES = ["age", "ses.1", "ses.2", "ses.3", "ses.4", "comorb", "male", "vent", *FAILURES]
NAMES = [c.replace(".", "_") for c in FEATURES]
# Display names follow from the column names.
LABELS = {n: f"{n[2:]} failure" if n.startswith("f_") else n.replace("_", " level ") for n in [*NAMES, "cohort"]}


def model_rows(t):
    """Complete rows with one-hot socio-economic quartiles."""
    df = complete(t.adm("case_id", "entity", "cohort", "outcome", "ses", *PLAIN))
    wide = f.dummies_full(df, ["ses"], {"ses": [1, 2, 3, 4]})
    return wide.toDF(*[c.replace(".", "_") for c in wide.columns])


def matrix(t):
    """model_rows(), computed once over even partitions."""
    return cut(spread(model_rows(t), "case_id"))


def quality(df, name):
    df = store(df.select("risk", "outcome"))  # every case is scored once
    parts = e.auc(df, "risk", "outcome").select(F.round("auc", 3).alias("auc"), F.lit(1).alias("k"))
    more = e.brier(df, "risk", "outcome").select(F.round("brier", 3).alias("brier"), F.lit(1).alias("k"))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 3).alias("mean_risk"), F.lit(1).alias("k"))
    return parts.join(more, "k").join(size, "k").drop("k").withColumn("model", F.lit(name))


@query("m1_fit_counterfactual")
def _(t):
    df = matrix(t)
    model = m.fit_counterfactual(df, NAMES, "outcome", "cohort", rounds=10)
    scored = m.score(model, df.filter("cohort = 1"))
    return rounded(d.oe_by(scored, ["entity"]), "expect", "oe_ratio", "log_oe", digits=3)


@query("m2_fit_risk_gbt")
def _(t):
    df = matrix(t)
    return quality(m.score(m.fit_risk_gbt(df, NAMES, "outcome", rounds=10), df), "gbt")


@query("m3_fit_risk_rf")
def _(t):
    df = matrix(t)
    return quality(m.score(m.fit_risk_rf(df, NAMES, "outcome", trees=20, depth=8), df), "forest")


@query("m4_cv_rounds")
def _(t):
    out = m.cv_rounds(matrix(t), NAMES, "outcome", "case_id", rounds=5, k=2, depth=4)
    return rounded(out, "auc", "sd", digits=3)


@query("m5_grid_search")
def _(t):
    grid = {"stepSize": [0.1, 0.3], "maxDepth": [2, 4], "minInfoGain": [0.0], "minInstancesPerNode": [1]}
    return rounded(m.grid_search(matrix(t), NAMES, "outcome", "case_id", grid, rounds=3, k=2), "auc", "sd", digits=3)


@query("m6_fit_logit_intercept", """SELECT '(Intercept)' AS term, round(ln(d / (n - d)), 6) AS estimate, round(sqrt(1 / d + 1 / (n - d)), 6) AS std_error
FROM (SELECT sum(outcome)::DOUBLE AS d, count(*)::DOUBLE AS n FROM adm)""")
def _(t):
    return rounded(m.fit_intercept(t.adm("outcome"), "outcome"), "estimate", "std_error")


SATURATED = """WITH l AS ({levels}), b AS (SELECT * FROM l WHERE base)
SELECT '(Intercept)' AS term, round(ln(d / (n - d)), 5) AS estimate, round(sqrt(1 / d + 1 / (n - d)), 5) AS std_error FROM b
UNION ALL SELECT l.term, round(ln(l.d / (l.n - l.d)) - ln(b.d / (b.n - b.d)), 5), round(sqrt(1 / l.d + 1 / (l.n - l.d) + 1 / b.d + 1 / (b.n - b.d)), 5) FROM l, b WHERE NOT l.base"""


@query("m6_fit_logit_period", SATURATED.format(levels="""SELECT 'period_' || period AS term, period = 1995 AS base, sum(outcome)::DOUBLE AS d, count(*)::DOUBLE AS n FROM adm GROUP BY period"""))
def _(t):
    df = t.adm("period", "outcome").withColumn("period", F.col("period").cast("string"))
    model = m.fit_logit(df, "outcome ~ period")
    return rounded(m.coef_table(model, df).select("term", "estimate", "std_error"), "estimate", "std_error", digits=5)


@query("m18_coef_table", """WITH c AS (SELECT cohort, vent, sum(outcome)::DOUBLE AS d, count(*)::DOUBLE AS n FROM adm GROUP BY ALL),
w AS (SELECT max(CASE WHEN cohort = 0 AND vent = 0 THEN ln(d / (n - d)) END) AS l00, max(CASE WHEN cohort = 1 AND vent = 0 THEN ln(d / (n - d)) END) AS l10,
 max(CASE WHEN cohort = 0 AND vent = 1 THEN ln(d / (n - d)) END) AS l01, max(CASE WHEN cohort = 1 AND vent = 1 THEN ln(d / (n - d)) END) AS l11 FROM c)
SELECT '(Intercept)' AS term, round(l00, 5) AS estimate FROM w UNION ALL SELECT 'cohort', round(l10 - l00, 5) FROM w
UNION ALL SELECT 'vent', round(l01 - l00, 5) FROM w UNION ALL SELECT 'cohort:vent', round(l11 - l10 - l01 + l00, 5) FROM w""")
def _(t):
    df = t.adm("cohort", "vent", "outcome")
    table = m.coef_table(m.fit_logit(df, "outcome ~ cohort * vent"), df)
    return rounded(table.select("term", "estimate"), "estimate", digits=5)


@query("m6_fit_logit_adjusted")
def _(t):
    df = complete(t.adm("outcome", "age_cat", "payer", "vent", "period")).withColumn("age_cat", F.col("age_cat").cast("string"))
    return rounded(m.coef_table(m.fit_logit(df, "outcome ~ age_cat + payer + vent + period"), df), "estimate", "std_error", "z", "p_value", digits=4)


@query("m6_entity_effects_unpooled", "SELECT entity, CASE WHEN r > 0 AND r < 1 THEN round(ln(r / (1 - r)), 6) END AS effect0 FROM (SELECT entity, avg(outcome) AS r FROM adm WHERE cohort = 1 GROUP BY entity)")
def _(t):
    return rounded(fx.crude_logit(t.adm("entity", "cohort", "outcome").filter("cohort = 1"), "entity", "outcome"), "effect0")


@query("m6_entity_effects_adjusted")
def _(t):
    fit = fx.fit_entity_effects(t.adm("entity", "outcome", "age_cat", "vent"), "entity", "outcome", ["age_cat", "vent"], pooling="none")
    return rounded(fit.effects, "effect0", digits=4)


@query("m7_fit_random_intercept")
def _(t):
    fit = fx.fit_random_intercept(t.adm("entity", "cohort", "outcome", "age_cat", "vent").filter("cohort = 1"), "entity", "outcome", ["age_cat", "vent"])
    return rounded(fit.effects, "effect0", digits=4)


@query("m7_fit_random_slope")
def _(t):
    fit = fx.fit_entity_effects(t.adm("entity", "cohort", "outcome", "vent"), "entity", "outcome", ["cohort", "vent"], slope="cohort")
    return rounded(fit.effects, "effect0", "effect1", digits=4)


@query("m7_fit_entity_period")
def _(t):
    df = t.adm("entity", "period", "cohort", "outcome", "vent").filter("cohort = 1").withColumn("cell", F.concat_ws(":", "entity", "period"))
    return rounded(fx.fit_random_intercept(df, "cell", "outcome", ["vent"]).effects, "effect0", digits=4)


@query("m8_logit_by", """SELECT entity, CASE WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN round(ln(n00 * n11 / (n01 * n10)), 5) END AS estimate
FROM (SELECT entity, sum((outcome = 0 AND cohort = 0)::INT)::DOUBLE AS n00, sum((outcome = 0 AND cohort = 1)::INT)::DOUBLE AS n01,
 sum((outcome = 1 AND cohort = 0)::INT)::DOUBLE AS n10, sum((outcome = 1 AND cohort = 1)::INT)::DOUBLE AS n11 FROM adm GROUP BY entity)""")
def _(t):
    return rounded(fx.logit_by(t.adm("entity", "cohort", "outcome"), "entity", "outcome", "cohort").select("entity", "estimate"), "estimate", digits=5)


@query("m8_logit_by_adjusted", """WITH c AS (SELECT entity, cohort, outcome FROM adm WHERE comorb IS NOT NULL)
SELECT entity, true AS ended, true AS score_zero, true AS finite,
 max(cohort) > min(cohort) AND max(outcome) > min(outcome) AND min(CASE WHEN cohort = 1 THEN outcome END) < max(CASE WHEN cohort = 1 THEN outcome END) AS varied FROM c GROUP BY entity""")
def _(t):
    """Every fit ends; where it converged the score equations are 0 and the estimate is finite, and term and outcome vary."""
    df = t.adm("entity", "cohort", "outcome", "age_cat", "vent", "comorb")
    out = fx.logit_by(df, "entity", "outcome", "cohort", ["age_cat"], ["vent", "comorb"])
    own = complete(df).groupBy("entity").agg(
        ((F.max("cohort") > F.min("cohort")) & (F.max("outcome") > F.min("outcome")) & F.coalesce(
            F.min(F.when(F.col("cohort") == 1, F.col("outcome"))) < F.max(F.when(F.col("cohort") == 1, F.col("outcome"))), F.lit(False))).alias("varied"))
    good = F.col("state") == "converged"
    return out.join(own, "entity").select("entity", (F.col("state") != "open").alias("ended"), (~good | (F.col("score") < 1e-6)).alias("score_zero"),
                                          (good == F.col("estimate").isNotNull()).alias("finite"), "varied")


def entity_table(t):
    df = store(t.adm("entity", "period", "cohort", "outcome", "risk", *ATTRIBUTES), "entity")
    prof = d.entity_profile(df, "entity", "cohort", ["outcome"], ATTRIBUTES)
    vol = a.mean_annual(df, "entity", "period", {"cases_yr": F.count(F.lit(1)), "cohort_cases_yr": F.sum("cohort")})
    return cut(prof.join(d.rr_summary(df), "entity").join(vol, "entity").withColumn("high_rr", (F.col("rr") >= 2).cast("int")))


TREE_X = [*ATTRIBUTES, "rate", "cases_yr", "cohort_cases_yr"]


@query("m10_fit_tree")
def _(t):
    df = entity_table(t)
    model = m.fit_tree(df, "rr", TREE_X, depth=3)
    out = model.transform(complete(df, ["rr", *TREE_X])).groupBy(F.round("_mean", 4).alias("node_mean"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rr"), 4).alias("mean_rr"))


@query("m10_tree_text")
def _(t):
    df = entity_table(t)
    return m.tree_text(m.fit_tree(df, "high_rr", TREE_X, depth=3, min_split=10), df)


@query("m11_fit_tree_class")
def _(t):
    df = entity_table(t)
    df = d.quadrants(df.withColumn("oe_ratio", F.col("rr"))).drop("rel_class", "abs_class")
    model = m.fit_tree(df, "quadrant", TREE_X, task="class", depth=5, min_split=10)
    return model.transform(complete(df, ["quadrant", *TREE_X])).groupBy("quadrant", F.col("_code").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("m12_fit_entity_rf")
def _(t):
    df = entity_table(t).withColumn("high", (F.col("case_outcome") > 0.2).cast("double"))
    x = ["control_outcome", "teach", "highvolume", "n_cases", "cohort_cases_yr"]
    return rounded(m.importance(m.fit_entity_rf(df, "high", x), df, x), "importance", "relative", digits=4)


@query("m13_cv_compare")
def _(t):
    df = d.entity_profile(t.adm("entity", "cohort", "outcome", "vent", *ATTRIBUTES), "entity", "cohort", ["outcome", "vent"], ATTRIBUTES)
    control = df.select("entity", *ATTRIBUTES, F.col("control_outcome").alias("rate"), F.col("control_vent").alias("vent"))
    case = df.select("entity", *ATTRIBUTES, F.col("case_n").alias("n"), F.col("case_outcome").alias("rate"), F.col("case_vent").alias("vent"))
    table, scored = m.cv_compare(control, case, [*ATTRIBUTES, "vent"], "rate", "entity", k=3, repeats=1)
    return rounded(scored.select("entity", "n", *[c for c in scored.columns if c.startswith("pred_")]), "pred_gbt", "pred_forest", "pred_ridge", digits=4)


@query("m14_fit_logit_counts")
def _(t):
    df = t.adm("entity", "cohort", "outcome", "vent", *ATTRIBUTES).filter("cohort = 0").groupBy("entity").agg(
        F.sum("outcome").alias("dead"), F.sum(1 - F.col("outcome")).alias("alive"), F.avg("vent").alias("vent"), *[F.max(c).alias(c) for c in ATTRIBUTES])
    model, table = m.fit_logit_counts(df, "dead", "alive", [*ATTRIBUTES, "vent"], "entity")
    return rounded(table, "auc", digits=4)


@query("m15_importance")
def _(t):
    df = matrix(t)
    return rounded(m.importance(m.fit_risk_rf(df, NAMES, "outcome", trees=10, depth=6), df, NAMES, LABELS), "importance", "relative", digits=4)


@query("m16_score")
def _(t):
    df = matrix(t)
    train, rest = f.split(df, "case_id", 0.8, 50)
    model = m.fit_risk_rf(train, NAMES, "outcome", trees=10, depth=6)
    return quality(m.score(model, rest), "forest on held-out rows")


@query("m16_score_out_of_fold")
def _(t):
    df = matrix(t)
    scored = m.score_out_of_fold(df, lambda x: m.fit_risk_rf(x, NAMES, "outcome"), 2, "outcome", "case_id", 4)
    return quality(scored, "forest out of fold")


@query("m17_fit_risk_rf_cohort")
def _(t):
    df = matrix(t)
    names = ["cohort", *NAMES]
    return rounded(m.importance(m.fit_risk_rf(df, names, "outcome", trees=10, depth=6), df, names, LABELS), "importance", "relative", digits=4)


@query("d15_reliability_adjusted")
def _(t):
    fit = fx.fit_random_intercept(t.adm("entity", "cohort", "outcome", "age_cat", "vent").filter("cohort = 1"), "entity", "outcome", ["age_cat", "vent"])
    return rounded(fx.reliability_adjusted(fit), "rate", digits=3)


@query("d16_adjusted_by_period")
def _(t):
    df = t.adm("entity", "cohort", "period", "outcome", "vent").filter("cohort = 1")
    fit = fx.fit_entity_effects(df, "entity", "outcome", ["vent"], crossed=["period"])
    out = fx.adjusted_by_period(fit, "period")
    return rounded(out, *[c for c in out.columns if c != "period"], digits=3)


@query("d17_sensitivity")
def _(t):
    df = t.adm("entity", "cohort", "outcome", "age_cat", "vent").filter("cohort = 1")
    return rounded(fx.sensitivity(df, "entity", "outcome", ["age_cat", "vent"], ["vent"]), "with", "without", digits=3)

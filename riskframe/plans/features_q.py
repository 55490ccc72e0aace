"""F: feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import features as f, imputation as im, project as p
from ..sources.schema import FAILURES
from .registry import query
from .summaries_q import rounded

N = "CAST(count(*) AS BIGINT) AS n"
BINARY = ["male", "vent", *FAILURES]


def dummy_sql(cols, levels):
    return ", ".join(f'CAST(sum(CASE WHEN {c} = {v} THEN 1 WHEN {c} IS NOT NULL THEN 0 END) AS BIGINT) AS "{c}.{v}"' for c in cols for v in levels[c])


LEVELS = {"ses": [1, 2, 3, 4], **{c: [0, 1] for c in BINARY}}


@query("f1_dummies_full", f"SELECT entity, {dummy_sql(LEVELS, LEVELS)} FROM adm GROUP BY entity")
def _(t):
    wide = f.dummies_full(t.adm("entity", "ses", *BINARY), ["ses", *BINARY])
    return wide.groupBy("entity").agg(*[F.sum(f"`{c}`").alias(c) for c in wide.columns if c != "entity"])


@query("f2_design_matrix", """SELECT entity, CAST(count(*) AS BIGINT) AS n, sum((age_cat = 1)::INT)::DOUBLE AS age_cat1, sum((age_cat = 2)::INT)::DOUBLE AS age_cat2, sum((age_cat = 3)::INT)::DOUBLE AS age_cat3,
sum((age_cat = 4)::INT)::DOUBLE AS age_cat4, sum(vent)::DOUBLE AS vent1, sum(comorb) AS comorb, sum((ses = 2)::INT)::DOUBLE AS ses2, sum((ses = 3)::INT)::DOUBLE AS ses3, sum((ses = 4)::INT)::DOUBLE AS ses4
FROM adm WHERE comorb IS NOT NULL AND ses IS NOT NULL GROUP BY entity""")
def _(t):
    df = t.adm("case_id", "entity", "age_cat", "vent", "comorb", "ses")
    x = f.design_matrix(df, ["age_cat", "vent", "comorb", "ses"], ["age_cat", "vent", "ses"], "case_id", keep=["entity"])
    cols = [c for c in x.columns if c not in ("case_id", "entity", "features")]
    return x.groupBy("entity").agg(F.count("features").alias("n"), *[F.sum(c).alias(c) for c in cols])


@query("f3_collapse_levels", f"SELECT CASE WHEN race >= 4 THEN 'other' ELSE race::VARCHAR END AS race, {N} FROM adm GROUP BY ALL")
def _(t):
    return t.adm("race").groupBy(p.collapse_levels("race", 4).alias("race")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_feature_map", """SELECT CAST(row_number() OVER (ORDER BY o, v) - 1 AS INTEGER) AS idx, feature, 'q' AS type FROM (
SELECT 0 AS o, 0 AS v, 'age' AS feature UNION ALL SELECT DISTINCT 1, ses, 'ses.' || ses FROM adm WHERE ses IS NOT NULL UNION ALL SELECT DISTINCT 2, male, 'male.' || male FROM adm)""")
def _(t):
    df = t.adm("age", "ses", "male")
    return f.feature_map(df, f.dummies_full(df, ["ses", "male"]).columns)


def h32(text):
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


@query("f5_split", f"SELECT CASE WHEN {h32("'50:' || case_id")} / 4294967296.0::DOUBLE < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS part, cohort, {N} FROM adm GROUP BY ALL")
def _(t):
    train, test = f.split(t.adm("case_id", "cohort"), "case_id", 0.8, 50)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "cohort").agg(F.count(F.lit(1)).alias("n"))


@query("f6_impute_chained")
def _(t):
    df = t.adm("case_id", "cohort", "age", "ses", "male", "vent", "f_cardiac", "comorb")
    wide = f.dummies_full(df, ["ses"])
    methods = {**{f"ses.{v}": "logreg" for v in (2, 3, 4)}, "comorb": "pmm"}
    done = f.impute_chained(wide.drop("ses.1"), methods, "case_id", seed=3, exclude=["cohort"])
    return done.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"`{c}`"), 4).alias(c) for c in methods],
                                      *[F.sum(F.col(f"`{c}`").isNull().cast("int")).alias(f"missing {c}") for c in methods])


@query("f8_drop_like", f"SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS "{c}.1"' for c in BINARY)} FROM adm")
def _(t):
    wide = p.drop_like(f.dummies_full(t.adm("race", *BINARY), ["race", *BINARY]), r"^race|\.0$")
    return wide.agg(*[F.sum(f"`{c}`").alias(c) for c in wide.columns])


@query("f9_complete_cases", f"SELECT entity, {N}, round(avg(comorb), 6) AS comorb FROM adm WHERE ses IS NOT NULL AND comorb IS NOT NULL GROUP BY entity")
def _(t):
    kept = p.complete_cases(t.adm("entity", "age", "ses", "comorb", "male", "vent"))
    return rounded(kept.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("comorb").alias("comorb")), "comorb")


@query("f10_assign_folds", f"SELECT outcome, CAST({h32("'9:' || outcome || ':' || case_id")} % 5 AS INTEGER) AS fold, {N} FROM adm GROUP BY ALL")
def _(t):
    return f.assign_folds(t.adm("case_id", "outcome"), 5, "outcome", "case_id", 9).groupBy("outcome", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("f6_impute_multiple", """SELECT CAST(i AS INTEGER) AS imputation, cohort, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(comorb) AS BIGINT) AS filled,
 CAST(0 AS BIGINT) AS missing, true AS kept, true AS whole, true AS pooled FROM adm, range(1, 4) r(i) GROUP BY i, cohort""")
def _(t):
    """Three completed tables of five sweeps: known values stay, filled ones are values of donors, and the total variance
    of the pooled mean lies above that within the imputations."""
    df = t.adm("case_id", "cohort", "age", "ses", "male", "vent", "f_cardiac", "comorb")
    wide = f.dummies_full(df, ["ses"]).drop("ses.1")
    methods = {**{f"ses.{v}": "logreg" for v in (2, 3, 4)}, "comorb": "pmm"}
    done = im.impute_multiple(wide, methods, "case_id", seed=3, exclude=["cohort"])
    known = df.select("case_id", F.col("comorb").alias("was"))
    empty = sum((F.col(f"`{c}`").isNull().cast("int") for c in methods), F.lit(0))
    per = done.join(known, "case_id").groupBy("imputation", "cohort").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("was").isNull().cast("bigint")).alias("filled"), F.sum(empty).cast("bigint").alias("missing"),
        F.min(F.coalesce(F.col("was") == F.col("comorb"), F.lit(True))).alias("kept"), F.min(F.col("comorb") == F.floor("comorb")).alias("whole"),
        F.avg("comorb").alias("estimate"), (F.var_samp("comorb") / F.count(F.lit(1))).alias("variance"))
    per = cut(per)
    pooled = im.pool(per, ["cohort"]).select("cohort", ((F.col("m") == 3) & (F.col("total") >= F.col("within"))).alias("pooled"))
    return per.drop("estimate", "variance").join(pooled, "cohort")

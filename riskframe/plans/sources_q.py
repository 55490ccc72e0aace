"""S: readers and writers. Written tables go to a fresh folder beside the checkpoints and are read back."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..lineage import checkpoint_dir
from ..operators import standardize, summarize
from ..sources import io
from .registry import Inputs, query

RISK_SCHEMA = StructType([
    StructField("case_id", StringType()), StructField("entity", LongType()), StructField("cohort", IntegerType()),
    StructField("outcome", IntegerType()), StructField("risk", DoubleType())])

RISK_SQL = """SELECT entity, CAST(count(*) AS BIGINT) AS n, CAST(sum(outcome) AS BIGINT) AS dead,
  round(sum(risk), 6) AS expect FROM adm GROUP BY entity"""


def scratch(t: Inputs) -> str:
    return f"{checkpoint_dir(t.spark)}/riskframe-{uuid.uuid4().hex}"


def per_entity(df):
    return df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").cast("bigint").alias("dead"),
                                    F.round(F.sum("risk"), 6).alias("expect"))


def risk_cases(t: Inputs):
    return t.adm(*RISK_SCHEMA.fieldNames())


@query("s1_read_facts", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey::VARCHAR) AS BIGINT) AS n_ids,
       round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY ALL""")
def _(t):
    df = io.read_facts(t.spark, f"{t.folder}/lineitem.parquet", text_ids=["l_suppkey"])
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_ids"),
        F.round(F.sum("l_quantity"), 6).alias("qty"))


@query("s2_read_csv", RISK_SQL)
def _(t):
    path = scratch(t)
    risk_cases(t).write.option("header", True).csv(path)
    return per_entity(io.read_csv(t.spark, path, RISK_SCHEMA))


BUNDLE_SQL = """SELECT 'cases' AS tbl, CAST(count(*) AS BIGINT) AS n, round(sum(risk), 6) AS total FROM adm
UNION ALL SELECT 'entities', CAST(count(DISTINCT entity) AS BIGINT), round(sum(entity)::DOUBLE, 6) FROM (SELECT DISTINCT entity FROM adm)"""


def _bundle(t):
    path = scratch(t)
    cases = risk_cases(t)
    io.save_bundle(path, {"cases": cases, "entities": cases.select("entity").distinct()})
    return io.load_bundle(t.spark, path)


def _bundle_sizes(tables):
    a = tables["cases"].agg(F.lit("cases").alias("tbl"), F.count(F.lit(1)).alias("n"), F.round(F.sum("risk"), 6).alias("total"))
    b = tables["entities"].agg(F.lit("entities").alias("tbl"), F.count(F.lit(1)).alias("n"),
                               F.round(F.sum("entity").cast("double"), 6).alias("total"))
    return a.unionByName(b)


@query("s3_load_bundle", BUNDLE_SQL)
def _(t):
    return _bundle_sizes(_bundle(t))


@query("s4_write_csv", "SELECT entity, cohort, round(obs, 6) AS obs, round(expect, 6) AS expect FROM (SELECT entity, cohort, sum(outcome)::DOUBLE AS obs, sum(risk) AS expect FROM adm GROUP BY ALL)")
def _(t):
    path = scratch(t)
    oe = standardize.oe_by(risk_cases(t), ["entity", "cohort"]).select("entity", "cohort", "obs", "expect")
    io.write_csv(oe, path)
    back = io.read_csv(t.spark, path, "entity bigint, cohort int, obs double, expect double")
    return back.select("entity", "cohort", F.round("obs", 6).alias("obs"), F.round("expect", 6).alias("expect"))


@query("s5_save_bundle", """SELECT CAST(period AS INTEGER) AS period, CAST(count(*) AS BIGINT) AS n, round(avg(outcome), 6) AS rate
FROM adm GROUP BY period""")
def _(t):
    path = scratch(t)
    io.save_bundle(path, {"cases": t.adm("entity", "period", "outcome")}, partition_by={"cases": ["period"]})
    cases = io.load_bundle(t.spark, path, ["cases"])["cases"]
    return cases.groupBy(F.col("period").cast("int").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("outcome"), 6).alias("rate"))


@query("s6_write_report", """
SELECT 'by_cohort' AS sheet, cohort::VARCHAR AS level, round(avg(outcome), 6) AS rate FROM adm GROUP BY cohort
UNION ALL SELECT 'by_period', period::VARCHAR, round(avg(outcome), 6) FROM adm GROUP BY period""")
def _(t):
    path = scratch(t)
    df = t.adm("cohort", "period", "outcome")
    sheets = {f"by_{k}": summarize.rate_by(df, k, "outcome").select(F.col(k).cast("string").alias("level"), "rate")
              for k in ("cohort", "period")}
    io.write_report(path, sheets)
    parts = [io.read_csv(t.spark, f"{path}/{name}", "level string, rate double").withColumn("sheet", F.lit(name))
             for name in sheets]
    return parts[0].unionByName(parts[1]).select("sheet", "level", F.round("rate", 6).alias("rate"))


@query("s7_save_load_model")
def _(t):
    df = t.adm("cohort", "age", "vent", "f_cardiac", "outcome")
    steps = [VectorAssembler(inputCols=["age", "vent", "f_cardiac"], outputCol="features"),
             LogisticRegression(featuresCol="features", labelCol="outcome", maxIter=10)]
    model = Pipeline(stages=steps).fit(df)
    path = scratch(t)
    io.save_model(model, path)
    again = io.load_model(path)
    prob = vector_to_array("probability")
    return (again.transform(df).groupBy("cohort")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get(prob, 1)), 6).alias("mean_risk")))

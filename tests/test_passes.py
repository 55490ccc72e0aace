"""Tables that several steps read are computed once, and loops leave no trail of tables."""

import os

from pyspark.sql import functions as sf

from riskframe.lineage import checkpoint_dir
from riskframe.operators import features as f
from riskframe.plans import catalog, models_q
from riskframe.plans.registry import Inputs

SMALL = "/root/testdata/sf0.001"


def files(spark):
    found = {}
    for folder, _, names in os.walk(checkpoint_dir(spark).removeprefix("file:")):
        found |= {f"{folder}/{n}": os.path.getsize(f"{folder}/{n}") for n in names if n.startswith("part-")}
    return found


def reads_lines(df):
    return any("lineitem" in x for x in df.inputFiles())


def test_entity_table_is_computed_once(spark):
    assert not reads_lines(models_q.entity_table(Inputs(spark, SMALL)))


def test_headline_reads_its_cases_once(spark):
    assert not reads_lines(catalog.QUERIES["a14_headline"](spark, SMALL))


def test_sweeps_leave_no_tables(spark):
    rows = [(i, float(i % 7), float(i % 3 == 0) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, b double")
    left = []
    for sweeps in (1, 4):
        before = set(files(spark))
        assert f.impute_chained(df, {"b": "logreg"}, "id", iters=sweeps).where("b IS NULL").count() == 0
        left.append(len(set(files(spark)) - before))
    assert left[1] <= left[0]


def test_cases_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @sf.udf("double")
    def risk(x):
        seen.add(1)
        return x / 100

    df = spark.range(100).select(risk("id").alias("risk"), (sf.col("id") % 2).alias("outcome"))
    assert models_q.quality(df, "any").first().n == 100 and seen.value == 100

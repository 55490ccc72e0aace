"""Readers, writers and the case view."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from riskframe.sources import io
from riskframe.sources.admissions import admissions
from riskframe.sources.schema import CASES, check_columns

SF = "/root/testdata/sf0.001"


def test_facts_get_lower_names_text_ids_and_nulls_for_nan(spark, tmp_path):
    df = spark.createDataFrame([(7, float("nan")), (8, 1.5)], "KEY long, Age double")
    df.write.parquet(str(tmp_path / "facts"))
    out = io.read_facts(spark, str(tmp_path / "facts"), text_ids=["key"])
    assert out.dtypes == [("key", "string"), ("age", "double")]
    assert sorted(map(tuple, out.collect())) == [("7", None), ("8", 1.5)]


def test_declared_schema_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    good = StructType([StructField("a", IntegerType()), StructField("b", DoubleType())])
    assert check_columns(df, good) is df
    with pytest.raises(ValueError):
        check_columns(df, StructType([StructField("c", IntegerType())]))
    with pytest.raises(ValueError):
        io.read_facts(spark, str(tmp_path), fmt="csv")


def test_csv_and_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 0.25)], "a int, b string, c double")
    io.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    io.save_bundle(str(tmp_path / "all"), {"one": df, "two": df.filter("a = 1")}, {"one": ["b"]})
    tables = io.load_bundle(spark, str(tmp_path / "all"))
    assert {n: t.count() for n, t in tables.items()} == {"one": 2, "two": 1}


def test_case_view_has_the_declared_schema_and_unique_ids(spark):
    df = check_columns(admissions(spark, SF), CASES)
    n, ids = df.agg(F.count("*"), F.count_distinct("case_id")).first()
    assert n == ids == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_case_view_joins_only_what_the_columns_need(spark):
    def scans(*columns):
        plan = admissions(spark, SF, columns)._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan parquet")
    assert scans("entity", "outcome", "vent") == 1
    assert scans("cohort") == 2
    assert scans("risk", "cohort") == 3
    assert admissions(spark, SF, ["vent"]).count() == admissions(spark, SF).count()


def test_ids_are_unique_at_the_largest_scale(spark):
    df = admissions(spark, "/root/testdata/sf0.1", ["case_id"])
    n, ids = df.agg(F.count("*"), F.count_distinct("case_id")).first()
    assert n == ids

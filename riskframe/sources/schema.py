"""Declared schema of a case table and the labels of its coded columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

CASES = StructType([
    StructField("case_id", StringType()),
    StructField("entity", LongType()),
    StructField("cohort", IntegerType()),
    StructField("outcome", IntegerType()),
    StructField("period", IntegerType()),
    StructField("age", DoubleType()),
    StructField("age_cat", IntegerType()),
    StructField("male", IntegerType()),
    StructField("race", IntegerType()),
    StructField("ses", IntegerType()),
    StructField("comorb", DoubleType()),
    StructField("vent", IntegerType()),
    StructField("f_cardiac", IntegerType()),
    StructField("f_neuro", IntegerType()),
    StructField("f_heme", IntegerType()),
    StructField("f_liver", IntegerType()),
    StructField("f_renal", IntegerType()),
    StructField("medicare", IntegerType()),
    StructField("medicaid", IntegerType()),
    StructField("private", IntegerType()),
    StructField("otherins", IntegerType()),
    StructField("payer", StringType()),
    StructField("teach", IntegerType()),
    StructField("highvolume", IntegerType()),
    StructField("bedsize", IntegerType()),
    StructField("region", IntegerType()),
    StructField("stratum", LongType()),
    StructField("weight", LongType()),
    StructField("risk", DoubleType()),
])

FAILURES = ["f_cardiac", "f_neuro", "f_heme", "f_liver", "f_renal"]
INDICATORS = ["vent", *FAILURES]
ATTRIBUTES = ["teach", "highvolume", "bedsize", "region"]
PAYER_FLAGS = ["medicare", "medicaid", "private", "otherins"]

# Level labels in level order.
PAYERS = ["Medicare", "Medicaid", "Private", "Other"]
REGIONS = ["Northeast", "Midwest", "South", "West"]
TEACHING = ["Rural", "Urban non-teaching", "Urban teaching"]
BEDSIZES = ["Small", "Medium", "Large"]
VOLUMES = ["Low", "High"]


def check_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Raise if a declared column is missing or has another type; keep extra columns."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} instead of {f.dataType}"
             for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("table does not fit the declared schema: " + "; ".join(wrong))
    return df

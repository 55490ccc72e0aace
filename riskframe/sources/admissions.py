"""A case table derived from the order-line test tables.

Only the tables that the requested columns need are joined: every line has exactly one
order, part, supplier, customer and nation, so leaving a join out changes no row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import case_when
from .schema import CASES, FAILURES, PAYERS, PAYER_FLAGS

# Fixed values of the case view.
FAILURE_MODULI = {"f_cardiac": 3, "f_neuro": 5, "f_heme": 7, "f_liver": 11, "f_renal": 13}
SEGMENTS = {"medicare": "BUILDING", "medicaid": "AUTOMOBILE", "private": "MACHINERY", "otherins": "HOUSEHOLD"}

_FROM_ORDERS = {"period", "comorb"}
_FROM_CUSTOMER = {"male", "race", "ses", *PAYER_FLAGS, "payer"}
_FROM_PART = {"cohort"}
_FROM_SUPPLIER = {"stratum"}
_FROM_NATION = {"region"}


def _closure(columns: set[str]) -> set[str]:
    need = set(columns)
    if "risk" in need:
        need |= {"vent", "comorb", "age_cat", "f_cardiac"}
    if "age_cat" in need:
        need.add("age")
    if "payer" in need:
        need |= set(PAYER_FLAGS)
    return need


def admissions(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The case view with the requested columns (all by default)."""
    wanted = list(columns) if columns is not None else CASES.fieldNames()
    need = _closure(set(wanted))

    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    df = table("lineitem")
    customer, nation = need & _FROM_CUSTOMER, need & _FROM_NATION
    if customer or need & _FROM_ORDERS:
        df = df.join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if customer:
        df = df.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    if need & _FROM_PART:
        df = df.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    if nation or need & _FROM_SUPPLIER:
        df = df.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if nation:
        df = df.join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))

    c = F.col
    base = {
        "case_id": lambda: F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                       F.round(c("l_extendedprice") * 100).cast("bigint")),
        "entity": lambda: c("l_suppkey"),
        "cohort": lambda: (c("p_size") == 1).cast("int"),
        "outcome": lambda: ((c("l_returnflag") == "R") & (c("l_linestatus") == "F")).cast("int"),
        "period": lambda: F.year("o_orderdate"),
        "age": lambda: F.lit(17.0) + c("l_quantity"),
        "male": lambda: (c("c_custkey") % 2).cast("int"),
        "race": lambda: (c("c_nationkey") % 6 + 1).cast("int"),
        "ses": lambda: F.when(c("c_acctbal") >= 0, 1 + sum(
            ((c("c_acctbal") >= b).cast("int") for b in (2500, 5000, 7500)), F.lit(0))),
        "comorb": lambda: F.when(c("o_orderpriority") != "4-NOT SPECIFIED",
                                 F.floor(c("o_totalprice") / 25000).cast("double")),
        "vent": lambda: (c("l_discount") >= 0.08).cast("int"),
        "teach": lambda: (c("l_suppkey") % 3 + 1).cast("int"),
        "highvolume": lambda: (c("l_suppkey") % 2).cast("int"),
        "bedsize": lambda: (F.floor(c("l_suppkey") / 3) % 3 + 1).cast("int"),
        "region": lambda: (c("n_regionkey") % 4 + 1).cast("int"),
        "stratum": lambda: c("s_nationkey").cast("bigint"),
        "weight": lambda: (F.round(c("l_tax") * 100) + 1).cast("bigint"),
    }
    for name in FAILURES:
        base[name] = lambda k=FAILURE_MODULI[name]: (c("l_partkey") % k == 0).cast("int")
    for name, segment in SEGMENTS.items():
        base[name] = lambda s=segment: (c("c_mktsegment") == s).cast("int")

    df = df.select(*[make().alias(name) for name, make in base.items() if name in need])
    derived = {}
    if "age_cat" in need:
        derived["age_cat"] = F.when(c("age") < 30, 1).when(c("age") < 50, 2).when(c("age") < 60, 3).otherwise(4)
    if "payer" in need:
        derived["payer"] = case_when(*[(c(f) == 1, p) for f, p in zip(PAYER_FLAGS, PAYERS)])
    df = df.withColumns(derived)
    if "risk" in need:
        df = df.withColumn("risk", F.lit(0.02) + F.lit(0.20) * c("vent")
                           + F.lit(0.005) * F.coalesce(c("comorb"), F.lit(0.0))
                           + F.lit(0.01) * c("age_cat") + F.lit(0.03) * c("f_cardiac"))
    return df.select(*wanted)

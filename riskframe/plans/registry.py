"""Collects queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.admissions import admissions

# The case view in SQL. Every query below may refer to it as `adm`.
ADM_SQL = """adm0 AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS case_id,
         l_suppkey AS entity,
         CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS cohort,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS outcome,
         CAST(year(o_orderdate) AS INTEGER) AS period,
         17.0::DOUBLE + l_quantity AS age,
         CASE WHEN l_quantity < 13 THEN 1 WHEN l_quantity < 33 THEN 2 WHEN l_quantity < 43 THEN 3 ELSE 4 END AS age_cat,
         CAST(c_custkey % 2 AS INTEGER) AS male,
         CAST(1 + c_nationkey % 6 AS INTEGER) AS race,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 5000 THEN 2
              WHEN c_acctbal < 7500 THEN 3 ELSE 4 END AS ses,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN floor(o_totalprice / 25000)::DOUBLE END AS comorb,
         CASE WHEN l_discount >= 0.08::DOUBLE THEN 1 ELSE 0 END AS vent,
         CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS f_cardiac,
         CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS f_neuro,
         CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS f_heme,
         CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS f_liver,
         CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS f_renal,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS medicare,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS medicaid,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS private,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS otherins,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Medicare' WHEN 'AUTOMOBILE' THEN 'Medicaid'
              WHEN 'MACHINERY' THEN 'Private' WHEN 'HOUSEHOLD' THEN 'Other' END AS payer,
         CAST(1 + l_suppkey % 3 AS INTEGER) AS teach,
         CAST(l_suppkey % 2 AS INTEGER) AS highvolume,
         CAST(1 + (l_suppkey // 3) % 3 AS INTEGER) AS bedsize,
         CAST(1 + n_regionkey % 4 AS INTEGER) AS region,
         CAST(s_nationkey AS BIGINT) AS stratum,
         CAST(1 + round(100 * l_tax) AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey),
adm AS (
  SELECT *, 0.02::DOUBLE + 0.20::DOUBLE * vent + 0.005::DOUBLE * coalesce(comorb, 0)
            + 0.01::DOUBLE * age_cat + 0.03::DOUBLE * f_cardiac AS risk
  FROM adm0)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Inputs:
    """The tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def adm(self, *columns: str) -> DataFrame:
        return admissions(self.spark, self.folder, columns or None)


def query(name: str, sql: str | None = None):
    """Register fn(inputs) under a name; sql may start with WITH and may use `adm`."""
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                ORACLE[name] = f"WITH RECURSIVE {ADM_SQL},\n{body[15:]}"
            elif body[:5].upper() == "WITH ":
                ORACLE[name] = f"WITH {ADM_SQL},\n{body[5:]}"
            else:
                ORACLE[name] = f"WITH {ADM_SQL}\n{body}"
        return fn
    return register


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

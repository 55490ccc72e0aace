"""Distributed ranks and quantiles against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from riskframe.operators import evaluate, order, ordered


def table(spark, values, schema="g int, x double"):
    return spark.createDataFrame(values, schema)


def test_quantiles_type_7(spark):
    df = table(spark, [(1, v) for v in (1.0, 2.0, 4.0, 9.0)])
    row = ordered.quantiles(df, "x", [0.1, 0.25, 0.5]).first()
    assert [round(v, 9) for v in row] == [1.3, 1.75, 3.0]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=80))
def test_quantiles_and_midranks_match_numpy(spark, pairs):
    df = table(spark, [(g, float(v)) for g, v in pairs])
    probs = [0.0, 0.3, 0.5, 0.95, 1.0]
    got = {r.g: list(r)[1:] for r in ordered.quantiles(df, "x", probs, ["g"]).collect()}
    ranks = {(r.g, r.x): r.midrank for r in ordered.midranks(df, "x", ["g"]).collect()}
    for g in {p[0] for p in pairs}:
        x = np.array([v for h, v in pairs if h == g], dtype=float)
        assert got[g] == pytest.approx(list(np.quantile(x, probs)))
        for v in set(x):
            assert ranks[(g, v)] == np.sum(x < v) + (np.sum(x == v) + 1) / 2


def test_midranks_with_ties(spark):
    df = table(spark, [(1, v) for v in (1.0, 1.0, 2.0, 3.0, 3.0, 3.0)])
    assert {r.x: r.midrank for r in ordered.midranks(df, "x").collect()} == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0}


def test_running_sums_over_many_values(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"), F.lit(1).alias("n"))
    run = ordered.running_sums(df, "v", ["n"])
    assert run.filter(F.col("prev_n") != F.col("v")).count() == 0
    down = ordered.running_sums(df, "v", ["n"], descending=True)
    assert down.filter(F.col("prev_n") != 4999 - F.col("v")).count() == 0


def test_row_index_is_dense_in_each_group(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    out = ordered.row_index(df, "k", ["g"], blocks=16)
    per = out.groupBy("g").agg(F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    assert {(r.g, r.d, r.lo, r.hi) for r in per.collect()} == {(1, 1000, 0, 999), (0, 2000, 0, 1999)}


def test_auc_counts_ties_as_half(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.9, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    wins = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, y in rows if y for b, z in rows if not z]
    assert evaluate.auc(df, "s", "y").first().auc == pytest.approx(sum(wins) / len(wins))
    last = evaluate.roc_curve(df, "s", "y").orderBy("threshold").first()
    assert (last.tpr, last.fpr) == (1.0, 1.0)


def test_order_levels_and_median_flag(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", None)], "c string, v double")
    assert {r.c: r.position for r in order.order_levels(df, "c", "v").collect()} == {"b": 1, "a": 2, "c": 3, "d": None}
    flags = {r.c: r.above for r in order.flag_above_median(df, "v").collect()}
    assert flags == {"a": False, "b": False, "c": False, "d": None}

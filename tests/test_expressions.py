"""Null rules, rounding, binning and text on hand-written rows."""

from pyspark.sql import functions as F

from riskframe.functions import nulls, scalar as s
from riskframe.operators import join, project, reshape, summarize


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_aggregates_skip_or_propagate_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    for agg, skipped in ((F.avg, 1.0), (F.max, 1.0), (F.sum, 1.0)):
        out = {r.g: (r.k, r.s) for r in df.groupBy("g").agg(nulls.aggregate(agg, "x").alias("k"),
                                                            nulls.strict(agg, "x").alias("s")).collect()}
        assert out["a"] == (skipped, None) and out["b"][0] == out["b"][1]


def test_conditionals(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    assert column(df, nulls.if_else(F.col("x") == 1, F.lit("y"), F.lit("n"))) == ["y", "n", None]
    assert column(df, nulls.in_set("x", [1])) == [True, False, False]
    assert column(df, s.case_when((F.col("x") == 1, "one"), (F.col("x") == 0, "zero"))) == ["one", "zero", None]
    assert column(df.agg(nulls.n_distinct_with_null("x")), "*") == [3]


def test_division_and_logs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert column(df, nulls.ratio("a", "b")) == [None, None, 0.5]
    assert column(df, nulls.ln_positive("b"))[:2] == [None, None]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert column(nulls.null_inf(odd, ["x"]), "x") == [None, None, None, 2.0]
    assert nulls.complete(odd).count() == 2


def test_complete_over_many_derived_columns_plans_fast(spark):
    df = spark.range(5).select("id", *[((F.col("id") + i) % 3).alias(f"c{i}") for i in range(20)])
    assert nulls.complete(df).checkpoint().count() == 5


def test_rounding_and_bins(spark):
    half = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert column(half, s.round_half_even("x")) == [0.0, 2.0, 2.0]
    edges = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (1.0,), (1.2,)], "x double")
    assert column(edges, s.cut_bins("x", [0.0, 0.1, 1.0])) == [1, 1, 2, 2, None]
    assert column(edges, s.cut_bins("x", [0.0, 0.1, 1.0], right=False)) == [1, 2, 2, 2, None]
    assert s.cut_labels([0, 0.1, 1]) == ["[0,0.1]", "(0.1,1]"]


def test_text(spark):
    df = spark.createDataFrame([("a1b1", None)], "x string, y string")
    assert column(df, s.remove("x", "1")) == ["ab1"]
    assert column(df, s.replace_first("x", "1", "$")) == ["a$b1"]
    assert column(df, s.paste(["x", "y"], "/")) == ["a1b1/NA"]
    assert column(df, s.title_case(F.lit("urban non-teaching"))) == ["Urban Non-teaching"]
    assert column(df, s.fmt_mean_sd(F.lit(1.234), F.lit(None).cast("double"))) == ["1.23 (NA)"]
    assert column(df, s.fmt_int(F.lit(1234567))) == ["1,234,567"]


def test_from_dummies_and_recode(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (0, 0), (1, 1)], "a int, b int")
    assert column(df, s.from_dummies(["a", "b"], ["A", "B"])) == ["A", "B", None, None]
    assert column(df, s.recode("a", {1: "one"})) == ["one", None, "one", "one"][:1] + [None, None, "one"]


def test_column_rules_and_labels(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a_x int, a_y int, b_x int, c int")
    assert project.select_cols(df, project.Cols(starts="a_")).columns == ["a_x", "a_y"]
    assert project.select_cols(df, project.Cols(first="a_y", last="c"), drop=["b_x"]).columns == ["a_y", "c"]
    assert project.cohort_view(df, "a_", ["c"]).columns == ["c", "x", "y"]
    assert project.prefix_names(df, "z_", ["c"]).columns == ["z_a_x", "z_a_y", "z_b_x", "c"]
    assert project.labels_of(project.with_labels(df, {"c": "Sea"}))["c"] == "Sea"


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "k int, b string")
    assert join.join_inner(a, b, "k").count() == 0
    assert [tuple(r) for r in join.join_inner(a, b, "k", match_nulls=True).collect()] == [(None, "y", "z")]
    full = sorted(map(tuple, join.join_full(a, b, "k", match_nulls=True).collect()), key=str)
    assert full == sorted([(1, "x", None), (None, "y", "z"), (2, None, "w")], key=str)


def test_large_grid_is_expanded_through_buckets(spark):
    left = spark.range(3).withColumnRenamed("id", "a")
    grid = spark.range(50).withColumnRenamed("id", "b")
    small = sorted(map(tuple, join.expand_by(left, grid).collect()))
    assert small == sorted(map(tuple, join.expand_by(left, grid, part=7).collect()))
    assert len(small) == 150


def test_nest_splits_a_large_key_and_unnests(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("k"), "id")
    nested = reshape.nest_by(df, "k", chunk=100)
    assert nested.agg(F.max(F.size("data"))).first()[0] < 300
    assert sorted(map(tuple, reshape.unnest(nested).collect())) == sorted(map(tuple, df.collect()))


def test_nest_counts_copies_of_equal_rows(spark):
    df = spark.range(600).select(F.lit(1).alias("k"), F.when(F.col("id") < 500, -1).otherwise(F.col("id")).alias("v"))
    nested = reshape.nest_by(df, "k")
    assert nested.agg(F.sum(F.size("data"))).first()[0] == 101
    assert sorted(map(tuple, reshape.unnest(nested).collect())) == sorted(map(tuple, df.collect()))


def test_crosstab_margins_and_na_level(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), (None, 1), ("b", 1)], "v string, y int")
    cols = {r.value: (r["0"], r["1"]) for r in summarize.crosstab_pct(df, ["v"], "y", [0, 1]).collect()}
    assert cols == {"a": (100.0, 33.33), None: (0.0, 33.33), "b": (0.0, 33.33)}
    rows = summarize.crosstab_pct(df, ["v"], "y", [0, 1], margin="row").collect()
    assert all(r["0"] + r["1"] == 100 for r in rows)

"""Sorting, top rows and comparisons with a whole-table value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import quantiles, running_sums


def sort_by(df: DataFrame, *cols: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in cols])


def top_k(df: DataFrame, col: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest values; ties are broken by further columns."""
    return df.orderBy(F.col(col).desc_nulls_last(), *ties).limit(k)


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def arrange_levels(df: DataFrame, col: str, order: Sequence[str], position: str = "position") -> DataFrame:
    """Report rows in a given order of one column's values; other values go last."""
    out = F.lit(len(order) + 1)
    for i, text in reversed(list(enumerate(order))):
        out = F.when(F.col(col) == text, i + 1).otherwise(out)
    return df.withColumn(position, out).orderBy(position, col)


def flag_above_median(df: DataFrame, col: str, name: str = "above", inclusive: bool = False) -> DataFrame:
    """Is the value above (or at) the median of the table? NULL for NULL."""
    median = quantiles(df, col, [0.5], names=["m"]).select("m").scalar()
    return df.withColumn(name, F.col(col) >= median if inclusive else F.col(col) > median)


def rel_to_max(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Scale by the largest value of the table."""
    top = df.agg(F.max(col)).scalar()
    return df.withColumn(name or f"{col}_rel", F.try_divide(F.col(col).cast("double"), top.cast("double")))


def order_levels(df: DataFrame, cat: str, by: str, name: str = "position") -> DataFrame:
    """Position of each category by a numeric measure, ties by category. One row per category."""
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    before = running_sums(counts, by, ["_n"]).select(by, "prev__n")
    tie = Window.partitionBy(by).orderBy(cat)
    return (df.join(before, by, "left")
            .withColumn(name, F.when(F.col("prev__n").isNotNull(),
                                     (F.col("prev__n") + F.row_number().over(tie)).cast("bigint")))
            .drop("prev__n").select(*df.columns, name))

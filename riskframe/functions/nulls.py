"""Null and non-finite rules shared by every operator.

Missing is always SQL NULL: NaN is turned into NULL when data enters, ratios with a
zero denominator are NULL, and aggregates say whether they skip NULL or are strict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Two-way conditional that is NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def in_set(c: Column | str, values: Iterable) -> Column:
    """Set membership that is false, not NULL, for a NULL value."""
    return F.coalesce(as_col(c).isin(*values), F.lit(False))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den in double, NULL for a zero or missing denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def paired_sums(num: str, den: str, where: Column | None = None, skip_nulls: bool = True) -> tuple[Column, Column]:
    """Sums of two columns over the same rows: those that have both, or NULL for both as soon as one value is missing."""
    both = F.col(num).isNotNull() & F.col(den).isNotNull()
    mine = F.lit(True) if where is None else where
    sums = [F.sum(F.when(mine & both, F.col(c).cast("double"))) for c in (num, den)]
    if skip_nulls:
        return sums[0], sums[1]
    whole = F.count(F.when(mine & ~both, 1)) == 0
    return F.when(whole, sums[0]), F.when(whole, sums[1])


def ln_positive(c: Column | str) -> Column:
    """Natural log, NULL for zero, negative or missing values."""
    c = as_col(c)
    return F.when(c > 0, F.ln(c))


def finite_or_null(c: Column | str) -> Column:
    """NULL for NaN and for both infinities."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def null_inf(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace infinities and NaN by NULL in the named columns."""
    return df.withColumns({c: finite_or_null(c) for c in cols})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL instead of NaN in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def strict(agg: Callable[[Column], Column], c: Column | str) -> Column:
    """Aggregate that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def aggregate(agg: Callable[[Column], Column], c: Column | str, skip_nulls: bool = True) -> Column:
    """`agg(c)` that skips NULL, or the strict form."""
    return agg(as_col(c)) if skip_nulls else strict(agg, c)


def n_distinct_with_null(c: Column | str) -> Column:
    """Distinct count in which NULL is one more value."""
    c = as_col(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("bigint"))


def complete(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the columns (all by default).

    One condition per column: the optimizer's constraint inference grows exponentially over a single
    condition that names many derived columns, which is what `dropna` makes.
    """
    kinds = dict(df.dtypes)
    keep = None
    for c in (list(cols) if cols is not None else df.columns):
        col = F.col(f"`{c}`")
        ok = col.isNotNull() & ~F.isnan(col) if kinds[c] in ("double", "float") else col.isNotNull()
        keep = ok if keep is None else keep & ok
    return df if keep is None else df.filter(keep)

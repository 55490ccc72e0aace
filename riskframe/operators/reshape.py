"""Stack, pivot, nest and transpose."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def append(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; missing columns are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def bind_rows(tables: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """Stack named tables with a tag column."""
    return append(*[t.withColumn(id_col, F.lit(tag)) for tag, t in tables.items()])


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str = "variable",
            value: str = "value", as_type: str | None = None) -> DataFrame:
    """Wide to long; columns are cast to one type first where asked."""
    if as_type:
        df = df.withColumns({c: F.col(c).cast(as_type) for c in cols})
    return df.unpivot(list(ids), list(cols), key, value)


def to_wide(df: DataFrame, ids: Sequence[str], key: str, value: str, levels: Sequence) -> DataFrame:
    """Long to wide for the given levels, one value per cell."""
    return df.groupBy(*ids).pivot(key, list(levels)).agg(F.first(value, ignorenulls=True))


def transpose(df: DataFrame, name_col: str, levels: Sequence, new_name: str = "variable") -> DataFrame:
    """Turn a small table around: its columns become rows, the rows named in name_col become columns."""
    cols = [c for c in df.columns if c != name_col]
    return to_wide(to_long(df, [name_col], cols, new_name, "_v"), [new_name], name_col, "_v", levels)


def nest_by(df: DataFrame, key: str | Sequence[str], chunk: int = 10_000) -> DataFrame:
    """Rows of a key as arrays of about `chunk` distinct rows; a large key gets several numbered arrays.

    Equal rows are counted before they are collected: each element carries its number of copies.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys, *rest).agg(F.count(F.lit(1)).alias("copies"))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_chunks"))
    part = F.pmod(F.xxhash64(*rest), F.col("_chunks")).cast("int")
    return (counted.join(sizes, keys).withColumn("part", part)
            .groupBy(*keys, "part").agg(F.collect_list(F.struct(*rest, "copies")).alias("data")))


def unnest(df: DataFrame, column: str = "data") -> DataFrame:
    """Back to one row per nested row."""
    keep = [c for c in df.columns if c not in (column, "part")]
    flat = df.select(*keep, F.explode(column).alias("_e")).select(*keep, "_e.*")
    return flat.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("_i", "copies")


def apply_by(df: DataFrame, levels: Mapping[str, object], column: str,
             fn: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """Run fn on the rows of each named level and stack the results with the level's name."""
    return bind_rows({tag: fn(df.filter(F.col(column) == value)) for tag, value in levels.items()}, id_col)

"""Joins on explicit keys. Spark picks broadcast or shuffle from the measured sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str, match_nulls: bool) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    if not match_nulls:
        return left.join(right, keys, how)
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    out = left.join(r, cond, how)
    if how in ("right", "full"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    return out.drop(*[f"_r_{k}" for k in keys])


def join_inner(left, right, on, match_nulls=False) -> DataFrame:
    return _join(left, right, on, "inner", match_nulls)


def join_left(left, right, on, match_nulls=False) -> DataFrame:
    return _join(left, right, on, "left", match_nulls)


def join_right(left, right, on, match_nulls=False) -> DataFrame:
    """Keep every row of the right table (the entity profile, as a rule)."""
    return _join(left, right, on, "right", match_nulls)


def join_full(left, right, on, match_nulls=False) -> DataFrame:
    return _join(left, right, on, "full", match_nulls)


def join_all(tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left-join a list of tables onto the first."""
    return reduce(lambda a, b: join_left(a, b, on), tables)


def bind_cols(tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Align tables on a key, keeping every key that occurs in any of them."""
    return reduce(lambda a, b: join_full(a, b, on), tables)


def min_volume(df: DataFrame, entity: str, k: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows of the entities that have at least k rows (in `counted`, or in df)."""
    big = (counted if counted is not None else df).groupBy(entity).count().filter(F.col("count") >= k)
    return df.join(big.select(entity), entity, "left_semi")


def attach_scores(df: DataFrame, scored: DataFrame, row_id: str) -> DataFrame:
    """Give the source rows that survived feature building their scores, by row id."""
    new = [c for c in scored.columns if c == row_id or c not in df.columns]
    return df.join(scored.select(*new), row_id, "inner")


def expand_by(df: DataFrame, grid: DataFrame, part: int = 1_000) -> DataFrame:
    """Every row of df with every row of a grid (periods, parameter values).

    The grid is cut into parts of about `part` rows, each an array. Every part is there once for each of as many
    salts as there are shuffle partitions; a row of df meets each part under one salt, its own. So a shuffled join
    has parts x salts keys whatever the sizes, and a grid of one part multiplies nothing before it is joined.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-grid.count() // part))
    number = F.pmod(F.xxhash64(*grid.columns), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint")
    cells = (grid.groupBy(number.alias("_part")).agg(F.collect_list(F.struct(*grid.columns)).alias("_cells"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return (rows.join(cells, ["_part", "_salt"]).withColumn("_cell", F.explode("_cells"))
            .select(*df.columns, "_cell.*"))

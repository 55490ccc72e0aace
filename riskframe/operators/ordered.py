"""Running totals, ranks and exact quantiles over a whole column, without a one-task sort.

Rows are first reduced to distinct values. Values are then spread over buckets whose bounds
follow the data, so that a running total is a window inside each bucket plus an offset per
bucket. The only unpartitioned window runs over the buckets, whose number is fixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..lineage import cut

_BUCKET = "_bucket"


def _with_buckets(df: DataFrame, value: str, n: int) -> DataFrame:
    """Add a bucket number that grows with the value. Bounds are fixed before use, so retries agree."""
    probs = [i / n for i in range(1, n)]
    bounds = df.agg(F.percentile_approx(value, probs, max(1000, 10 * n))).first()[0] if probs else []
    splits = [float("-inf"), *sorted({float(b) for b in bounds or []}), float("inf")]
    keyed = df.withColumn("_value", F.col(value).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_value", outputCol=_BUCKET).transform(keyed)
    return out.withColumn(_BUCKET, F.col(_BUCKET).cast("int")).drop("_value")


def running_sums(df: DataFrame, value: str, sums: Iterable[str], by: Sequence[str] = (),
                 descending: bool = False) -> DataFrame:
    """Add `prev_<s>` (total of s before this value) and `all_<s>` (total of the group).

    df holds one row per (by, value); value is numeric and not NULL.
    """
    sums, by = list(sums), list(by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_buckets(cut(df), value, n)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    inside = (Window.partitionBy(*by, _BUCKET).orderBy(direction(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    across = Window.partitionBy(*(by or [F.lit(0)]))
    before = across.orderBy(direction(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)

    totals = rows.groupBy(*by, _BUCKET).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*by, _BUCKET)],
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(across).alias(f"all_{s}") for s in sums])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*by, _BUCKET)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return (rows.withColumns({f"_p_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
            .join(offsets, cond)
            .withColumns({f"prev_{s}": F.col(f"_p_{s}") + F.col(f"_o_{s}") for s in sums})
            .select(*df.columns, *[f"prev_{s}" for s in sums], *[f"all_{s}" for s in sums]))


def row_index(df: DataFrame, key: str, by: Sequence[str] = (), blocks: int | None = None,
              name: str = "idx", parts: int | None = None) -> DataFrame:
    """Number rows 0.. inside each group, in an order fixed by the hash of a unique key.

    Hash blocks have about equal sizes, so a group that holds most rows is still spread. `parts` tells over how many
    tasks at most, where groups are many and small; the numbers do not depend on it.
    """
    blocks = blocks or 4096
    by = list(by)
    keyed = df.withColumn("_md5", F.md5(F.col(key).cast("string")))
    keyed = keyed.withColumns({"_block": F.pmod(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("bigint"),
                                                F.lit(blocks)).cast("int"), "_md5": F.unhex("_md5")})
    keyed = keyed.withColumn(_BUCKET, F.floor(F.col("_block") * F.lit(parts or blocks) / F.lit(blocks)).cast("int"))
    inside = Window.partitionBy(*by, _BUCKET).orderBy("_block", "_md5", key)
    before = (Window.partitionBy(*(by or [F.lit(0)])).orderBy(_BUCKET)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (keyed.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (keyed.withColumn("_row", F.row_number().over(inside))
            .join(offsets, [*by, _BUCKET])
            .withColumn(name, F.col("_first") + F.col("_row") - 1)
            .select(*df.columns, name))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              names: Sequence[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per probability and one row per group."""
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    run = running_sums(counts, "_v", ["_n"], by)

    aggs = []
    for i, p in enumerate(probs):
        h = f"(all__n - 1) * {float(p)!r}D"
        for name, rank in (("lo", f"floor({h})"), ("hi", f"ceil({h})")):
            aggs.append(f"max(CASE WHEN prev__n <= {rank} AND {rank} < prev__n + _n THEN _v END) AS _{name}{i}")
        aggs.append(f"max({h} - floor({h})) AS _f{i}")
    out = run.groupBy(*by).agg(*[F.expr(a) for a in aggs])
    return out.selectExpr(*[f"`{b}`" for b in by],
                          *[f"_lo{i} + (_hi{i} - _lo{i}) * _f{i} AS `{nm}`" for i, nm in enumerate(names)])


def midranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its tie count and mid-rank inside the group."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("n_tied")))
    run = running_sums(counts, value, ["n_tied"], by)
    return run.select(*by, value, "n_tied", F.col("all_n_tied").alias("n_total"),
                      (F.col("prev_n_tied") + (F.col("n_tied") + 1) / 2).alias("midrank"))

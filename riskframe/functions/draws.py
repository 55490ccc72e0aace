"""Reproducible randomness: the same for any partitioning, any retry and any engine.

A row's key is hashed once with md5. Draws for many replicates then mix the two words of that hash
with the replicate number by integer arithmetic, which stays in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .nulls import as_col

U32 = 4294967296.0
U31 = 2147483648.0

# Fixed values of the mixer: multipliers, shifts and the 31-bit mask.
MULTIPLIERS = (2146121005, 1540483477)
SHIFTS = (16, 15, 16)
MASK = 2147483647
SEED_STEP = 1000003


def hash32(*parts: Column | str) -> Column:
    """Unsigned 32-bit integer from the parts joined by ':'."""
    text = F.concat_ws(":", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str) -> Column:
    """Uniform number in [0, 1)."""
    return hash32(*parts) / F.lit(U32)


def words(df: DataFrame, key: str) -> DataFrame:
    """Add the 31-bit words `_a` and `_b` of the key's md5.

    They are never NULL, and neither is a draw made from them: a join on a draw then needs no
    not-null filter, which the optimizer would push down as one huge copied expression.
    """
    df = df.withColumn("_md5", F.md5(F.col(key).cast("string")))
    return df.withColumns({name: F.coalesce(F.conv(F.substring("_md5", at, 8), 16, 10).cast("bigint")
                                            .bitwiseAND(F.lit(MASK)), F.lit(0).cast("bigint"))
                           for name, at in (("_a", 1), ("_b", 9))}).drop("_md5")


def mix(df: DataFrame, x: Column, out: str) -> DataFrame:
    """Add `out`: a one-to-one scrambling of the 31-bit number x. Each step is a column of its own."""
    df = df.withColumn("_z", x)
    for shift, factor in zip(SHIFTS, MULTIPLIERS):
        df = df.withColumn("_z", (F.col("_z").bitwiseXOR(F.shiftright("_z", shift)) * F.lit(factor)).bitwiseAND(F.lit(MASK)))
    return df.withColumn(out, F.col("_z").bitwiseXOR(F.shiftright("_z", SHIFTS[-1]))).drop("_z")


def replicate_draw(df: DataFrame, rep: str, seed: int, out: str, lane: int = 0) -> DataFrame:
    """Add `out`: 31 bits from the words `_a` and `_b`, the replicate number, the seed and a lane."""
    base = (F.lit(seed * SEED_STEP + 2 * lane) + F.col(rep).cast("bigint") * 16).bitwiseAND(F.lit(MASK))
    df = mix(mix(df, base, "_r1"), (base + 1).bitwiseAND(F.lit(MASK)), "_r2")
    df = mix(df, F.col("_a").bitwiseXOR(F.col("_r1")), "_m")
    df = mix(df, F.col("_m").bitwiseXOR(F.col("_b")).bitwiseXOR(F.col("_r2")), out)
    return df.drop("_r1", "_r2", "_m")


def poisson_cdf(rate: float) -> list[float]:
    """Cumulative Poisson probabilities up to the last that a 31-bit uniform can reach."""
    term = total = math.exp(-rate)
    out, k = [total], 0
    while 1.0 - total > 1 / U31 and k < 64:
        k += 1
        term *= rate / k
        total += term
        out.append(total)
    return out


def poisson_from(u: Column, rate: float) -> Column:
    """Poisson count by inversion of a uniform number."""
    out = F.lit(0)
    for cut in poisson_cdf(rate):
        out = out + (u >= cut).cast("int")
    return out

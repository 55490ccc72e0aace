"""Summaries of simulation draws in long form: (draw, param, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import expit

# The reported quantiles.
DRAW_PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def summarize_draws(draws: DataFrame, probs: Sequence[float] = DRAW_PROBS) -> DataFrame:
    """Quantiles of the inverse-logit of each parameter's draws. A group holds one value per draw."""
    p = draws.withColumn("_p", expit("value"))
    out = p.groupBy("param").agg(F.percentile("_p", F.array(*[F.lit(float(x)) for x in probs])).alias("_q"))
    return out.select("param", *[F.get("_q", i).alias(f"p{x * 100:g}") for i, x in enumerate(probs)])


def shift_draws(draws: DataFrame, intercept: str) -> DataFrame:
    """Add the intercept's value of the same draw to every other parameter."""
    base = draws.filter(F.col("param") == intercept).select("draw", F.col("value").alias("_base"))
    rest = draws.filter(F.col("param") != intercept)
    return rest.join(base, "draw").select("draw", "param", (F.col("value") + F.col("_base")).alias("value"))

"""Design-based means: strata, clusters nested in strata, weights, domains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .order import arrange_levels
from .reshape import to_wide


@dataclass(frozen=True)
class SurveyDesign:
    psu: str
    stratum: str
    weight: str


def svy_mean(df: DataFrame, design: SurveyDesign, variables: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Weighted mean and linearised standard error of each variable in each domain.

    Rows with a NULL in any variable leave their domain, but their clusters still count in the
    design. Strata with a single cluster add nothing to the variance. The case table is read once,
    into weighted sums per cluster and domain.
    """
    by, k = list(by), range(len(variables))
    w = F.col(design.weight).cast("double")
    ok = F.lit(True)
    for v in variables:
        ok = ok & F.col(v).isNotNull()
    cluster = [F.col(design.stratum).alias("_h"), F.col(design.psu).alias("_j")]
    sums = df.groupBy(*cluster, *by).agg(
        F.sum(F.when(ok, w)).alias("_w"),
        *[F.sum(F.when(ok, w * F.col(v).cast("double"))).alias(f"_x{i}") for i, v in zip(k, variables)])
    sizes = sums.select("_h", "_j").distinct().groupBy("_h").agg(F.count(F.lit(1)).alias("_nh"))
    sums = sums.filter(F.col("_w").isNotNull())
    totals = sums.groupBy(*by).agg(F.sum("_w").alias("_wsum"), *[(F.sum(f"_x{i}") / F.sum("_w")).alias(f"_m{i}") for i in k])

    scored = sums.join(totals, by).select(
        "_h", *by, *[((F.col(f"_x{i}") - F.col(f"_m{i}") * F.col("_w")) / F.col("_wsum")).alias(f"_z{i}") for i in k])
    # Two passes over the cluster sums: squares about the stratum mean, with 0 for clusters outside the domain.
    means = (scored.groupBy("_h", *by).agg(*[F.sum(f"_z{i}").alias(f"_s{i}") for i in k]).join(sizes, "_h")
             .select("_h", *by, "_nh", *[(F.col(f"_s{i}") / F.col("_nh")).alias(f"_c{i}") for i in k]))
    n = F.col("_nh")
    about = scored.join(means, ["_h", *by]).groupBy("_h", *by).agg(
        F.max(n).alias("_nh"), F.count(F.lit(1)).alias("_there"),
        *[F.sum(F.pow(F.col(f"_z{i}") - F.col(f"_c{i}"), 2)).alias(f"_q{i}") for i in k],
        *[F.max(f"_c{i}").alias(f"_c{i}") for i in k])
    var = about.groupBy(*by).agg(*[F.sum(F.when(n > 1, n / (n - 1) * (
        F.col(f"_q{i}") + (n - F.col("_there")) * F.col(f"_c{i}") * F.col(f"_c{i}"))).otherwise(0.0)).alias(f"_v{i}")
        for i in k])
    items = [F.struct(F.lit(v).alias("variable"), F.col(f"_m{i}").alias("mean"), F.sqrt(f"_v{i}").alias("se"))
             for i, v in zip(k, variables)]
    return totals.join(var, by).select(*by, F.inline(F.array(*items)))


def svy_table(means: DataFrame, group: str, groups: Sequence[str], percent_vars: Sequence[str],
              order: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """'mean (se)' per variable (rows, in a given order) and group (columns); shares as percentages."""
    scale = F.when(F.col("variable").isin(list(percent_vars)), 100.0).otherwise(1.0)
    text = F.format_string("%.2f (%.2f)", F.col("mean") * scale, F.col("se") * scale)
    wide = to_wide(means.withColumn("text", text), ["variable"], group, "text", groups)
    wide = arrange_levels(wide, "variable", order)
    label = F.col("variable")
    for old, new in labels.items():
        label = F.when(F.col("variable") == old, new).otherwise(label)
    return wide.withColumn("variable", label)

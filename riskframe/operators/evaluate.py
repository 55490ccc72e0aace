"""How well a score predicts a 0/1 outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import cut_bins, cut_labels
from ..functions.special import binom_lower_limit, binom_upper_limit
from .ordered import running_sums
from .project import cut_quantiles


def calibration(df: DataFrame, score: str, label: str, breaks: Sequence[float], se: bool = False) -> DataFrame:
    """Mean outcome and mean prediction per score bin; scores outside the breaks form a NULL bin.

    With se: also n, binomial standard error, a band of two standard errors, and the bin midpoint.
    """
    binned = df.withColumn("bin", cut_bins(score, breaks).cast("bigint"))
    out = binned.groupBy("bin").agg(F.count(label).alias("n"), F.avg(F.col(label).cast("double")).alias("obs_rate"),
                                    F.avg(score).alias("mean_pred"))
    names = F.array(*[F.lit(x) for x in cut_labels(breaks)])
    out = out.withColumn("label", F.get(names, F.col("bin").cast("int") - 1))
    if not se:
        return out.drop("n")
    mids = F.array(*[F.lit((a + b) / 2) for a, b in zip(breaks, breaks[1:])])
    out = out.withColumn("se", F.sqrt(F.col("obs_rate") * (1 - F.col("obs_rate")) / F.col("n")))
    return out.withColumns({"ymin": F.col("obs_rate") - 2 * F.col("se"), "ymax": F.col("obs_rate") + 2 * F.col("se"),
                            "mid": F.get(mids, F.col("bin").cast("int") - 1)})


def calibration_curve(df: DataFrame, score: str, label: str, n_bins: int = 20) -> DataFrame:
    """Uniform bins of [0, 1]; empty bins do not appear. Edges belong to the upper bin, 1 to the last."""
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("bigint")
    return df.groupBy(b.alias("bin")).agg(F.avg(F.col(label).cast("double")).alias("frac_pos"),
                                          F.avg(score).alias("mean_pred"))


def calibration_ci(df: DataFrame, score: str, label: str, cuts: int = 10, alpha: float = 0.05) -> DataFrame:
    """Events per equal-width score bin with the exact binomial interval of the event share."""
    breaks = [i / cuts for i in range(cuts + 1)]
    out = (df.withColumn("bin", cut_bins(score, breaks).cast("bigint")).filter(F.col("bin").isNotNull())
           .groupBy("bin").agg(F.count(label).alias("n"), F.sum(F.col(label).cast("bigint")).alias("events")))
    args = ("events", "n", F.lit(alpha))
    return out.withColumns({"pct": F.col("events") / F.col("n") * 100,
                            "lower": binom_lower_limit(*args) * 100, "upper": binom_upper_limit(*args) * 100})


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positives and negatives; rows with a NULL are left out."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return d.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score: threshold, cumulative true and false positives, and both rates."""
    run = running_sums(_by_score(df, score, label), "score", ["pos", "neg"], descending=True)
    tp, fp = F.col("prev_pos") + F.col("pos"), F.col("prev_neg") + F.col("neg")
    return run.select(F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                      F.try_divide(tp, F.col("all_pos")).alias("tpr"), F.try_divide(fp, F.col("all_neg")).alias("fpr"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve: the chance that a positive outranks a negative, ties count half."""
    run = running_sums(_by_score(df, score, label), "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("prev_neg") + F.col("neg") / 2))
    return run.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.max("all_neg")).alias("auc"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(label) - F.col(score), 2)).alias("brier"))


def quantile_profile(df: DataFrame, x: str, y: str, step: float = 0.05) -> DataFrame:
    """Mean outcome and mean covariate per quantile bin of the covariate; NULL covariate is its own bin."""
    n = round(1 / step)
    binned = cut_quantiles(df, x, [i / n for i in range(n + 1)], "bin")
    return binned.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(
        F.avg(F.col(y).cast("double")).alias("p"), F.avg(x).alias("x"))

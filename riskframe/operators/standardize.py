"""Risk standardisation: profiles, observed/expected, relative risk and what follows from them.

Case tables are reduced to (entity, cohort) or (entity, cohort, cell) sums before anything else,
so one large entity costs its map-side partial sums only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import if_else, ln_positive, paired_sums, ratio, strict
from ..functions.scalar import paste
from .order import flag_above_median
from .summarize import is_one, mean_where

COHORT_NAMES = {1: "case", 0: "control"}


def entity_profile(df: DataFrame, entity: str, cohort: str, indicators: Sequence[str],
                   attrs: Sequence[str]) -> DataFrame:
    """One row per entity in one pass: sizes, per-cohort counts and shares, largest attribute values.

    An entity without rows of a cohort keeps its row, with NULL for that cohort.
    """
    aggs = [F.count(F.lit(1)).alias("n_cases")]
    for value, name in COHORT_NAMES.items():
        mine = F.col(cohort) == value
        n = F.sum(mine.cast("bigint"))
        aggs.append(F.when(n > 0, n).alias(f"{name}_n"))
        for c in indicators:
            seen = F.count(F.when(mine, F.col(c)))
            aggs.append(F.when(seen == n, F.avg(F.when(mine, is_one(c)))).alias(f"{name}_{c}"))
    aggs += [strict(F.max, a).alias(a) for a in attrs]
    return df.groupBy(entity).agg(*aggs)


def oe_by(df: DataFrame, by: Sequence[str], outcome: str = "outcome", risk: str = "risk",
          skip_nulls: bool = True) -> DataFrame:
    """Observed, expected, their ratio and its log per group.

    Both sums are over the rows that have outcome and risk; strict (skip_nulls=False): NULL if any row lacks one.
    """
    obs, expect = paired_sums(outcome, risk, None, skip_nulls)
    sums = df.groupBy(*by).agg(obs.alias("obs"), expect.alias("expect"))
    out = sums.withColumn("oe_ratio", ratio("obs", "expect"))
    return out.withColumn("log_oe", ln_positive("oe_ratio"))


def _cohort_sums(outcome: str, risk: str, cohort: str, skip_nulls: bool, mark: str = "_") -> list[Column]:
    """Paired sums of outcome and risk in both cohorts, named mark + column + cohort."""
    return [c.alias(f"{mark}{v}{k}") for k in (0, 1)
            for v, c in zip((outcome, risk), paired_sums(outcome, risk, F.col(cohort) == k, skip_nulls))]


def relative_risk(df: DataFrame, by: Sequence[str] = ("entity",), cohort: str = "cohort", outcome: str = "outcome",
                  risk: str = "risk", skip_nulls: bool = True) -> DataFrame:
    """O/E of cohort 1, O/E of cohort 0 and their ratio; NULL where a side is missing or its ratio undefined."""
    sums = df.groupBy(*by).agg(*_cohort_sums(outcome, risk, cohort, skip_nulls))
    out = sums.select(*by, *[ratio(f"_{outcome}{k}", f"_{risk}{k}").alias(f"oe_{k}") for k in (0, 1)])
    return out.withColumn("rr", ratio("oe_1", "oe_0"))


def entity_risk(df: DataFrame, profile: DataFrame, exceed: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Profile, RR, crude rate, mean yearly volumes, exceedance probability and high-RR flag per entity.

    The cases are read once: one sum per (entity, period, cohort) feeds every column.
    """
    cell = df.groupBy("entity", "period", "cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count("outcome").alias("known"),
        F.sum(F.col("outcome").cast("double")).alias("dead"),
        *[c.alias(v) for v, c in zip(("obs", "expect"), paired_sums("outcome", "risk"))])
    yearly = cell.groupBy("entity", "period").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("cohort") == 1, F.col("n")).otherwise(0)).alias("n_1"),
        F.sum("dead").alias("dead"), F.sum("known").alias("known"),
        *[F.sum(F.when(F.col("cohort") == k, F.col(v))).alias(f"{v}_{k}") for v in ("obs", "expect") for k in (0, 1)])
    own = yearly.groupBy("entity").agg(
        F.avg("n").alias("cases_yr"), F.avg("n_1").alias("cohort_cases_yr"),
        ratio(F.sum("dead"), F.sum("known")).alias("rate"),
        *[F.sum(f"{v}_{k}").alias(f"{v}_{k}") for v in ("obs", "expect") for k in (0, 1)])
    own = own.withColumn("rr", ratio(ratio("obs_1", "expect_1"), ratio("obs_0", "expect_0")))
    own = own.select("entity", "rr", "rate", "cases_yr", "cohort_cases_yr")
    out = profile.join(own, "entity", "left").join(exceed, "entity", "left")
    return out.withColumn("high_rr", if_else(F.col("rr") >= threshold, F.lit(1), F.lit(0)))


def rr_summary(df: DataFrame, skip_nulls: bool = True) -> DataFrame:
    """RR, size of cohort 0 and overall rate per entity, in one pass."""
    sums = df.groupBy("entity").agg(
        *_cohort_sums("outcome", "risk", "cohort", skip_nulls, ""),
        F.sum((F.col("cohort") == 0).cast("bigint")).alias("_n0"), F.avg(F.col("outcome").cast("double")).alias("rate"))
    rr = ratio(ratio("outcome1", "risk1"), ratio("outcome0", "risk0"))
    return sums.select("entity", rr.alias("rr"), F.when(F.col("_n0") > 0, F.col("_n0")).alias("n_control"), "rate")


def flag_high(df: DataFrame, col: str, threshold: float, strict_: bool, name: str = "high") -> DataFrame:
    """0/1 flag for values above (strict) or at least at the threshold; NULL for NULL."""
    test = F.col(col) > threshold if strict_ else F.col(col) >= threshold
    return df.withColumn(name, if_else(test, F.lit(1), F.lit(0)))


def quadrants(df: DataFrame, oe: str = "oe_ratio", rate: str = "rate", threshold: float = 2.0,
              inclusive: bool = False) -> DataFrame:
    """Relative (O/E against a threshold) by absolute (rate against its median) classes."""
    rel = F.col(oe) >= threshold if inclusive else F.col(oe) > threshold
    out = flag_above_median(df, rate, "_above", inclusive)
    out = out.withColumns({"rel_class": if_else(rel, F.lit("High Rel"), F.lit("Low Rel")),
                           "abs_class": if_else(F.col("_above"), F.lit("High Abs"), F.lit("Low Abs"))})
    return out.drop("_above").withColumn("quadrant", paste(["rel_class", "abs_class"], " / "))


def cohort_attrs(df: DataFrame, entity: str, cohort: str, attrs: Sequence[str]) -> DataFrame:
    """Each attribute's mean among cohort-1 rows, rounded half-even, one row per entity."""
    mine = F.col(cohort) == 1
    means = mean_where(df, entity, {a: (a, mine) for a in attrs})
    return means.select(entity, *[F.bround(a).cast("int").alias(a) for a in attrs])


def smr(df: DataFrame, preds: Sequence[str], n: str, dead: str) -> DataFrame:
    """Expected deaths and standardised ratio for each predicted rate column."""
    for i, p in enumerate(preds, 1):
        df = df.withColumn(f"expect{i}", F.col(p) * F.col(n)).withColumn(f"smr{i}", ratio(dead, f"expect{i}"))
    return df


def excess_risk(df: DataFrame, rate1: str, rate0: str, name: str = "excess_risk") -> DataFrame:
    return df.withColumn(name, ratio(F.col(rate1) - F.col(rate0), rate0))


def stratified_rates(df: DataFrame, entity: str, cohort: str, outcome: str, factor: str,
                     min_case_rows: int | None = None) -> DataFrame:
    """Outcome rate by cohort and by a 0/1 factor, per entity; entities with a positive case rate.

    With min_case_rows, entities with fewer cohort-1 rows have no case rates.
    """
    specs = {f"{name}_{tag}": (outcome, (F.col(cohort) == k) & (F.col(factor) == v))
             for k, name in COHORT_NAMES.items() for v, tag in ((1, "v"), (0, "nv"))}
    rates = df.groupBy(entity).agg(
        *[F.avg(F.when(p, F.col(c).cast("double"))).alias(n) for n, (c, p) in specs.items()],
        F.sum((F.col(cohort) == 1).cast("bigint")).alias("_n1"))
    if min_case_rows is not None:
        enough = F.col("_n1") >= min_case_rows
        rates = rates.withColumns({n: F.when(enough, F.col(n)) for n in ("case_v", "case_nv")})
    return rates.drop("_n1").filter((F.col("case_nv") > 0) | (F.col("case_v") > 0))


def cohort_compare(df: DataFrame, entity: str, cohort: str, outcome: str) -> DataFrame:
    """Sizes, rates, total and cohort share for entities with rows in both cohorts."""
    c1, c0 = F.col(cohort) == 1, F.col(cohort) == 0
    y = F.col(outcome).cast("double")
    out = df.groupBy(entity).agg(
        F.sum(c1.cast("bigint")).alias("case_n"), F.sum(c0.cast("bigint")).alias("control_n"),
        F.avg(F.when(c1, y)).alias("case_rate"), F.avg(F.when(c0, y)).alias("control_rate"))
    out = out.filter((F.col("case_n") > 0) & (F.col("control_n") > 0))
    out = out.withColumn("total", F.col("case_n") + F.col("control_n"))
    return out.withColumn("case_share", ratio("case_n", "total"))


def odds_ratio_by(df: DataFrame, entity: str, cohort: str, outcome: str) -> DataFrame:
    """2 x 2 odds ratio per entity and how many of the four cells hold rows; NULL if one is empty."""
    cells = {f"n{y}{k}": (F.col(outcome) == y) & (F.col(cohort) == k) for y in (0, 1) for k in (0, 1)}
    out = df.groupBy(entity).agg(*[F.sum(p.cast("bigint")).alias(n) for n, p in cells.items()])
    filled = sum(((F.col(n) > 0).cast("int") for n in cells), F.lit(0))
    odds = ratio(F.col("n00") * F.col("n11"), F.col("n01") * F.col("n10"))
    return out.withColumn("n_cells", filled.cast("bigint")).withColumn(
        "odds_ratio", F.when(F.col("n_cells") == 4, odds))


def compare_scores(df: DataFrame, a: str, b: str, skip_nulls: bool = True) -> DataFrame:
    """RR per entity under two score columns, in one pass; each over the rows that have its score and the outcome."""
    sums = df.groupBy("entity").agg(*_cohort_sums("outcome", a, "cohort", skip_nulls, "a_"),
                                    *_cohort_sums("outcome", b, "cohort", skip_nulls, "b_"))
    def rr(mark, score):
        return ratio(ratio(f"{mark}outcome1", f"{mark}{score}1"), ratio(f"{mark}outcome0", f"{mark}{score}0"))
    return sums.select("entity", rr("a_", a).alias("rr_a"), rr("b_", b).alias("rr_b"))


def oe_within_entity(df: DataFrame, entity: str, cohort: str, outcome: str, covars: Sequence[str],
                     k0: float = 5.0) -> DataFrame:
    """O/E of cohort 1 against what its own entity achieves for cohort 0 in the same covariate cell.

    The cohort-0 rate of a cell is shrunk towards the entity's cohort-0 rate with weight k0, so a thin
    or empty cell falls back to the entity. Rows without outcome or cohort are left out. Everything follows from one count per (entity, cell).
    """
    def count(k, y=None):
        hit = F.col(cohort) == k
        return F.sum((hit if y is None else hit & (F.col(outcome) == y)).cast("bigint"))
    known = df.filter(F.col(outcome).isNotNull() & F.col(cohort).isNotNull())
    cells = known.groupBy(entity, *covars).agg(count(0).alias("n0"), count(0, 1).alias("d0"),
                                            count(1).alias("n1"), count(1, 1).alias("d1"))
    whole = cells.groupBy(entity).agg(ratio(F.sum("d0"), F.sum("n0")).alias("rate0"))
    rate = (F.col("d0") + F.lit(float(k0)) * F.col("rate0")) / (F.col("n0") + F.lit(float(k0)))
    out = (cells.filter(F.col("n1") > 0).join(whole, entity).groupBy(entity)
           .agg(F.sum(F.col("d1").cast("double")).alias("obs"), F.sum(F.col("n1") * rate).alias("expect")))
    return out.withColumn("oe_ratio", ratio("obs", "expect")).withColumn("log_oe", ln_positive("oe_ratio"))

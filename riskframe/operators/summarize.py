"""Grouped summaries, crosstabs and descriptive tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import aggregate, complete, if_else, n_distinct_with_null
from ..functions.scalar import cut_bins, fmt_mean_sd
from ..lineage import cut
from .ordered import quantiles

def _keys(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def _rows() -> Column:
    return F.count(F.lit(1))


def count_by(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(_rows().alias(name))


def rate_by(df: DataFrame, by: str | Sequence[str], outcome: str, name: str = "rate",
            skip_nulls: bool = True) -> DataFrame:
    """Mean of a 0/1 outcome per group."""
    return df.groupBy(*_keys(by)).agg(aggregate(F.avg, F.col(outcome).cast("double"), skip_nulls).alias(name))


def is_one(c: str) -> Column:
    """1.0 where a flag equals 1, 0.0 otherwise, NULL for NULL."""
    return (F.col(c).cast("string") == "1").cast("double")


def indicator_rates(df: DataFrame, by: str | Sequence[str], cols: Sequence[str], prefix: str = "",
                    skip_nulls: bool = False) -> DataFrame:
    """Share of rows equal to 1 for many columns; strict by default (NULL if any is missing)."""
    return df.groupBy(*_keys(by)).agg(*[aggregate(F.avg, is_one(c), skip_nulls).alias(prefix + c) for c in cols])


def max_by_entity(df: DataFrame, entity: str, cols: Sequence[str], skip_nulls: bool = False) -> DataFrame:
    return df.groupBy(entity).agg(*[aggregate(F.max, c, skip_nulls).alias(c) for c in cols])


def sum_by(df: DataFrame, by: str | Sequence[str], col: str, name: str, skip_nulls: bool = False) -> DataFrame:
    return df.groupBy(*_keys(by)).agg(aggregate(F.sum, col, skip_nulls).alias(name))


def mean_where(df: DataFrame, by: str | Sequence[str], specs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Several conditional means in one pass: name -> (value column, row predicate)."""
    return df.groupBy(*_keys(by)).agg(
        *[F.avg(F.when(p, F.col(v).cast("double"))).alias(name) for name, (v, p) in specs.items()])


def profile_by(df: DataFrame, group: str, entity: str, outcome: str, flag: str, value: str) -> DataFrame:
    """Per group and entity: flag rate, outcome rate, mean and exact median of a value; plus entity total."""
    keys = [group, entity]
    means = df.groupBy(*keys).agg(
        F.avg(is_one(flag)).alias(f"{flag}_rate"), F.avg(F.col(outcome).cast("double")).alias(f"{outcome}_rate"),
        F.avg(value).alias(f"mean_{value}"), _rows().alias("_n"))
    totals = means.groupBy(entity).agg(F.sum("_n").alias("n_total"))
    medians = quantiles(df, value, [0.5], keys, [f"median_{value}"])
    return means.drop("_n").join(medians, keys, "left").join(totals, entity, "left")


def mean_annual(df: DataFrame, entity: str, period: str, measures: Mapping[str, Column]) -> DataFrame:
    """Aggregate per (entity, period), then average over the periods of each entity."""
    yearly = df.groupBy(entity, period).agg(*[m.alias(name) for name, m in measures.items()])
    return yearly.groupBy(entity).agg(*[F.avg(name).alias(name) for name in measures])


def _stack(df: DataFrame, keys: Sequence[str], items: Sequence[Column]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*items)))


def mean_sd(df: DataFrame, cols: Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    """Mean and standard deviation of many columns: one aggregate, then one row per variable."""
    keys = _keys(by)
    aggs = [a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    return _stack(df.groupBy(*keys).agg(*aggs), keys,
                  [F.struct(F.lit(c).alias("variable"), F.col(f"m_{c}").alias("mean"),
                            F.col(f"s_{c}").alias("sd")) for c in cols])


def summary_matrix(df: DataFrame, outcome: str, cohort: str, metrics: Mapping[str, Column]) -> DataFrame:
    """One text cell per metric (rows) and outcome x cohort group (columns); rows without either are in no group."""
    group = F.concat(if_else(F.col(cohort) == 1, "case", "control"), F.lit("_"),
                     if_else(F.col(outcome) == 1, "dead", "alive"))
    wide = df.groupBy(group.alias("grp")).agg(*[m.alias(name) for name, m in metrics.items()])
    long = wide.filter(F.col("grp").isNotNull()).unpivot(["grp"], list(metrics), "metric", "text")
    return (long.groupBy("metric").pivot("grp", ["case_alive", "case_dead", "control_alive", "control_dead"])
            .agg(F.first("text")))


REPLICATE_PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "lcb": 0.025, "ucb": 0.975}


def summarize_replicates(reps: DataFrame, entity: str = "entity", value: str = "rr") -> DataFrame:
    """Distribution of the replicates of each entity. A group holds one value per replicate."""
    probs = F.array(*[F.lit(p) for p in REPLICATE_PROBS.values()])
    out = reps.groupBy(entity).agg(
        F.percentile(value, probs).alias("_q"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.max(value).alias("max"), F.min(value).alias("min"))
    out = out.select(entity, *[F.get("_q", i).alias(n) for i, n in enumerate(REPLICATE_PROBS)],
                     "mean", "sd", "max", "min")
    return out.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1")})


def replicate_spread(reps: DataFrame, entity: str = "entity", value: str = "rr") -> DataFrame:
    """Only standard deviation, minimum and maximum."""
    return reps.groupBy(entity).agg(F.stddev_samp(value).alias("sd"), F.min(value).alias("mins"),
                                    F.max(value).alias("maxs"))


def exceed_prob(reps: DataFrame, threshold: float, entity: str = "entity", value: str = "rr",
                name: str = "exceed") -> DataFrame:
    """Share of the non-missing replicates at or above a threshold."""
    return reps.groupBy(entity).agg(F.avg((F.col(value) >= threshold).cast("double")).alias(name))


def headline(cases: DataFrame, entity_risk: DataFrame, threshold: float = 2.0) -> DataFrame:
    """One row of headline numbers from the cases and the entity table (entity, rate, rr)."""
    entity_risk = cut(entity_risk)  # three passes
    totals = cases.agg(F.count_distinct("entity").alias("n_entities"), _rows().alias("n_cases"),
                       F.sum("cohort").alias("n_cohort"))
    rate = quantiles(entity_risk, "rate", [0.0, 0.5, 1.0], names=["min_rate", "median_rate", "max_rate"])
    rr = quantiles(entity_risk, "rr", [0.0, 0.5, 1.0], names=["min_rr", "median_rr", "max_rr"])
    high = entity_risk.agg(F.avg((F.col("rr") >= threshold).cast("double")).alias("share_high"),
                           F.sum((F.col("rr") >= threshold).cast("bigint")).alias("n_high"),
                           F.sum((F.col("rr") == 0).cast("bigint")).alias("n_zero"))
    one = F.lit(1).alias("_one")
    out = totals.select("*", one)
    for part in (rate, rr, high):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def attr_stability(df: DataFrame, entity: str, attrs: Sequence[str]) -> DataFrame:
    """How many entities have how many distinct attribute values in total (NULL is a value)."""
    per = df.groupBy(entity).agg(*[n_distinct_with_null(a).alias(a) for a in attrs])
    total = sum((F.col(a) for a in attrs), F.lit(0))
    return per.groupBy(total.cast("bigint").alias("totals")).agg(_rows().alias("n"))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def crosstab_pct(df: DataFrame, variables: Sequence[str], by: str, levels: Sequence, margin: str = "col",
                 digits: int = 2, show_na: bool = True) -> DataFrame:
    """Row or column percentages of several categorical variables, stacked.

    Cases are counted once per (variable, value, level); margins are sums over that small table.
    """
    if margin not in ("row", "col"):
        raise ValueError("margin is 'row' or 'col'")
    long = df.withColumns({v: F.col(v).cast("string") for v in variables}).unpivot(
        [by], list(variables), "variable", "value")
    counts = long.groupBy("variable", "value", by).agg(_rows().alias("n"))
    if not show_na:
        counts = counts.filter(F.col("value").isNotNull())
    scope = ["variable", "value"] if margin == "row" else ["variable", by]
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*scope))
    return (counts.withColumn("pct", F.bround(share * 100, digits)).groupBy("variable", "value")
            .pivot(by, list(levels)).agg(F.coalesce(F.first("pct"), F.lit(0.0))).fillna(0.0, subset=[str(x) for x in levels]))


def share(df: DataFrame, *by: str, name: str = "perc") -> DataFrame:
    """Share of all rows in each combination of levels."""
    counts = df.groupBy(*by).agg(_rows().alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(*by, (F.col("n") / total).alias(name))


def quantile_table(df: DataFrame, col: str, probs: Sequence[float], name: str = "value") -> DataFrame:
    """Two columns: percentile label and value."""
    wide = quantiles(df, col, probs)
    return _stack(wide, [], [F.struct(F.lit(f"{p * 100:g}%").alias("percentile"), F.col(f"q{i}").alias(name))
                             for i, p in enumerate(probs)])


def weighted_corr(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted Pearson correlation over complete rows, centred at the weighted means."""
    d = complete(df.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"))]))
    means = d.agg(F.struct((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"),
                           (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"))).scalar()
    dx, dy = F.col("x") - means["mx"], F.col("y") - means["my"]
    sums = d.agg(F.sum(F.col("w") * dx * dy).alias("xy"), F.sum(F.col("w") * dx * dx).alias("xx"),
                 F.sum(F.col("w") * dy * dy).alias("yy"))
    return sums.select(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations of all column pairs, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _stack(wide, [], [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr"))
                             for i, (a, b) in enumerate(pairs)])


def _strata_cube(df: DataFrame, strata: Sequence[str], overall: bool, *aggs: Column, extra: Sequence[str] = ()):
    if not overall:
        return df.groupBy(*strata, *extra).agg(*aggs)
    sets = [[*strata[i:], *extra] for i in range(len(strata) + 1)]
    cols = [F.col(c) for c in (*strata, *extra)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*aggs)


def table_one(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], strata: Sequence[str],
              overall: bool = True) -> DataFrame:
    """Stratified descriptive table: 'mean (sd)' of continuous and a percentage per level of categorical variables.

    With `overall`, subtotals drop the strata from the left: 'All' stands for any value.
    """
    strata = list(strata)
    coded = df.withColumns({s: F.coalesce(F.col(s).cast("string"), F.lit("NA")) for s in strata})
    moments = [a for c in continuous for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    cont = _strata_cube(coded, strata, overall, *moments)
    cont = _stack(cont, strata, [
        F.struct(F.lit(c).alias("variable"), F.lit("Mean (SD)").alias("level"),
                 fmt_mean_sd(f"m_{c}", f"s_{c}").alias("text")) for c in continuous])

    long = coded.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in categorical}).unpivot(
        strata, list(categorical), "variable", "level")
    cells = long.groupBy(*strata, "variable", "level").agg(_rows().alias("n"))
    cat = _strata_cube(cells, strata, overall, F.sum("n").alias("n"), extra=["variable", "level"])
    scope = Window.partitionBy(*strata, "variable")
    cat = cat.select(*strata, "variable", "level", F.format_string(
        "%.2f%%", F.bround(F.col("n") * 100.0 / F.sum("n").over(scope), 2)).alias("text"))
    out = cont.unionByName(cat)
    return out.withColumns({s: F.coalesce(F.col(s), F.lit("All")) for s in strata})


def table_one_simple(df: DataFrame, binary: Sequence[str], continuous: Sequence[str], cohort: str) -> DataFrame:
    """Shares and 'mean (sd)' for cohort 1, cohort 0 and overall; missing values are skipped."""
    aggs = [F.avg(F.col(b).cast("double")).alias(f"m_{b}") for b in binary]
    aggs += [a for c in continuous for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    wide = df.groupingSets([[F.col(cohort)], []], F.col(cohort)).agg(*aggs, F.grouping(cohort).alias("_all"))
    grp = F.when(F.col("_all") == 1, "overall").when(F.col(cohort) == 1, "case").when(F.col(cohort) == 0, "control")
    items = [F.struct(F.lit(b).alias("variable"),
                      F.concat(F.format_string("%.2f", F.bround(F.col(f"m_{b}") * 100, 2)), F.lit("%")).alias("text"))
             for b in binary]
    items += [F.struct(F.lit(c).alias("variable"), fmt_mean_sd(F.bround(f"m_{c}", 2), F.bround(f"s_{c}", 2)).alias("text"))
              for c in continuous]
    long = _stack(wide.withColumn("grp", grp), ["grp"], items)
    return long.groupBy("variable").pivot("grp", ["case", "control", "overall"]).agg(F.first("text"))


def histogram(df: DataFrame, col: str, breaks: Sequence[float] | None = None, width: float | None = None,
              bins: int | None = None, by: str | None = None) -> DataFrame:
    """Counts per bin: fixed breaks (closed on the right), fixed width from 0, or k equal bins of the range.

    Output: [by], bin (number), lower edge, n. Values outside fixed breaks are not counted.
    """
    keys = _keys(by)
    d = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    if breaks is not None:
        d = d.withColumn("bin", cut_bins("_v", breaks).cast("bigint")).filter(F.col("bin").isNotNull())
        lower = F.element_at(F.array(*[F.lit(float(b)) for b in breaks]), F.col("bin").cast("int"))
    elif width is not None:
        d = d.withColumn("bin", F.floor(F.col("_v") / width).cast("bigint"))
        lower = F.col("bin") * F.lit(float(width))
    else:
        d = d.groupBy(*keys, "_v").agg(_rows().alias("_n"))
        edge = d.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        if keys:
            d = d.join(edge, keys)
        else:
            ends = edge.select(F.struct("_lo", "_hi")).scalar()
            d = d.withColumns({"_lo": ends["_lo"], "_hi": ends["_hi"]})
        step = (F.col("_hi") - F.col("_lo")) / bins
        d = d.withColumn("bin", F.when(step > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / step),
                                                         F.lit(bins - 1))).otherwise(0).cast("bigint"))
        return (d.groupBy(*keys, "bin").agg(F.sum("_n").alias("n"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
                .select(*keys, "bin", (F.col("_lo") + F.col("bin") * step).alias("lower"), "n"))
    return d.groupBy(*keys, "bin").agg(_rows().alias("n")).withColumn("lower", lower)


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR of the box) and outlier count per group."""
    d = df.filter(F.col(col).isNotNull()).groupBy(by, F.col(col).cast("double").alias("_v")).agg(_rows().alias("_n"))
    box = quantiles(df, col, [0.25, 0.5, 0.75], [by], ["q1", "median", "q3"])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return d.join(box, by).groupBy(by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("lower"), F.max(F.when(inside, F.col("_v"))).alias("upper"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).cast("bigint").alias("n_out"))


def bandwidth(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Rule-of-thumb bandwidth 0.9 * min(sd, IQR / 1.34) * n^-0.2, one row per group or one in all."""
    keys = _keys(by)
    spread = df.groupBy(*keys).agg(F.stddev_samp(col).alias("_sd"), F.count(col).alias("_count"))
    box = quantiles(df, col, [0.25, 0.75], keys, ["_low", "_high"])
    both = spread.join(box, keys) if keys else spread.withColumn("_k", F.lit(0)).join(
        box.withColumn("_k", F.lit(0)), "_k")
    width = F.least(F.col("_sd"), (F.col("_high") - F.col("_low")) / 1.34) * F.pow(
        F.col("_count").cast("double"), F.lit(-0.2)) * 0.9
    return both.select(*keys, width.alias("bw"))


def density(df: DataFrame, col: str, grid: Sequence[float], bw: float | None = None, by: str | None = None) -> DataFrame:
    """Gaussian kernel density on a grid. Equal values are counted once; the grid is a literal array."""
    keys = _keys(by)
    d = (df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("_v"))
         .agg(_rows().alias("_n")))
    if bw is not None:
        d = d.withColumn("_bw", F.lit(float(bw)))
    elif keys:
        d = d.join(bandwidth(df, col, by).withColumnRenamed("bw", "_bw"), keys)
    else:
        d = d.withColumn("_bw", bandwidth(df, col).select("bw").scalar())
    points = d.withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    z = (F.col("x") - F.col("_v")) / F.col("_bw")
    kernel = F.exp(-z * z / 2) / (F.col("_bw") * math.sqrt(2 * math.pi))
    return points.groupBy(*keys, "x").agg((F.sum(kernel * F.col("_n")) / F.sum("_n")).alias("density"))

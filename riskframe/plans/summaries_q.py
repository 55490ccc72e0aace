"""A: grouped summaries and descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import store
from ..operators import standardize as d, summarize as a
from ..sources.schema import ATTRIBUTES, INDICATORS
from .registry import query

N = "CAST(count(*) AS BIGINT) AS n"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("a1_count_by", f"SELECT entity, cohort, {N} FROM adm GROUP BY ALL")
def _(t):
    return a.count_by(t.adm("entity", "cohort"), "entity", "cohort")


@query("a2_rate_by", """SELECT entity, round(avg(outcome), 6) AS rate, CASE WHEN count(*) = count(comorb) THEN round(avg(comorb), 6) END AS strict_comorb,
round(avg(comorb), 6) AS comorb FROM adm GROUP BY entity""")
def _(t):
    df = t.adm("entity", "outcome", "comorb")
    out = a.rate_by(df, "entity", "outcome").join(a.rate_by(df, "entity", "comorb", "strict_comorb", False), "entity").join(
        a.rate_by(df, "entity", "comorb", "comorb"), "entity")
    return rounded(out, "rate", "strict_comorb", "comorb")


RATES = ", ".join(f"round(avg({c}), 6) AS case_{c}" for c in INDICATORS)


@query("a3_indicator_rates", f"SELECT entity, {RATES} FROM adm WHERE cohort = 1 GROUP BY entity")
def _(t):
    df = t.adm("entity", "cohort", *INDICATORS).filter("cohort = 1")
    return rounded(a.indicator_rates(df, "entity", INDICATORS, "case_"), *[f"case_{c}" for c in INDICATORS])


@query("a4_max_by_entity", "SELECT entity, max(teach) AS teach, max(highvolume) AS highvolume, max(bedsize) AS bedsize, max(region) AS region FROM adm GROUP BY entity")
def _(t):
    return a.max_by_entity(t.adm("entity", *ATTRIBUTES), "entity", ATTRIBUTES)


@query("a5_sum_by", "SELECT entity, CAST(sum(cohort) AS BIGINT) AS n_case FROM adm GROUP BY entity")
def _(t):
    return a.sum_by(t.adm("entity", "cohort"), "entity", "cohort", "n_case")


@query("a6_mean_where", """SELECT entity, round(avg(CASE WHEN vent = 1 THEN outcome END), 6) AS mort_v, round(avg(CASE WHEN vent = 0 THEN outcome END), 6) AS mort_nv,
round(avg(CASE WHEN cohort = 1 THEN bedsize END), 6) AS bed FROM adm GROUP BY entity""")
def _(t):
    specs = {"mort_v": ("outcome", F.col("vent") == 1), "mort_nv": ("outcome", F.col("vent") == 0), "bed": ("bedsize", F.col("cohort") == 1)}
    return rounded(a.mean_where(t.adm("entity", "cohort", "outcome", "vent", "bedsize"), "entity", specs), *specs)


@query("a7_profile_by", """SELECT CASE cohort WHEN 1 THEN 'case' ELSE 'control' END AS grp, entity, round(avg(vent), 6) AS vent_rate, round(avg(outcome), 6) AS outcome_rate,
round(avg(age), 6) AS mean_age, quantile_cont(age, 0.5) AS median_age, max(n_total) AS n_total
FROM adm JOIN (SELECT entity, CAST(count(*) AS BIGINT) AS n_total FROM adm GROUP BY entity) USING (entity) GROUP BY cohort, entity""")
def _(t):
    df = t.adm("entity", "cohort", "outcome", "vent", "age").withColumn("grp", F.when(F.col("cohort") == 1, "case").otherwise("control"))
    return rounded(a.profile_by(df, "grp", "entity", "outcome", "vent", "age"), "vent_rate", "outcome_rate", "mean_age")


@query("a8_mean_annual", """SELECT entity, round(avg(n), 6) AS cases_yr, round(avg(n1), 6) AS cohort_cases_yr FROM
(SELECT entity, period, count(*) AS n, sum(cohort) AS n1 FROM adm GROUP BY ALL) GROUP BY entity""")
def _(t):
    out = a.mean_annual(t.adm("entity", "period", "cohort"), "entity", "period",
                        {"cases_yr": F.count(F.lit(1)), "cohort_cases_yr": F.sum("cohort")})
    return rounded(out, "cases_yr", "cohort_cases_yr")


A9 = " UNION ALL ".join(f"SELECT cohort, '{c}' AS variable, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd FROM {src} GROUP BY ALL"
                        for c in ("age", "comorb") for src in ("adm", "(SELECT * REPLACE (NULL::INTEGER AS cohort) FROM adm)"))


@query("a9_mean_sd", A9)
def _(t):
    df = t.adm("cohort", "age", "comorb")
    both = a.mean_sd(df, ["age", "comorb"], "cohort").unionByName(a.mean_sd(df, ["age", "comorb"]).withColumn("cohort", F.lit(None).cast("int")))
    return rounded(both, "mean", "sd")


A10 = {"age": "printf('%.2f', round_even(avg(age), 2))", "female": "printf('%.2f', round_even(100 * avg(1 - male), 2)) || ' %'",
       "comorb": "printf('%.2f', round_even(avg(comorb), 2))", "vent": "printf('%.2f', round_even(100 * avg(vent), 2)) || ' %'",
       "medicare": "printf('%.2f', round_even(100 * avg(medicare), 2)) || ' %'"}
A10_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, cohort, outcome, {e} AS text FROM adm GROUP BY cohort, outcome" for m, e in A10.items())


@query("a10_summary_matrix", f"""SELECT metric, max(CASE WHEN cohort = 1 AND outcome = 0 THEN text END) AS case_alive,
max(CASE WHEN cohort = 1 AND outcome = 1 THEN text END) AS case_dead, max(CASE WHEN cohort = 0 AND outcome = 0 THEN text END) AS control_alive,
max(CASE WHEN cohort = 0 AND outcome = 1 THEN text END) AS control_dead FROM ({A10_LONG}) GROUP BY metric""")
def _(t):
    def num(c):
        return F.format_string("%.2f", F.bround(F.avg(c), 2))

    def pct(c):
        return F.format_string("%.2f %%", F.bround(F.avg(c) * 100, 2))
    metrics = {"age": num("age"), "female": pct(1 - F.col("male")), "comorb": num("comorb"), "vent": pct(F.col("vent")),
               "medicare": pct(F.col("medicare"))}
    return a.summary_matrix(t.adm("outcome", "cohort", "age", "male", "comorb", "vent", "medicare"), "outcome", "cohort", metrics)


# Yearly relative risks stand in for replicates: one value per entity and period.
YEARLY_SQL = """yearly AS (SELECT entity, period, CASE WHEN o0 > 0 AND e1 > 0 THEN (o1 / e1) / (o0 / e0) END AS rr FROM (
  SELECT entity, period, sum(CASE WHEN cohort = 0 THEN outcome END)::DOUBLE AS o0, sum(CASE WHEN cohort = 0 THEN risk END) AS e0,
         sum(CASE WHEN cohort = 1 THEN outcome END)::DOUBLE AS o1, sum(CASE WHEN cohort = 1 THEN risk END) AS e1 FROM adm GROUP BY ALL))"""


def yearly(t):
    return d.relative_risk(t.adm("entity", "period", "cohort", "outcome", "risk"), ["entity", "period"]).select("entity", "period", "rr")


SUMMARY_SQL = """SELECT entity, round(quantile_cont(rr, 0.25), 6) AS q1, round(quantile_cont(rr, 0.5), 6) AS median, round(quantile_cont(rr, 0.75), 6) AS q3,
round(quantile_cont(rr, 0.025), 6) AS lcb, round(quantile_cont(rr, 0.975), 6) AS ucb, round(avg(rr), 6) AS mean, round(stddev_samp(rr), 6) AS sd,
round(max(rr), 6) AS max, round(min(rr), 6) AS min, round(max(rr) - min(rr), 6) AS range, round(quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25), 6) AS iqr"""


@query("a11_summarize_replicates", f"WITH {YEARLY_SQL} {SUMMARY_SQL} FROM yearly GROUP BY entity")
def _(t):
    out = a.summarize_replicates(yearly(t))
    return rounded(out, *[c for c in out.columns if c != "entity"])


@query("a12_replicate_spread", f"WITH {YEARLY_SQL} SELECT entity, round(stddev_samp(rr), 6) AS sd, round(min(rr), 6) AS mins, round(max(rr), 6) AS maxs FROM yearly GROUP BY entity")
def _(t):
    return rounded(a.replicate_spread(yearly(t)), "sd", "mins", "maxs")


@query("a13_exceed_prob", f"WITH {YEARLY_SQL} SELECT entity, round(avg(CASE WHEN rr >= 2 THEN 1.0 WHEN rr < 2 THEN 0.0 END), 6) AS exceed FROM yearly GROUP BY entity")
def _(t):
    return rounded(a.exceed_prob(yearly(t), 2.0), "exceed")


@query("a14_headline", """WITH e AS (SELECT entity, avg(outcome) AS rate,
 (sum(CASE WHEN cohort = 1 THEN outcome END) / sum(CASE WHEN cohort = 1 THEN risk END)) / (sum(CASE WHEN cohort = 0 THEN outcome END) / sum(CASE WHEN cohort = 0 THEN risk END)) AS rr
 FROM adm GROUP BY entity)
SELECT (SELECT CAST(count(DISTINCT entity) AS BIGINT) FROM adm) AS n_entities, (SELECT CAST(count(*) AS BIGINT) FROM adm) AS n_cases,
 (SELECT CAST(sum(cohort) AS BIGINT) FROM adm) AS n_cohort, round(min(rate), 6) AS min_rate, round(quantile_cont(rate, 0.5), 6) AS median_rate, round(max(rate), 6) AS max_rate,
 round(min(rr), 6) AS min_rr, round(quantile_cont(rr, 0.5), 6) AS median_rr, round(max(rr), 6) AS max_rr, round(avg(CASE WHEN rr >= 2 THEN 1.0 ELSE 0.0 END), 6) AS share_high,
 CAST(count(CASE WHEN rr >= 2 THEN 1 END) AS BIGINT) AS n_high, CAST(count(CASE WHEN rr = 0 THEN 1 END) AS BIGINT) AS n_zero FROM e""")
def _(t):
    cases = store(t.adm("entity", "cohort", "outcome", "risk"), "entity")
    out = a.headline(cases, d.rr_summary(cases))
    return rounded(out, "min_rate", "median_rate", "max_rate", "min_rr", "median_rr", "max_rr", "share_high")


@query("a15_attr_stability", f"""SELECT totals, {N} FROM (SELECT entity, CAST(count(DISTINCT ses) + max(CASE WHEN ses IS NULL THEN 1 ELSE 0 END)
 + count(DISTINCT teach) + count(DISTINCT bedsize) + count(DISTINCT race) AS BIGINT) AS totals FROM adm GROUP BY entity) GROUP BY totals""")
def _(t):
    return a.attr_stability(t.adm("entity", "ses", "teach", "bedsize", "race"), "entity", ["ses", "teach", "bedsize", "race"])


@query("a16_distinct", "SELECT DISTINCT entity, teach, highvolume, bedsize, region FROM adm")
def _(t):
    return a.distinct_values(t.adm("entity", *ATTRIBUTES), "entity", *ATTRIBUTES)


def crosstab_sql(variables, by, levels, margin):
    long = " UNION ALL ".join(f"SELECT '{v}' AS variable, {v}::VARCHAR AS value, {by} FROM adm" for v in variables)
    scope = "variable, value" if margin == "row" else f"variable, {by}"
    cells = ", ".join(f"coalesce(max(CASE WHEN {by} = {x} THEN pct END), 0.0)::DOUBLE AS \"{x}\"" for x in levels)
    return f"""SELECT variable, value, {cells} FROM (SELECT variable, value, {by}, round_even(100 * n / sum(n) OVER (PARTITION BY {scope}), 2) AS pct
FROM (SELECT variable, value, {by}, count(*)::DOUBLE AS n FROM ({long}) GROUP BY ALL)) GROUP BY variable, value"""


@query("a17_crosstab_pct", crosstab_sql(["bedsize", "teach", "ses"], "region", [1, 2, 3, 4], "col"))
def _(t):
    return a.crosstab_pct(t.adm("bedsize", "teach", "ses", "region"), ["bedsize", "teach", "ses"], "region", [1, 2, 3, 4], "col")


@query("a17_crosstab_pct_row", crosstab_sql(["bedsize", "teach", "ses"], "outcome", [0, 1], "row"))
def _(t):
    return a.crosstab_pct(t.adm("bedsize", "teach", "ses", "outcome"), ["bedsize", "teach", "ses"], "outcome", [0, 1], "row")


@query("a18_share", "SELECT payer, cohort, round(n / sum(n) OVER (), 6) AS perc FROM (SELECT payer, cohort, count(*)::DOUBLE AS n FROM adm GROUP BY ALL)")
def _(t):
    return rounded(a.share(t.adm("payer", "cohort"), "payer", "cohort"), "perc")


PROBS = [0, .1, .25, .5, .75, .9, 1]
A19 = " UNION ALL ".join(f"SELECT '{p * 100:g}%' AS percentile, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem" for p in PROBS)


@query("a19_quantile_table", A19)
def _(t):
    return rounded(a.quantile_table(t.table("lineitem"), "l_extendedprice", PROBS), "value")


@query("a20_weighted_corr", """WITH e AS (SELECT avg(outcome)::DOUBLE AS y, avg(vent)::DOUBLE AS x, count(*)::DOUBLE AS w FROM adm GROUP BY entity),
m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM e)
SELECT round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)), 6) AS corr FROM e, m""")
def _(t):
    e = t.adm("entity", "outcome", "vent").groupBy("entity").agg(F.avg("outcome").alias("y"), F.avg("vent").alias("x"), F.count(F.lit(1)).alias("w"))
    return rounded(a.weighted_corr(e, "x", "y", "w"), "corr")


PAIRS = [("age", "comorb"), ("age", "risk"), ("comorb", "risk")]
A21 = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM adm" for x, y in PAIRS)


@query("a21_corr_matrix", A21)
def _(t):
    return rounded(a.corr_matrix(t.adm("age", "comorb", "risk"), ["age", "comorb", "risk"]), "corr")


def table_one_sql():
    parts = []
    for sets, o, c in (("GROUP BY outcome, cohort", "outcome::VARCHAR", "cohort::VARCHAR"), ("GROUP BY cohort", "'All'", "cohort::VARCHAR"), ("", "'All'", "'All'")):
        for v in ("age", "comorb"):
            parts.append(f"SELECT {o} AS outcome, {c} AS cohort, '{v}' AS variable, 'Mean (SD)' AS level, printf('%.2f (%.2f)', avg({v}), stddev_samp({v})) AS text FROM adm {sets}")
        for v in ("male", "region", "ses"):
            keys = sets + (", " if sets else "GROUP BY ") + "level"
            part = "PARTITION BY outcome, cohort"
            parts.append(f"""SELECT outcome, cohort, '{v}' AS variable, level, printf('%.2f%%', round_even(100 * n / sum(n) OVER ({part}), 2)) AS text FROM
 (SELECT {o} AS outcome, {c} AS cohort, level, count(*)::DOUBLE AS n FROM (SELECT outcome, cohort, coalesce({v}::VARCHAR, 'Missing') AS level FROM adm) {keys})""")
    return " UNION ALL ".join(parts)


@query("a22_table_one", table_one_sql())
def _(t):
    df = t.adm("age", "comorb", "male", "region", "ses", "outcome", "cohort")
    return a.table_one(df, ["age", "comorb"], ["male", "region", "ses"], ["outcome", "cohort"])


def simple_sql():
    parts = []
    groups = {"case": "FILTER (cohort = 1)", "control": "FILTER (cohort = 0)", "overall": ""}
    for v in INDICATORS:
        cells = ", ".join(f"printf('%.2f', round_even(100 * avg({v}) {f}, 2)) || '%' AS \"{g}\"" for g, f in groups.items())
        parts.append(f"SELECT '{v}' AS variable, {cells} FROM adm")
    for v in ("age", "comorb"):
        cells = ", ".join(f"printf('%.2f (%.2f)', round_even(avg({v}) {f}, 2), round_even(stddev_samp({v}) {f}, 2)) AS \"{g}\"" for g, f in groups.items())
        parts.append(f"SELECT '{v}' AS variable, {cells} FROM adm")
    return " UNION ALL ".join(parts)


@query("a23_table_one_simple", simple_sql())
def _(t):
    return a.table_one_simple(t.adm("cohort", "age", "comorb", *INDICATORS), INDICATORS, ["age", "comorb"], "cohort")


OE_SQL = "oe AS (SELECT entity, sum(outcome) / sum(risk) AS oe_ratio FROM adm WHERE cohort = 1 GROUP BY entity)"


def oe(t):
    return d.oe_by(t.adm("entity", "cohort", "outcome", "risk").filter("cohort = 1"), ["entity"])


@query("a24_histogram_width", f"WITH {OE_SQL} SELECT CAST(floor(oe_ratio / 0.25::DOUBLE) AS BIGINT) AS bin, round(floor(oe_ratio / 0.25::DOUBLE) * 0.25::DOUBLE, 6) AS lower, {N} FROM oe GROUP BY ALL")
def _(t):
    return rounded(a.histogram(oe(t), "oe_ratio", width=0.25), "lower")


@query("a24_histogram_breaks", f"""WITH {OE_SQL} SELECT CAST(greatest(ceil(oe_ratio), 1) AS BIGINT) AS bin, greatest(ceil(oe_ratio), 1) - 1 AS lower, {N} FROM oe WHERE oe_ratio <= 11 GROUP BY ALL""")
def _(t):
    return a.histogram(oe(t), "oe_ratio", breaks=list(range(12)))


HIST_VARS = {"rate": "avg(outcome)::DOUBLE", "cases_yr": "(count(*) / 7)::DOUBLE"}
HIST_LONG = " UNION ALL ".join(f"SELECT '{k}' AS variable, {e} AS value FROM adm GROUP BY entity" for k, e in HIST_VARS.items())


@query("a24_histogram_bins", f"""WITH l AS ({HIST_LONG}), m AS (SELECT variable, min(value) AS lo, (max(value) - min(value)) / 15 AS w FROM l GROUP BY variable)
SELECT variable, CAST(least(floor((value - lo) / w), 14) AS BIGINT) AS bin, round(lo + least(floor((value - lo) / w), 14) * w, 6) AS lower, {N} FROM l JOIN m USING (variable) GROUP BY ALL""")
def _(t):
    g = t.adm("entity", "outcome").groupBy("entity").agg(F.avg("outcome").alias("rate"), (F.count(F.lit(1)) / 7).alias("cases_yr"))
    return rounded(a.histogram(g.unpivot(["entity"], ["rate", "cases_yr"], "variable", "value"), "value", bins=15, by="variable"), "lower")


@query("a25_box_stats", """WITH b AS (SELECT period, quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS median, quantile_cont(age, 0.75) AS q3 FROM adm WHERE cohort = 1 GROUP BY period)
SELECT period, q1, median, q3, min(CASE WHEN age BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN age END) AS lower,
max(CASE WHEN age BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN age END) AS upper,
CAST(count(CASE WHEN age < q1 - 1.5 * (q3 - q1) OR age > q3 + 1.5 * (q3 - q1) THEN 1 END) AS BIGINT) AS n_out
FROM adm JOIN b USING (period) WHERE cohort = 1 GROUP BY ALL""")
def _(t):
    return a.box_stats(t.adm("cohort", "period", "age").filter("cohort = 1"), "age", "period")


@query("a26_density", """WITH e AS (SELECT highvolume, avg(outcome)::DOUBLE AS x FROM adm GROUP BY entity, highvolume),
g AS (SELECT i * 0.01::DOUBLE AS x FROM range(51) r(i))
SELECT highvolume, round(g.x, 6) AS x, round(avg(exp(-0.5 * pow((g.x - e.x) / 0.02::DOUBLE, 2))) / (0.02::DOUBLE * sqrt(2 * pi())), 6) AS density FROM e, g GROUP BY highvolume, g.x""")
def _(t):
    e = t.adm("entity", "highvolume", "outcome").groupBy("entity", "highvolume").agg(F.avg("outcome").alias("rate"))
    return rounded(a.density(e, "rate", [i * 0.01 for i in range(51)], bw=0.02, by="highvolume"), "x", "density")


@query("a26_density_auto", """WITH e AS (SELECT avg(outcome)::DOUBLE AS x FROM adm GROUP BY entity),
b AS (SELECT 0.9::DOUBLE * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE) * pow(count(*), -0.2::DOUBLE) AS bw FROM e),
g AS (SELECT i * 0.01::DOUBLE AS x FROM range(51) r(i))
SELECT round(g.x, 6) AS x, round(avg(exp(-0.5 * pow((g.x - e.x) / bw, 2)) / (bw * sqrt(2 * pi()))), 6) AS density FROM e, g, b GROUP BY g.x""")
def _(t):
    e = t.adm("entity", "outcome").groupBy("entity").agg(F.avg("outcome").alias("rate"))
    return rounded(a.density(e, "rate", [i * 0.01 for i in range(51)]), "x", "density")

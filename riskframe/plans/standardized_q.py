"""D and M9: risk standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import from_dummies
from ..operators import order, project, standardize as d, summarize as a
from ..sources.schema import ATTRIBUTES, BEDSIZES, INDICATORS, REGIONS, TEACHING, VOLUMES
from .registry import query
from .summaries_q import YEARLY_SQL, rounded, yearly

CORE = ("entity", "cohort", "outcome", "risk")

PROFILE_COLS = ", ".join(
    f"CAST(nullif(count(CASE WHEN cohort = {k} THEN 1 END), 0) AS BIGINT) AS {g}_n, "
    + ", ".join(f"round(avg(CASE WHEN cohort = {k} THEN {c} END), 6) AS {g}_{c}" for c in ["outcome", *INDICATORS])
    for k, g in ((1, "case"), (0, "control")))
PROFILE_SQL = f"""profile AS (SELECT entity, CAST(count(*) AS BIGINT) AS n_cases, {PROFILE_COLS},
 max(teach) AS teach, max(highvolume) AS highvolume, max(bedsize) AS bedsize, max(region) AS region FROM adm GROUP BY entity)"""


def profile(t):
    df = t.adm("entity", "cohort", "outcome", *INDICATORS, *ATTRIBUTES)
    out = d.entity_profile(df, "entity", "cohort", ["outcome", *INDICATORS], ATTRIBUTES)
    return rounded(out, *[f"{g}_{c}" for g in ("case", "control") for c in ["outcome", *INDICATORS]])


@query("d1_entity_profile", f"WITH {PROFILE_SQL} SELECT * FROM profile")
def _(t):
    return profile(t)


def oe_sql(keys, where=""):
    return f"""SELECT {keys}, obs, round(expect, 6) AS expect, round(obs / expect, 6) AS oe_ratio, CASE WHEN obs > 0 THEN round(ln(obs / expect), 6) END AS log_oe
FROM (SELECT {keys}, sum(outcome)::DOUBLE AS obs, sum(risk) AS expect FROM adm {where} GROUP BY ALL)"""


@query("d2_oe_by_entity", oe_sql("entity", "WHERE cohort = 1"))
def _(t):
    return rounded(d.oe_by(t.adm(*CORE).filter("cohort = 1"), ["entity"]), "expect", "oe_ratio", "log_oe")


@query("d3_oe_by_cohort", oe_sql("entity, cohort"))
def _(t):
    return rounded(d.oe_by(t.adm(*CORE), ["entity", "cohort"]), "expect", "oe_ratio", "log_oe")


RR_SQL = """rr AS (SELECT entity, rate, oe_0, oe_1, CASE WHEN oe_0 > 0 THEN oe_1 / oe_0 END AS rr FROM (
  SELECT entity, avg(outcome)::DOUBLE AS rate, sum(CASE WHEN cohort = 0 THEN outcome END) / sum(CASE WHEN cohort = 0 THEN risk END) AS oe_0,
         sum(CASE WHEN cohort = 1 THEN outcome END) / sum(CASE WHEN cohort = 1 THEN risk END) AS oe_1
  FROM adm GROUP BY entity))"""


@query("d4_relative_risk", f"WITH {RR_SQL} SELECT entity, round(oe_0, 6) AS oe_0, round(oe_1, 6) AS oe_1, round(rr, 6) AS rr FROM rr")
def _(t):
    rr = d.relative_risk(t.adm(*CORE))
    return order.sort_by(rounded(rr, "oe_0", "oe_1", "rr"), "rr", descending=True)


@query("d5_entity_risk", f"""WITH {PROFILE_SQL}, {RR_SQL}, {YEARLY_SQL},
vol AS (SELECT entity, avg(n) AS cases_yr, avg(n1) AS cohort_cases_yr FROM (SELECT entity, period, count(*) AS n, sum(cohort) AS n1 FROM adm GROUP BY ALL) GROUP BY entity),
ex AS (SELECT entity, avg(CASE WHEN rr >= 2 THEN 1.0 WHEN rr < 2 THEN 0.0 END)::DOUBLE AS exceed FROM yearly GROUP BY entity)
SELECT profile.*, round(rr.rr, 6) AS rr, round(rr.rate, 6) AS rate, round(cases_yr, 6) AS cases_yr, round(cohort_cases_yr, 6) AS cohort_cases_yr,
 round(exceed, 6) AS exceed, CASE WHEN rr.rr >= 2 THEN 1 WHEN rr.rr < 2 THEN 0 END AS high_rr
FROM profile LEFT JOIN rr USING (entity) LEFT JOIN vol USING (entity) LEFT JOIN ex USING (entity)""")
def _(t):
    out = d.entity_risk(t.adm(*CORE, "period"), profile(t), a.exceed_prob(yearly(t), 2.0))
    return rounded(out, "rr", "rate", "cases_yr", "cohort_cases_yr", "exceed")


@query("d6_rr_summary", f"""WITH {RR_SQL} SELECT entity, round(rr, 6) AS rr, n_control, round(rate, 6) AS rate FROM rr
FULL JOIN (SELECT entity, CAST(count(*) AS BIGINT) AS n_control FROM adm WHERE cohort = 0 GROUP BY entity) USING (entity)""")
def _(t):
    return rounded(d.rr_summary(t.adm(*CORE)), "rr", "rate")


@query("d7_flag_high", f"""WITH {RR_SQL} SELECT entity, CASE WHEN oe_1 > 2 THEN 1 WHEN oe_1 <= 2 THEN 0 END AS high_oe,
CASE WHEN rr >= 2 THEN 1 WHEN rr < 2 THEN 0 END AS high_rr FROM rr""")
def _(t):
    rr = d.relative_risk(t.adm(*CORE))
    out = d.flag_high(d.flag_high(rr, "oe_1", 2.0, True, "high_oe"), "rr", 2.0, False, "high_rr")
    return out.select("entity", "high_oe", "high_rr")


QUAD = """quad AS (SELECT entity, CASE WHEN oe_1 {op} 2 THEN 'High Rel' ELSE 'Low Rel' END AS rel_class,
 CASE WHEN rate {op} (SELECT quantile_cont(rate, 0.5) FROM rr) THEN 'High Abs' ELSE 'Low Abs' END AS abs_class FROM rr)"""


def quad(t, inclusive=False):
    df = t.adm(*CORE)
    oe = d.relative_risk(df).select("entity", F.col("oe_1").alias("oe_ratio"))
    both = a.rate_by(df, "entity", "outcome").join(oe, "entity", "left")
    return d.quadrants(both, inclusive=inclusive)


@query("d8_quadrants", f"WITH {RR_SQL}, {QUAD.format(op='>')} SELECT *, rel_class || ' / ' || abs_class AS quadrant FROM quad")
def _(t):
    return quad(t).select("entity", "rel_class", "abs_class", "quadrant")


@query("d8_quadrants_inclusive", f"WITH {RR_SQL}, {QUAD.format(op='>=')} SELECT *, rel_class || ' / ' || abs_class AS quadrant FROM quad")
def _(t):
    return quad(t, True).select("entity", "rel_class", "abs_class", "quadrant")


@query("d8_quadrant_crosstab", f"""WITH {RR_SQL}, {QUAD.format(op='>')}, q AS (SELECT entity, rel_class || ' / ' || abs_class AS quadrant FROM quad),
l AS (SELECT 'bedsize' AS variable, bedsize::VARCHAR AS value, quadrant FROM q JOIN (SELECT DISTINCT entity, bedsize FROM adm) USING (entity)
 UNION ALL SELECT 'region', region::VARCHAR, quadrant FROM q JOIN (SELECT DISTINCT entity, region FROM adm) USING (entity)),
p AS (SELECT *, round_even(100 * n / sum(n) OVER (PARTITION BY variable, quadrant), 2) AS pct FROM (SELECT variable, value, quadrant, count(*)::DOUBLE AS n FROM l GROUP BY ALL))
SELECT variable, value, {', '.join(f"coalesce(max(CASE WHEN quadrant = '{r} Rel / {b} Abs' THEN pct END), 0.0)::DOUBLE AS {r.lower()}_{b.lower()}" for r in ('High', 'Low') for b in ('High', 'Low'))}
FROM p GROUP BY variable, value""")
def _(t):
    attrs = a.max_by_entity(t.adm("entity", "bedsize", "region"), "entity", ["bedsize", "region"])
    df = quad(t).join(attrs, "entity")
    names = [(r, b) for r in ("High", "Low") for b in ("High", "Low")]
    out = a.crosstab_pct(df, ["bedsize", "region"], "quadrant", [f"{r} Rel / {b} Abs" for r, b in names])
    return project.rename(out, {f"{r} Rel / {b} Abs": f"{r.lower()}_{b.lower()}" for r, b in names})


@query("d9_cohort_attrs", """SELECT entity, CASE CAST(round_even(avg(highvolume), 0) AS INTEGER) WHEN 0 THEN 'Low' WHEN 1 THEN 'High' END AS highvolume,
 CASE CAST(round_even(avg(bedsize), 0) AS INTEGER) WHEN 1 THEN 'Small' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Large' END AS bedsize,
 CASE CAST(round_even(avg(teach), 0) AS INTEGER) WHEN 1 THEN 'Rural' WHEN 2 THEN 'Urban non-teaching' WHEN 3 THEN 'Urban teaching' END AS teach,
 CASE max(region) WHEN 1 THEN 'Northeast' WHEN 2 THEN 'Midwest' WHEN 3 THEN 'South' WHEN 4 THEN 'West' END AS region FROM adm WHERE cohort = 1 GROUP BY entity""")
def _(t):
    df = t.adm("entity", "cohort", "highvolume", "bedsize", "teach", "region")
    flags = [f"r{i}" for i in range(1, 5)]
    df = df.withColumns({f: (F.col("region") == i).cast("int") for i, f in enumerate(flags, 1)})
    out = d.cohort_attrs(df, "entity", "cohort", ["highvolume", "bedsize", "teach", *flags])
    lv = {"highvolume": project.Levels((0, 1), tuple(VOLUMES)), "bedsize": project.Levels((1, 2, 3), tuple(BEDSIZES)),
          "teach": project.Levels((1, 2, 3), tuple(TEACHING))}
    for c, x in lv.items():
        out = project.as_levels(out, c, x)
    return out.withColumn("region", from_dummies(flags, REGIONS)).drop(*flags).filter("bedsize IS NOT NULL")


@query("d10_smr", """SELECT entity, round(p1 * n, 6) AS expect1, CASE WHEN p1 > 0 THEN round(dead / (p1 * n), 6) END AS smr1, round(p2 * n, 6) AS expect2, round(dead / (p2 * n), 6) AS smr2 FROM (
SELECT entity, count(CASE WHEN cohort = 1 THEN 1 END)::DOUBLE AS n, sum(CASE WHEN cohort = 1 THEN outcome END)::DOUBLE AS dead,
 avg(CASE WHEN cohort = 0 THEN outcome END)::DOUBLE AS p1, avg(CASE WHEN cohort = 0 THEN risk END) AS p2 FROM adm GROUP BY entity)""")
def _(t):
    k1, k0 = F.col("cohort") == 1, F.col("cohort") == 0
    g = t.adm(*CORE).groupBy("entity").agg(F.sum(k1.cast("double")).alias("n"), F.sum(F.when(k1, F.col("outcome").cast("double"))).alias("dead"),
                                           F.avg(F.when(k0, F.col("outcome"))).alias("p1"), F.avg(F.when(k0, F.col("risk"))).alias("p2"))
    out = d.smr(g, ["p1", "p2"], "n", "dead").select("entity", "expect1", "smr1", "expect2", "smr2")
    return rounded(out, "expect1", "smr1", "expect2", "smr2")


@query("d11_excess_risk", """SELECT entity, CASE WHEN r0 > 0 THEN round((r1 - r0) / r0, 6) END AS excess_risk FROM (SELECT entity,
avg(CASE WHEN cohort = 1 THEN outcome END) AS r1, avg(CASE WHEN cohort = 0 THEN outcome END) AS r0 FROM adm GROUP BY entity)""")
def _(t):
    c = d.cohort_compare(t.adm("entity", "cohort", "outcome"), "entity", "cohort", "outcome")
    return rounded(d.excess_risk(c, "case_rate", "control_rate").select("entity", "excess_risk"), "excess_risk")


@query("d12_stratified_rates", """SELECT entity, round(case_v, 6) AS case_v, round(case_nv, 6) AS case_nv, round(control_v, 6) AS control_v, round(control_nv, 6) AS control_nv FROM (
SELECT a.entity, case_v, case_nv, control_v, control_nv FROM
(SELECT entity, avg(CASE WHEN vent = 1 THEN outcome END) AS case_v, avg(CASE WHEN vent = 0 THEN outcome END) AS case_nv FROM adm WHERE cohort = 1 GROUP BY entity HAVING count(*) >= 10) a
FULL JOIN (SELECT entity, avg(CASE WHEN vent = 1 THEN outcome END) AS control_v, avg(CASE WHEN vent = 0 THEN outcome END) AS control_nv FROM adm WHERE cohort = 0 GROUP BY entity) b USING (entity))
WHERE case_nv > 0 OR case_v > 0""")
def _(t):
    out = d.stratified_rates(t.adm("entity", "cohort", "outcome", "vent"), "entity", "cohort", "outcome", "vent", 10)
    return rounded(out, "case_v", "case_nv", "control_v", "control_nv")


@query("d13_cohort_compare", """SELECT entity, CAST(n1 AS BIGINT) AS case_n, CAST(n0 AS BIGINT) AS control_n, round(r1, 6) AS case_rate, round(r0, 6) AS control_rate,
CAST(n1 + n0 AS BIGINT) AS total, round(n1 / (n1 + n0), 6) AS case_share FROM (SELECT entity, count(*)::DOUBLE AS n1, avg(outcome) AS r1 FROM adm WHERE cohort = 1 GROUP BY entity)
JOIN (SELECT entity, count(*)::DOUBLE AS n0, avg(outcome) AS r0 FROM adm WHERE cohort = 0 GROUP BY entity) USING (entity)""")
def _(t):
    return rounded(d.cohort_compare(t.adm("entity", "cohort", "outcome"), "entity", "cohort", "outcome"), "case_rate", "control_rate", "case_share")


@query("d14_odds_ratio_by", """SELECT entity, CAST(n00 AS BIGINT) AS n00, CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, CAST(n11 AS BIGINT) AS n11,
CAST((n00 > 0)::INT + (n01 > 0)::INT + (n10 > 0)::INT + (n11 > 0)::INT AS BIGINT) AS n_cells,
CASE WHEN n00 > 0 AND n01 > 0 AND n10 > 0 AND n11 > 0 THEN round(n00 * n11 / (n01 * n10), 6) END AS odds_ratio
FROM (SELECT entity, sum((outcome = 0 AND cohort = 0)::INT)::DOUBLE AS n00, sum((outcome = 0 AND cohort = 1)::INT)::DOUBLE AS n01,
 sum((outcome = 1 AND cohort = 0)::INT)::DOUBLE AS n10, sum((outcome = 1 AND cohort = 1)::INT)::DOUBLE AS n11 FROM adm GROUP BY entity)""")
def _(t):
    return rounded(d.odds_ratio_by(t.adm("entity", "cohort", "outcome"), "entity", "cohort", "outcome"), "odds_ratio")


@query("d18_compare_scores", """SELECT entity, round((o1 / a1) / (o0 / a0), 6) AS rr_a, round((o1 / b1) / (o0 / b0), 6) AS rr_b FROM (SELECT entity,
 sum(CASE WHEN cohort = 1 THEN outcome END)::DOUBLE AS o1, sum(CASE WHEN cohort = 0 THEN outcome END)::DOUBLE AS o0,
 sum(CASE WHEN cohort = 1 THEN risk END) AS a1, sum(CASE WHEN cohort = 0 THEN risk END) AS a0,
 sum(CASE WHEN cohort = 1 THEN age / 100 END) AS b1, sum(CASE WHEN cohort = 0 THEN age / 100 END) AS b0 FROM adm GROUP BY entity)""")
def _(t):
    df = t.adm(*CORE, "age").withColumn("risk2", F.col("age") / 100)
    return rounded(d.compare_scores(df, "risk", "risk2"), "rr_a", "rr_b")


@query("m9_oe_within_entity", """WITH cells AS (SELECT entity, age_cat, vent, male, f_cardiac, sum(1 - cohort)::DOUBLE AS n0, sum((1 - cohort) * outcome)::DOUBLE AS d0,
 sum(cohort)::DOUBLE AS n1, sum(cohort * outcome)::DOUBLE AS d1 FROM adm GROUP BY ALL),
w AS (SELECT entity, sum(d0) / sum(n0) AS rate0 FROM cells GROUP BY entity)
SELECT entity, obs, round(expect, 6) AS expect, round(obs / expect, 6) AS oe_ratio, CASE WHEN obs > 0 THEN round(ln(obs / expect), 6) END AS log_oe FROM (
SELECT entity, sum(d1) AS obs, sum(n1 * (d0 + 5 * rate0) / (n0 + 5)) AS expect FROM cells JOIN w USING (entity) WHERE n1 > 0 GROUP BY entity)""")
def _(t):
    covars = ["age_cat", "vent", "male", "f_cardiac"]
    out = d.oe_within_entity(t.adm("entity", "cohort", "outcome", *covars), "entity", "cohort", "outcome", covars)
    return rounded(out, "expect", "oe_ratio", "log_oe")

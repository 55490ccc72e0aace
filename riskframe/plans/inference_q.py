"""I: tests, resampling, survey estimates and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import MASK, MULTIPLIERS, SEED_STEP, SHIFTS, poisson_cdf
from ..functions.nulls import if_else
from ..operators import draws as dr, inference as inf, resample, summarize as a, survey
from .registry import query
from .summaries_q import SUMMARY_SQL, rounded

CORE = ("entity", "cohort", "outcome", "risk")


def tail_sql(x, n, p):
    terms = f"exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - {p}))"
    return f"CASE WHEN {x} = 0 THEN 1.0 ELSE list_sum(list_transform(range({x}, {n} + 1), lambda k: {terms})) END"


CASES_SQL = """c AS (SELECT entity, CAST(sum(cohort) AS BIGINT) AS n, CAST(sum(cohort * outcome) AS BIGINT) AS x,
 avg(CASE WHEN cohort = 0 THEN outcome END)::DOUBLE AS p0, avg(CASE WHEN cohort = 0 THEN risk END) AS p1, avg(CASE WHEN cohort = 1 THEN risk END) AS p2 FROM adm GROUP BY entity)"""


def cases(t):
    k1, k0 = F.col("cohort") == 1, F.col("cohort") == 0
    return t.adm(*CORE).groupBy("entity").agg(
        F.sum("cohort").alias("n"), F.sum(F.col("cohort") * F.col("outcome")).alias("x"),
        F.avg(F.when(k0, F.col("outcome"))).alias("p0"), F.avg(F.when(k0, F.col("risk"))).alias("p1"), F.avg(F.when(k1, F.col("risk"))).alias("p2"))


@query("i1_binom_test_by", f"WITH {CASES_SQL} SELECT entity, x, n, round({tail_sql('x', 'n', 'p0')}, 6) AS p_value FROM c")
def _(t):
    out = inf.binom_test_by(cases(t), "x", "n", {"p_value": "p0"})
    return rounded(out.select("entity", "x", "n", "p_value"), "p_value")


@query("i2_binom_test_models", f"""WITH {CASES_SQL} SELECT entity, round({tail_sql('x', 'n', 'p0')}, 6) AS pval1,
round({tail_sql('x', 'n', 'p1')}, 6) AS pval2, round({tail_sql('x', 'n', 'p2')}, 6) AS pval3 FROM c""")
def _(t):
    out = inf.binom_test_by(cases(t), "x", "n", {"pval1": "p0", "pval2": "p1", "pval3": "p2"})
    return rounded(out.select("entity", "pval1", "pval2", "pval3"), "pval1", "pval2", "pval3")


# Two-sided normal p and chi-squared tail by Simpson's rule on 4,000 steps.
def simpson(f, top):
    return f"""list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.format(x=f'(i * {top} / 4000)')}))) * {top} / 12000"""


P_NORMAL = f"1 - 2 * {simpson('exp(-0.5 * {x} * {x}) / sqrt(2 * pi())', 'abs(z)')}"
P_CHI = f"1 - {simpson('2 * pow({x}, df - 1) * exp(-0.5 * {x} * {x}) / (pow(2, df / 2) * gamma(df / 2))', 'sqrt(statistic)')}"

LONG_SQL = """e AS (SELECT entity, avg(outcome)::DOUBLE AS rate, count(*) / 7::DOUBLE AS cases_yr, avg(vent)::DOUBLE AS vent,
 CASE WHEN sum(cohort * outcome) = 0 THEN 1 ELSE 0 END AS g FROM adm GROUP BY entity),
l AS (SELECT 'rate' AS variable, rate AS value, g FROM e UNION ALL SELECT 'cases_yr', cases_yr, g FROM e UNION ALL SELECT 'vent', vent, g FROM e)"""


def entity_long(t):
    e = t.adm("entity", "cohort", "outcome", "vent").groupBy("entity").agg(
        F.avg("outcome").alias("rate"), (F.count(F.lit(1)) / F.lit(7.0)).alias("cases_yr"), F.avg("vent").alias("vent"),
        (F.sum(F.col("cohort") * F.col("outcome")) == 0).cast("int").alias("g"))
    return e.unpivot(["entity", "g"], ["rate", "cases_yr", "vent"], "variable", "value")


@query("i3_wilcoxon_by", f"""WITH {LONG_SQL},
r AS (SELECT variable, g, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2 AS r,
 count(*) OVER (PARTITION BY variable, value)::DOUBLE AS tie FROM l),
s AS (SELECT variable, sum(CASE WHEN g = 0 THEN r END) AS r0, sum(1 - g)::DOUBLE AS n0, sum(g)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(tie * tie - 1) AS ties FROM r GROUP BY variable),
w AS (SELECT *, r0 - n0 * (n0 + 1) / 2 AS w FROM s),
z AS (SELECT variable, w, (w - n0 * n1 / 2 - sign(w - n0 * n1 / 2) * 0.5) / nullif(sqrt(n0 * n1 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0) AS z FROM w)
SELECT variable, round(w, 6) AS w, round(z, 6) AS z, round({P_NORMAL}, 6) AS p_value FROM z""")
def _(t):
    return rounded(inf.wilcoxon_by(entity_long(t), "value", "g", "variable"), "w", "z", "p_value")


# Orders of n untied values with k in the first group, by the sum s of its ranks, counted rank by rank.
EXACT_SQL = """WITH RECURSIVE e AS (SELECT bedsize AS variable, entity, avg(risk)::DOUBLE AS value, max(highvolume) AS g FROM adm GROUP BY bedsize, entity),
t AS (SELECT variable, count(*) AS n, CAST(sum(1 - g) AS BIGINT) AS n0, count(DISTINCT value) = count(*) AS untied FROM e GROUP BY variable),
r AS (SELECT variable, CAST(sum(CASE WHEN g = 0 THEN rk END) AS BIGINT) AS r0 FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY value) AS rk FROM e) GROUP BY variable),
c AS (SELECT 0::BIGINT AS i, 0::BIGINT AS k, 0::BIGINT AS s, 1::DOUBLE AS ways
 UNION ALL SELECT c.i + 1, c.k + x.take, c.s + x.take * (c.i + 1), sum(c.ways) FROM c, (VALUES (0), (1)) x(take)
 WHERE c.i < (SELECT max(n) FROM t WHERE n0 < 50 AND n - n0 < 50) AND c.k + x.take < 50 GROUP BY ALL),
p AS (SELECT t.variable, sum(CASE WHEN c.s <= r0 THEN ways ELSE 0 END) / sum(ways) AS below, sum(CASE WHEN c.s >= r0 THEN ways ELSE 0 END) / sum(ways) AS above
 FROM t JOIN r USING (variable) JOIN c ON c.i = t.n AND c.k = t.n0 WHERE untied AND n0 > 0 AND n > n0 AND n0 < 50 AND n - n0 < 50 GROUP BY t.variable)
SELECT t.variable, round(least(1.0, 2 * least(below, above)), 8) AS p_exact, CASE WHEN below IS NULL THEN 'normal' ELSE 'exact' END AS method FROM t LEFT JOIN p USING (variable)"""


@query("i3_wilcoxon_exact", EXACT_SQL)
def _(t):
    """Groups of up to 49 untied entities each, for every bed size; larger ones keep the normal form."""
    e = t.adm("entity", "bedsize", "highvolume", "risk").groupBy(F.col("bedsize").alias("variable"), "entity").agg(
        F.avg("risk").alias("value"), F.max("highvolume").alias("g"))
    return rounded(inf.wilcoxon_exact_by(e, "value", "g", "variable").select("variable", "p_exact", "method"), "p_exact", digits=8)


@query("i4_kruskal", f"""WITH e AS (SELECT entity, max(bedsize) AS grp, avg(vent)::DOUBLE AS value FROM adm GROUP BY entity),
r AS (SELECT grp, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r, count(*) OVER (PARTITION BY value)::DOUBLE AS tie FROM e),
t AS (SELECT count(*)::DOUBLE AS n, sum(tie * tie - 1) AS ties FROM r), g AS (SELECT grp, sum(r) AS s, count(*)::DOUBLE AS k FROM r GROUP BY grp),
h AS (SELECT (12 / (n * (n + 1)) * (SELECT sum(s * s / k) FROM g) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS statistic, (SELECT count(*) - 1 FROM g)::DOUBLE AS df FROM t)
SELECT round(statistic, 6) AS statistic, CAST(df AS BIGINT) AS df, round({P_CHI}, 6) AS p_value FROM h""")
def _(t):
    e = t.adm("entity", "bedsize", "vent").groupBy("entity").agg(F.max("bedsize").alias("grp"), F.avg("vent").alias("value"))
    return rounded(inf.kruskal(e, "value", "grp"), "statistic", "p_value")


def h32(text, at=1):
    return f"('0x' || substr(md5({text}), {at}, 8))::BIGINT"


def mix_sql(src, expr, out):
    """The 31-bit scrambling as nested selects."""
    inner = f"SELECT *, ({expr})::BIGINT AS z FROM {src}"
    for shift, factor in zip(SHIFTS, MULTIPLIERS):
        inner = f"SELECT * REPLACE ((xor(z, z >> {shift}) * {factor}) & {MASK} AS z) FROM ({inner})"
    return f"(SELECT * EXCLUDE (z), xor(z, z >> {SHIFTS[-1]}) AS {out} FROM ({inner}))"


def draw_sql(src, seed, out, lane=0):
    """31 bits per row of src, which has a, b and rep."""
    base = f"({seed * SEED_STEP + 2 * lane} + rep * 16) & {MASK}"
    one = mix_sql(mix_sql(src, base, "r1"), f"(({base}) + 1) & {MASK}", "r2")
    last = mix_sql(mix_sql(one, "xor(a, r1)", "m"), "xor(xor(m, b), r2)", out)
    return f"(SELECT * EXCLUDE (r1, r2, m) FROM {last})"


def words_sql(key):
    return f"{h32(key)} & {MASK} AS a, {h32(key, 9)} & {MASK} AS b"


PERM_SQL = f"""e AS (SELECT entity, avg(outcome)::DOUBLE AS y, CASE WHEN sum(cohort) >= 12 THEN 1 ELSE 0 END AS g FROM adm GROUP BY entity),
x AS (SELECT entity, y, rep, {words_sql('entity::VARCHAR')} FROM e, range(1, 201) r(rep)),
p AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY h, entity) AS rn FROM {draw_sql('x', 7, 'h')}),
nul AS (SELECT rep, avg(CASE WHEN rn <= (SELECT sum(g) FROM e) THEN y END) - avg(CASE WHEN rn > (SELECT sum(g) FROM e) THEN y END) AS stat FROM p GROUP BY rep)"""


def perm_table(t):
    return t.adm("entity", "cohort", "outcome").groupBy("entity").agg(
        F.avg("outcome").alias("y"), (F.sum("cohort") >= 12).alias("g"))


@query("i5_permutation_null", f"WITH {PERM_SQL} SELECT CAST(rep AS INTEGER) AS rep, round(stat, 8) AS stat FROM nul")
def _(t):
    return rounded(inf.permutation_null(perm_table(t), "entity", "y", "g", 200, 7), "stat", digits=8)


@query("i5_permutation_test", f"""WITH {PERM_SQL}, o AS (SELECT avg(CASE WHEN g = 1 THEN y END) - avg(CASE WHEN g = 0 THEN y END) AS obs FROM e)
SELECT round(max(obs), 6) AS observed, CASE WHEN max(obs) IS NOT NULL THEN round(least(1.0, 2 * least(avg((stat >= obs)::INT), avg((stat <= obs)::INT))), 6) END AS p_value FROM nul, o""")
def _(t):
    return rounded(inf.permutation_test(perm_table(t), "entity", "y", "g", 200, 7), "observed", "p_value")


@query("i5_permutation_cases", f"""WITH e AS (SELECT case_id, cohort, outcome FROM adm),
x AS (SELECT case_id, outcome, rep, {words_sql('case_id')} FROM e, range(1, 11) r(rep)),
p AS (SELECT rep, outcome, row_number() OVER (PARTITION BY rep ORDER BY h, case_id) AS rn FROM {draw_sql('x', 11, 'h')}),
k AS (SELECT sum(cohort) AS n1 FROM e)
SELECT CAST(rep AS INTEGER) AS rep, round(avg(CASE WHEN rn <= n1 THEN outcome END) - avg(CASE WHEN rn > n1 THEN outcome END), 8) AS stat FROM p, k GROUP BY rep""")
def _(t):
    return rounded(inf.permutation_null(t.adm("case_id", "cohort", "outcome"), "case_id", "outcome", "cohort", 10, 11), "stat", digits=8)


BOOT_REPS = 20


def rr_from(rows, weight):
    return f"""SELECT rep, entity, CASE WHEN o0 > 0 AND e1 > 0 THEN (o1 / e1) / (o0 / e0) END AS rr FROM (SELECT rep, entity,
 sum(CASE WHEN cohort = 0 THEN outcome * {weight} END)::DOUBLE AS o0, sum(CASE WHEN cohort = 0 THEN risk * {weight} END) AS e0,
 sum(CASE WHEN cohort = 1 THEN outcome * {weight} END)::DOUBLE AS o1, sum(CASE WHEN cohort = 1 THEN risk * {weight} END) AS e1 FROM {rows} GROUP BY rep, entity)"""


# Risk in whole thousandths: its sums are exact in any order, and the unit cancels in the ratio.
ROWS_SQL = f"""rows AS MATERIALIZED (SELECT case_id, entity, cohort, outcome, round(risk * 1000) AS risk, {words_sql('case_id')},
 row_number() OVER (PARTITION BY cohort ORDER BY {h32('case_id')} % 4096, md5(case_id), case_id) - 1 AS idx FROM adm),
x AS (SELECT * FROM rows, range(1, {BOOT_REPS + 1}) r(rep))"""
U = f"(SELECT *, u31 / 2147483648.0::DOUBLE AS u FROM {draw_sql('x', 2940, 'u31')})"
BOOT_SQL = f"""{ROWS_SQL},
size AS MATERIALIZED (SELECT cohort, n, list_transform(range(0, 20), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-lam + i * ln(lam) - lgamma(i + 1))))) AS cdf
 FROM (SELECT cohort, count(*) AS n, 1 - 6 / sqrt(count(*)) AS lam FROM adm GROUP BY cohort)),
main AS MATERIALIZED (SELECT rep, entity, cohort, outcome, risk, w FROM (SELECT u.*, len(list_filter(cdf, lambda c: c <= u)) AS w FROM {U} u JOIN size USING (cohort)) WHERE w > 0),
slots AS (SELECT rep, cohort, n, (2 * slot + cohort) & {MASK} AS a, slot >> 30 AS b FROM
 (SELECT rep, cohort, n, unnest(range(1, CAST(n - t + 1 AS BIGINT))) AS slot FROM (SELECT rep, cohort, sum(w) AS t FROM main GROUP BY rep, cohort) JOIN size USING (cohort))),
picks AS (SELECT rep, cohort, (hi * 2147483648 + lo) % n AS idx FROM {draw_sql(draw_sql('slots', 2940, 'hi', 1), 2940, 'lo', 2)}),
extra AS (SELECT p.rep, i.entity, i.cohort, i.outcome, i.risk, 1 AS w FROM picks p JOIN rows i ON p.cohort = i.cohort AND p.idx = i.idx),
boot AS ({rr_from('(SELECT 0 AS rep, *, 1 AS w FROM rows)', 'w')} UNION ALL {rr_from('(SELECT * FROM main UNION ALL SELECT * FROM extra)', 'w')})"""


def boot(t, method="exact"):
    cases = t.adm("case_id", *CORE).withColumn("risk", F.round(F.col("risk") * 1000))
    return resample.bootstrap_rr(cases, reps=BOOT_REPS, method=method)


@query("i6_bootstrap_rr", f"WITH {BOOT_SQL} SELECT CAST(rep AS INTEGER) AS rep, entity, round(rr, 8) AS rr FROM boot")
def _(t):
    return rounded(boot(t), "rr", digits=8)


CDF = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in poisson_cdf(1.0))
POIS_SQL = f"""{ROWS_SQL}, w AS (SELECT *, {CDF} AS w FROM {U}),
boot AS ({rr_from('(SELECT 0 AS rep, *, 1 AS w FROM rows)', 'w')} UNION ALL {rr_from('(SELECT * FROM w WHERE w > 0)', 'w')})"""


@query("i6_bootstrap_poisson", f"WITH {POIS_SQL} SELECT CAST(rep AS INTEGER) AS rep, entity, round(rr, 8) AS rr FROM boot")
def _(t):
    return rounded(boot(t, "poisson"), "rr", digits=8)


@query("i7_bootstrap_summary", f"WITH {BOOT_SQL}, s AS ({SUMMARY_SQL} FROM boot GROUP BY entity), ex AS (SELECT entity, round(avg(CASE WHEN rr >= 2 THEN 1.0 WHEN rr < 2 THEN 0.0 END), 6) AS exceed FROM boot GROUP BY entity) SELECT s.*, exceed FROM s JOIN ex USING (entity)")
def _(t):
    reps = boot(t)
    out = a.summarize_replicates(reps).join(a.exceed_prob(reps, 2.0), "entity")
    return rounded(out, *[c for c in out.columns if c != "entity"])


SVY_VARS = ["age", "female", "comorb", "vent", "medicare", "medicaid", "private", "otherins"]


def svy_sql():
    parts = []
    for v in SVY_VARS:
        parts.append(f"""SELECT t.cohort, t.outcome, '{v}' AS variable, t.m_{v} AS mean, sqrt(v.se2) AS se FROM tot t JOIN (
 SELECT cohort, outcome, sum(CASE WHEN nh > 1 THEN nh / (nh - 1) * (q - s * s / nh) ELSE 0 END) AS se2 FROM (
 SELECT p.h, nh, t.cohort, t.outcome, sum((p.x_{v} - t.m_{v} * p.w) / t.w) AS s, sum(pow((p.x_{v} - t.m_{v} * p.w) / t.w, 2)) AS q
 FROM psu p JOIN tot t USING (cohort, outcome) JOIN nh ON nh.h = p.h GROUP BY p.h, nh, t.cohort, t.outcome) GROUP BY cohort, outcome) v USING (cohort, outcome)""")
    xs = ", ".join(f"sum(weight * {v})::DOUBLE AS x_{v}" for v in SVY_VARS)
    ms = ", ".join(f"sum(x_{v}) / sum(w) AS m_{v}" for v in SVY_VARS)
    return f"""b AS (SELECT *, 1 - male AS female FROM adm),
psu AS MATERIALIZED (SELECT stratum AS h, entity AS j, cohort, outcome, sum(weight)::DOUBLE AS w, {xs} FROM b WHERE comorb IS NOT NULL GROUP BY ALL),
tot AS MATERIALIZED (SELECT cohort, outcome, sum(w) AS w, {ms} FROM psu GROUP BY ALL),
nh AS MATERIALIZED (SELECT stratum AS h, count(DISTINCT entity)::DOUBLE AS nh FROM adm GROUP BY stratum),
svy AS ({' UNION ALL '.join(parts)})"""


def svy(t):
    base = [v for v in SVY_VARS if v != "female"]
    df = t.adm("entity", "stratum", "weight", "cohort", "outcome", "male", *base).withColumn("female", 1 - F.col("male"))
    return survey.svy_mean(df, survey.SurveyDesign("entity", "stratum", "weight"), SVY_VARS, ["cohort", "outcome"])


@query("i8_svy_mean", f"WITH {svy_sql()} SELECT cohort, outcome, variable, round(mean, 6) AS mean, round(se, 6) AS se FROM svy")
def _(t):
    return rounded(svy(t), "mean", "se")


# Row order and display names of the survey table.
SVY_ORDER = ["age", "female", "vent", "comorb", "medicare", "medicaid", "private", "otherins"]
SVY_LABELS = {"age": "Age", "female": "Female", "vent": "Ventilator", "comorb": "Comorbidity Score", "medicare": "Medicare",
              "medicaid": "Medicaid", "private": "Private Ins", "otherins": "Other Ins"}
GROUPS = [("case_alive", 1, 0), ("case_dead", 1, 1), ("control_alive", 0, 0), ("control_dead", 0, 1)]
PCT = ["female", "vent", "medicare", "medicaid", "private", "otherins"]
SVY_WHEN = lambda d: " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items())


@query("i9_svy_table", f"""WITH {svy_sql()}, x AS (SELECT variable, cohort, outcome, CASE WHEN variable IN ({', '.join(repr(v) for v in PCT)}) THEN 100.0 ELSE 1.0 END AS k, mean, se FROM svy),
y AS (SELECT variable, cohort, outcome, printf('%.2f (%.2f)', (mean * k)::DOUBLE, (se * k)::DOUBLE) AS text FROM x)
SELECT CASE variable {SVY_WHEN({k: f"'{v}'" for k, v in SVY_LABELS.items()})} END AS variable, CASE variable {SVY_WHEN({v: i for i, v in enumerate(SVY_ORDER, 1)})} END AS position,
{', '.join(f"max(CASE WHEN cohort = {c} AND outcome = {o} THEN text END) AS {g}" for g, c, o in GROUPS)} FROM y GROUP BY ALL""")
def _(t):
    grp = F.concat(if_else(F.col("cohort") == 1, "case", "control"), if_else(F.col("outcome") == 1, "_dead", "_alive"))
    return survey.svy_table(svy(t).withColumn("grp", grp), "grp", [g for g, _, _ in GROUPS], PCT, SVY_ORDER, SVY_LABELS)


# One draw per period: the log odds of each entity, and of the whole table as intercept.
DRAWS_SQL = """draws AS (SELECT period AS draw, entity::VARCHAR AS param, ln((sum(outcome) + 0.5::DOUBLE) / (count(*) - sum(outcome) + 0.5::DOUBLE)) AS value FROM adm GROUP BY ALL
 UNION ALL SELECT period, 'intercept', ln((sum(outcome) + 0.5::DOUBLE) / (count(*) - sum(outcome) + 0.5::DOUBLE)) FROM adm GROUP BY ALL)"""


def draws(t):
    odds = F.ln((F.sum("outcome") + 0.5) / (F.count(F.lit(1)) - F.sum("outcome") + 0.5)).alias("value")
    df = t.adm("entity", "period", "outcome")
    own = df.groupBy(F.col("period").alias("draw"), F.col("entity").cast("string").alias("param")).agg(odds)
    base = df.groupBy(F.col("period").alias("draw"), F.lit("intercept").alias("param")).agg(odds)
    return own.unionByName(base)


@query("i10_summarize_draws", f"""WITH {DRAWS_SQL} SELECT param, {', '.join(f'round(quantile_cont(1 / (1 + exp(-value)), {p}), 6) AS p{p * 100:g}' for p in dr.DRAW_PROBS)} FROM draws GROUP BY param""")
def _(t):
    out = dr.summarize_draws(draws(t))
    return rounded(out, *[c for c in out.columns if c != "param"])


@query("i11_shift_draws", f"WITH {DRAWS_SQL} SELECT d.draw, d.param, round(d.value + i.value, 6) AS value FROM draws d JOIN draws i ON d.draw = i.draw AND i.param = 'intercept' WHERE d.param <> 'intercept'")
def _(t):
    return rounded(dr.shift_draws(draws(t), "intercept"), "value")

"""J, R, O, W: joins, reshaping, ordering and whole-table comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import complete
from ..operators import join as j, order as o, ordered, reshape as r, summarize as a
from .registry import query

N = "CAST(count(*) AS BIGINT) AS n"
RATE = "round(avg(outcome), 6)"


def cohort_rates(t, k, name, *extra):
    return t.adm("entity", "cohort", "outcome", *extra).filter(F.col("cohort") == k).groupBy("entity").agg(
        F.round(F.avg("outcome"), 6).alias(name))



def big_entities(t, k=12):
    ones = t.adm("entity", "cohort").filter("cohort = 1")
    return ones.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)


@query("j1_join_inner", f"""SELECT entity, a.p1, b.p2 FROM (SELECT entity, {RATE} AS p1 FROM adm WHERE cohort = 1 GROUP BY entity) a
JOIN (SELECT entity, {RATE} AS p2 FROM adm WHERE cohort = 0 GROUP BY entity) b USING (entity)""")
def _(t):
    return j.join_inner(cohort_rates(t, 1, "p1"), cohort_rates(t, 0, "p2"), "entity")


@query("j2_join_left", f"""SELECT entity, p2, n FROM (SELECT entity, {RATE} AS p2 FROM adm WHERE cohort = 0 GROUP BY entity)
LEFT JOIN (SELECT entity, {N} FROM adm WHERE cohort = 1 GROUP BY entity HAVING count(*) >= 12) USING (entity)""")
def _(t):
    return j.join_left(cohort_rates(t, 0, "p2"), big_entities(t), "entity")


@query("j3_join_right", f"""SELECT s_suppkey AS entity, n, s_nationkey FROM (SELECT entity, {N} FROM adm WHERE cohort = 1 GROUP BY entity HAVING count(*) >= 12)
RIGHT JOIN supplier ON entity = s_suppkey""")
def _(t):
    profile = t.table("supplier").select(F.col("s_suppkey").alias("entity"), "s_nationkey")
    return j.join_right(big_entities(t), profile, "entity")


@query("j4_join_full", f"""SELECT entity, lo, hi FROM (SELECT entity, {N.replace(' AS n', ' AS lo')} FROM adm WHERE cohort = 1 GROUP BY entity HAVING count(*) <= 12)
FULL JOIN (SELECT entity, {N.replace(' AS n', ' AS hi')} FROM adm WHERE cohort = 1 GROUP BY entity HAVING count(*) >= 12) USING (entity)""")
def _(t):
    counts = t.adm("entity", "cohort").filter("cohort = 1").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    lo = counts.filter("n <= 12").withColumnRenamed("n", "lo")
    hi = counts.filter("n >= 12").withColumnRenamed("n", "hi")
    return j.join_full(lo, hi, "entity")


@query("j5_join_all", f"""SELECT entity, rate, case_rate, n_case FROM (SELECT entity, {RATE} AS rate FROM adm GROUP BY entity)
LEFT JOIN (SELECT entity, {RATE} AS case_rate FROM adm WHERE cohort = 1 GROUP BY entity) USING (entity)
LEFT JOIN (SELECT entity, CAST(sum(cohort) AS BIGINT) AS n_case FROM adm GROUP BY entity) USING (entity)""")
def _(t):
    df = t.adm("entity", "cohort", "outcome")
    tables = [a.rate_by(df, "entity", "outcome").withColumn("rate", F.round("rate", 6)),
              cohort_rates(t, 1, "case_rate"), a.sum_by(df, "entity", "cohort", "n_case")]
    return j.join_all(tables, "entity")


@query("j6_min_volume", f"""SELECT entity, {N}, CAST(sum(outcome) AS BIGINT) AS dead FROM adm WHERE cohort = 1
AND entity IN (SELECT entity FROM adm WHERE cohort = 1 GROUP BY entity HAVING count(*) >= 10) GROUP BY entity""")
def _(t):
    ones = t.adm("entity", "cohort", "outcome").filter("cohort = 1")
    return j.min_volume(ones, "entity", 10).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("dead"))


@query("j7_bind_cols", f"""SELECT entity, rate, n FROM (SELECT entity, {RATE} AS rate FROM adm GROUP BY entity)
FULL JOIN (SELECT entity, {N} FROM adm WHERE cohort = 0 GROUP BY entity) USING (entity)""")
def _(t):
    df = t.adm("entity", "cohort", "outcome")
    return j.bind_cols([a.rate_by(df, "entity", "outcome").withColumn("rate", F.round("rate", 6)),
                        a.count_by(df.filter("cohort = 0"), "entity")], "entity")


@query("j7_bind_cols_null_key", f"""SELECT a.ses, a.n0, b.n1 FROM (SELECT ses, count(*) AS n0 FROM adm WHERE cohort = 0 GROUP BY ses) a
JOIN (SELECT ses, count(*) AS n1 FROM adm WHERE cohort = 1 GROUP BY ses) b ON a.ses IS NOT DISTINCT FROM b.ses""")
def _(t):
    df = t.adm("ses", "cohort")
    parts = [a.count_by(df.filter(F.col("cohort") == k), "ses", name=f"n{k}") for k in (0, 1)]
    return j.join_inner(*parts, "ses", match_nulls=True)


@query("j8_cross", f"""SELECT e.entity, p.period, round(1 / (1 + exp(-(e.rate + p.mean))), 6) AS adj FROM
(SELECT entity, avg(outcome) AS rate FROM adm GROUP BY entity) e CROSS JOIN (SELECT period, avg(risk) AS mean FROM adm GROUP BY period) p""")
def _(t):
    e = a.rate_by(t.adm("entity", "outcome"), "entity", "outcome")
    p = t.adm("period", "risk").groupBy("period").agg(F.avg("risk").alias("mean"))
    return j.expand_by(e, p).select("entity", "period", F.round(1 / (1 + F.exp(-(F.col("rate") + F.col("mean")))), 6).alias("adj"))


@query("j9_attach_scores", "SELECT entity, CAST(count(*) AS BIGINT) AS n, round(sum(risk), 6) AS expect FROM adm WHERE ses IS NOT NULL AND comorb IS NOT NULL GROUP BY entity")
def _(t):
    df = t.adm("case_id", "entity")
    scored = complete(t.adm("case_id", "ses", "comorb", "risk")).select("case_id", "risk")
    return j.attach_scores(df, scored, "case_id").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("risk"), 6).alias("expect"))


@query("r1_bind_rows", f"SELECT CASE cohort WHEN 1 THEN 'Case' ELSE 'Control' END AS grp, entity, {N} FROM adm GROUP BY ALL")
def _(t):
    df = t.adm("entity", "cohort")
    both = r.bind_rows({"Case": df.filter("cohort = 1"), "Control": df.filter("cohort = 0")}, "grp")
    return both.groupBy("grp", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("r2_append", f"""SELECT entity, {N}, CAST(count(ses) AS BIGINT) AS with_ses FROM
(SELECT entity, ses FROM adm WHERE cohort = 1 UNION ALL SELECT entity, NULL FROM adm WHERE cohort = 0) GROUP BY entity""")
def _(t):
    df = t.adm("entity", "cohort", "ses")
    both = r.append(df.filter("cohort = 1").drop("cohort"), df.filter("cohort = 0").select("entity"))
    return both.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count("ses").alias("with_ses"))


LONG = " UNION ALL ".join(f"SELECT entity, '{c}' AS variable, avg({c})::DOUBLE AS value FROM adm GROUP BY entity" for c in ("vent", "f_cardiac", "age"))


@query("r3_to_long", f"SELECT entity, variable, round(value, 6) AS value FROM ({LONG})")
def _(t):
    cols = ["vent", "f_cardiac", "age"]
    wide = t.adm("entity", *cols).groupBy("entity").agg(*[F.avg(c).alias(c) for c in cols])
    return r.to_long(wide, ["entity"], cols).withColumn("value", F.round("value", 6))


@query("r4_to_wide", """SELECT entity, round(avg(CASE WHEN cohort = 0 THEN outcome END), 6) AS c0, round(avg(CASE WHEN cohort = 1 THEN outcome END), 6) AS c1
FROM adm GROUP BY entity""")
def _(t):
    long = t.adm("entity", "cohort", "outcome").groupBy("entity", F.concat(F.lit("c"), F.col("cohort")).alias("k")).agg(
        F.round(F.avg("outcome"), 6).alias("v"))
    return r.to_wide(long, ["entity"], "k", "v", ["c0", "c1"])


@query("r5_transpose", """SELECT 'age' AS variable, round(avg(CASE WHEN cohort = 0 THEN age END), 6) AS control, round(avg(CASE WHEN cohort = 1 THEN age END), 6) AS "case" FROM adm
UNION ALL SELECT 'vent', round(avg(CASE WHEN cohort = 0 THEN vent END), 6), round(avg(CASE WHEN cohort = 1 THEN vent END), 6) FROM adm""")
def _(t):
    g = t.adm("cohort", "age", "vent").groupBy(F.when(F.col("cohort") == 1, "case").otherwise("control").alias("grp")).agg(
        F.round(F.avg("age"), 6).alias("age"), F.round(F.avg("vent"), 6).alias("vent"))
    return r.transpose(g, "grp", ["control", "case"])


@query("r6_nest_by", "SELECT entity, CAST(count(*) AS BIGINT) AS n, round(sum(risk), 6) AS expect, CAST(sum(outcome) AS BIGINT) AS dead FROM adm GROUP BY entity")
def _(t):
    nested = r.nest_by(t.adm("case_id", "entity", "risk", "outcome"), "entity", chunk=1000)
    return r.unnest(nested).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("risk"), 6).alias("expect"), F.sum("outcome").alias("dead"))


@query("r7_apply_by", """SELECT CASE cohort WHEN 1 THEN 'case' ELSE 'control' END AS grp, bedsize, round(avg(age), 6) AS age FROM adm GROUP BY ALL""")
def _(t):
    df = t.adm("cohort", "bedsize", "age")
    return r.apply_by(df, {"case": 1, "control": 0}, "cohort",
                      lambda d: d.groupBy("bedsize").agg(F.round(F.avg("age"), 6).alias("age")), "grp")


ENT_RATE = "SELECT entity, avg(outcome) AS rate, CAST(sum(cohort) AS BIGINT) AS n_case FROM adm GROUP BY entity"


def entity_rates(t):
    return t.adm("entity", "cohort", "outcome").groupBy("entity").agg(F.avg("outcome").alias("rate"), F.sum("cohort").alias("n_case"))


@query("o1_sort_by", f"SELECT entity, round(rate, 6) AS rate FROM ({ENT_RATE}) ORDER BY rate DESC, entity DESC")
def _(t):
    return o.sort_by(entity_rates(t).select("entity", F.round("rate", 6).alias("rate")), "rate", "entity", descending=True)


@query("o2_top_k", f"SELECT entity, round(rate, 6) AS rate FROM ({ENT_RATE}) ORDER BY rate DESC, entity LIMIT 10")
def _(t):
    return o.top_k(entity_rates(t).drop("n_case"), "rate", 10, ["entity"]).select("entity", F.round("rate", 6).alias("rate"))


@query("o3_head_n", f"SELECT entity, round(rate, 6) AS rate FROM ({ENT_RATE}) ORDER BY entity LIMIT 45")
def _(t):
    return o.head_n(entity_rates(t).drop("n_case"), 45, "entity").select("entity", F.round("rate", 6).alias("rate"))


@query("o4_arrange_levels", f"""SELECT payer, CASE payer WHEN 'Private' THEN 1 WHEN 'Medicare' THEN 2 WHEN 'Medicaid' THEN 3 ELSE 4 END AS position, {N}
FROM adm GROUP BY payer""")
def _(t):
    return o.arrange_levels(a.count_by(t.adm("payer"), "payer"), "payer", ["Private", "Medicare", "Medicaid"])


@query("w1_flag_above_median", f"""SELECT entity, CASE WHEN rate > (SELECT quantile_cont(rate, 0.5) FROM ({ENT_RATE})) THEN 1 ELSE 0 END AS above,
CASE WHEN n_case >= (SELECT quantile_cont(n_case::DOUBLE, 0.5) FROM ({ENT_RATE})) THEN 1 ELSE 0 END AS busy FROM ({ENT_RATE})""")
def _(t):
    df = o.flag_above_median(entity_rates(t), "rate")
    df = o.flag_above_median(df, "n_case", "busy", inclusive=True)
    return df.select("entity", F.col("above").cast("int").alias("above"), F.col("busy").cast("int").alias("busy"))


@query("w2_rel_to_max", f"SELECT entity, round(rate / (SELECT max(rate) FROM ({ENT_RATE})), 6) AS rel FROM ({ENT_RATE})")
def _(t):
    return o.rel_to_max(entity_rates(t), "rate", "rel").select("entity", F.round("rel", 6).alias("rel"))


@query("w3_order_levels", f"SELECT entity, n_case, CAST(row_number() OVER (ORDER BY n_case, entity) AS BIGINT) AS position FROM ({ENT_RATE})")
def _(t):
    return o.order_levels(entity_rates(t).drop("rate"), "entity", "n_case").select("entity", "n_case", "position")


@query("w4_margin_share", """WITH c AS (SELECT region, bedsize, count(*)::DOUBLE AS n FROM adm GROUP BY ALL),
g AS (SELECT r.region, b.bedsize, coalesce(n, 0) AS n FROM (SELECT DISTINCT region FROM c) r CROSS JOIN (SELECT unnest([1, 2, 3]) AS bedsize) b
 LEFT JOIN c ON c.region = r.region AND c.bedsize = b.bedsize)
SELECT region, bedsize, round(n / sum(n) OVER (PARTITION BY region), 6) AS row_share, round(n / sum(n) OVER (PARTITION BY bedsize), 6) AS col_share FROM g""")
def _(t):
    df = t.adm("region", "bedsize")
    parts = [a.crosstab_pct(df, ["region"], "bedsize", [1, 2, 3], margin=m, digits=12).unpivot(
        ["variable", "value"], ["1", "2", "3"], "bedsize", m) for m in ("row", "col")]
    both = parts[0].join(parts[1], ["variable", "value", "bedsize"])
    return both.select(F.col("value").cast("int").alias("region"), F.col("bedsize").cast("int").alias("bedsize"),
                       F.round(F.col("row") / 100, 6).alias("row_share"), F.round(F.col("col") / 100, 6).alias("col_share"))


@query("w5_midranks", """SELECT age, CAST(n AS BIGINT) AS n_tied, (SELECT CAST(count(*) AS BIGINT) FROM adm) AS n_total,
(sum(n) OVER (ORDER BY age) - n + (n + 1) / 2.0)::DOUBLE AS midrank FROM (SELECT age, count(*) AS n FROM adm GROUP BY age)""")
def _(t):
    return ordered.midranks(t.adm("age"), "age")


@query("w5_midranks_by", """SELECT cohort, extendedprice, CAST(n AS BIGINT) AS n_tied, CAST(sum(n) OVER (PARTITION BY cohort) AS BIGINT) AS n_total,
(sum(n) OVER (PARTITION BY cohort ORDER BY extendedprice) - n + (n + 1) / 2.0)::DOUBLE AS midrank
FROM (SELECT CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS cohort, l_extendedprice AS extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)""")
def _(t):
    df = t.table("lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("cohort"), F.col("l_extendedprice").alias("extendedprice"))
    return ordered.midranks(df, "extendedprice", ["cohort"])


@query("w6_cumulative", """SELECT risk, CAST(sum(pos) OVER (ORDER BY risk DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY risk DESC) AS BIGINT) AS fp
FROM (SELECT risk, sum(outcome) AS pos, count(*) - sum(outcome) AS neg FROM adm GROUP BY risk)""")
def _(t):
    g = t.adm("risk", "outcome").groupBy("risk").agg(F.sum("outcome").alias("pos"), (F.count(F.lit(1)) - F.sum("outcome")).alias("neg"))
    run = ordered.running_sums(g, "risk", ["pos", "neg"], descending=True)
    return run.select("risk", (F.col("prev_pos") + F.col("pos")).alias("tp"), (F.col("prev_neg") + F.col("neg")).alias("fp"))

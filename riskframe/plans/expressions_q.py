"""P and T: projections, predicates, scalar and text expressions over the case view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions.nulls import if_else, in_set, null_inf, ratio
from ..operators import project as p, summarize
from ..sources.schema import FAILURES, PAYER_FLAGS, REGIONS
from .registry import query


def n():
    return F.count(F.lit(1)).alias("n")


N = "CAST(count(*) AS BIGINT) AS n"


@query("p1_lower_names", f"SELECT o_orderstatus, {N} FROM orders GROUP BY ALL")
def _(t):
    upper = p.map_names(t.table("orders"), str.upper)
    return p.lower_names(upper).groupBy("o_orderstatus").agg(n())


@query("p2_set_names", "SELECT entity AS ent, cohort AS grp, round(avg(outcome), 6) AS rate FROM adm GROUP BY ALL")
def _(t):
    df = p.set_names(t.adm("entity", "cohort", "outcome"), ["ent", "grp", "y"])
    return df.groupBy("ent", "grp").agg(F.round(F.avg("y"), 6).alias("rate"))


@query("p3_rename", f"SELECT entity AS hospital, {N} FROM adm WHERE cohort = 1 GROUP BY ALL")
def _(t):
    df = p.rename(t.adm("entity", "cohort"), {"entity": "hospital"})
    return df.filter("cohort = 1").groupBy("hospital").agg(n())


@query("p4_prefix_names", """SELECT entity, round(avg(vent), 6) AS control_vent, round(avg(f_cardiac), 6) AS control_f_cardiac
FROM adm WHERE cohort = 0 GROUP BY entity""")
def _(t):
    rates = summarize.indicator_rates(t.adm("entity", "cohort", "vent", "f_cardiac").filter("cohort = 0"),
                                      "entity", ["vent", "f_cardiac"])
    rates = p.across(rates, ["vent", "f_cardiac"], lambda c: F.round(c, 6))
    return p.prefix_names(rates, "control_", except_=["entity"])


@query("p5_cohort_view", """SELECT entity, round(avg(vent), 6) AS vent, round(avg(f_renal), 6) AS f_renal
FROM adm WHERE cohort = 1 GROUP BY entity""")
def _(t):
    df = t.adm("entity", "cohort", "vent", "f_renal")
    wide = df.groupBy("entity").agg(*[F.round(F.avg(F.when(F.col("cohort") == k, F.col(c))), 6).alias(f"{g}_{c}")
                                      for k, g in ((1, "case"), (0, "control")) for c in ("vent", "f_renal")])
    return p.cohort_view(wide, "case_", ["entity"]).filter("vent IS NOT NULL")


@query("p6_map_names", "SELECT round(avg(f_cardiac), 6) AS \"f.cardiac\", round(avg(f_neuro), 6) AS \"f.neuro\" FROM adm")
def _(t):
    df = t.adm("f_cardiac", "f_neuro").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("f_cardiac", "f_neuro")])
    return p.map_names(df, lambda c: c.replace("_", ".", 1))


@query("p7_select_cols", f"SELECT f_cardiac, f_neuro, f_heme, medicare, medicaid, private, otherins, {N} FROM adm GROUP BY ALL")
def _(t):
    cols = t.adm("case_id", *FAILURES, *PAYER_FLAGS)
    picked = p.select_cols(cols, p.Cols(starts="f_"), p.Cols(first="medicare", last="private"), p.Cols(contains="ins"),
                           drop=[p.Cols(ends="liver"), "f_renal"])
    return picked.groupBy(*picked.columns).agg(n())


@query("p8_pull", f"SELECT age, {N} FROM adm GROUP BY age")
def _(t):
    return p.pull(t.adm("age", "entity"), "age").groupBy("age").agg(n())


@query("p9_split_cohort", "SELECT cohort, CAST(count(*) AS BIGINT) AS n, CAST(sum(outcome) AS BIGINT) AS dead FROM adm GROUP BY cohort")
def _(t):
    ones, zeros = p.split_cohort(t.adm("cohort", "outcome"), "cohort")
    one = [d.groupBy("cohort").agg(n(), F.sum("outcome").alias("dead")) for d in (ones, zeros)]
    return one[0].unionByName(one[1])


@query("p10_predicates", f"""SELECT entity, {N} FROM adm
WHERE (age >= 30 AND age < 60 AND vent = 1) OR comorb > 15 GROUP BY entity""")
def _(t):
    c = F.col
    keep = ((c("age") >= 30) & (c("age") < 60) & (c("vent") == 1)) | (c("comorb") > 15)
    return t.adm("entity", "age", "vent", "comorb").filter(keep).groupBy("entity").agg(n())


@query("p11_flag_in", f"""WITH bad AS (SELECT entity FROM adm GROUP BY entity HAVING avg(outcome) > 0.17)
SELECT CASE WHEN entity IN (SELECT entity FROM bad) THEN 1 ELSE 0 END AS flagged,
       CASE WHEN ses IS NOT NULL AND ses IN (1, 4) THEN 1 ELSE 0 END AS edge_ses, {N} FROM adm GROUP BY ALL""")
def _(t):
    df = t.adm("entity", "outcome", "ses")
    bad = summarize.rate_by(df, "entity", "outcome").filter("rate > 0.17").select("entity")
    out = p.flag_in(df, "entity", bad, "bad")
    return out.groupBy(F.col("bad").cast("int").alias("flagged"), in_set("ses", [1, 4]).cast("int").alias("edge_ses")).agg(n())


@query("p12_complete_cases", f"SELECT cohort, {N} FROM adm WHERE ses IS NOT NULL AND comorb IS NOT NULL GROUP BY cohort")
def _(t):
    return p.complete_cases(t.adm("cohort", "ses", "comorb", "age")).groupBy("cohort").agg(n())


@query("p13_regex_filter", f"SELECT p_type, {N} FROM part WHERE NOT regexp_matches(p_type, 'STEEL|^PROMO') GROUP BY p_type")
def _(t):
    return t.table("part").filter(~F.col("p_type").rlike("STEEL|^PROMO")).groupBy("p_type").agg(n())


@query("p14_if_else", f"""SELECT CASE WHEN ses IS NULL THEN NULL WHEN ses >= 3 THEN 'high' ELSE 'low' END AS ses_class, {N}
FROM adm GROUP BY ALL""")
def _(t):
    return t.adm("ses").groupBy(if_else(F.col("ses") >= 3, F.lit("high"), F.lit("low")).alias("ses_class")).agg(n())


@query("p15_case_when", f"SELECT payer, {N} FROM adm GROUP BY payer")
def _(t):
    return t.adm("payer").groupBy("payer").agg(n())


@query("p16_recode", f"""SELECT CASE region WHEN 1 THEN 'Northeast' WHEN 2 THEN 'Midwest' WHEN 3 THEN 'South' WHEN 4 THEN 'West' END AS region,
CASE WHEN ses = 1 THEN 'lowest' ELSE ses::VARCHAR END AS ses, {N} FROM adm GROUP BY ALL""")
def _(t):
    df = t.adm("region", "ses").select(
        s.recode("region", dict(enumerate(REGIONS, 1))).alias("region"),
        s.recode(F.col("ses").cast("string"), {"1": "lowest"}, keep_other=True).alias("ses"))
    return df.groupBy("region", "ses").agg(n())


@query("p16_recode_from", f"SELECT n_name AS place, {N} FROM adm JOIN nation ON stratum = n_nationkey GROUP BY n_name")
def _(t):
    names = t.table("nation").select(F.col("n_nationkey").cast("string"), "n_name")
    df = t.adm("stratum").select(F.col("stratum").cast("string").alias("place"))
    return p.recode_from(df, "place", names).groupBy("place").agg(n())


@query("p17_across", f"SELECT vent::VARCHAR AS vent, f_cardiac::VARCHAR AS f_cardiac, male::VARCHAR AS male, {N} FROM adm GROUP BY ALL")
def _(t):
    cols = ["vent", "f_cardiac", "male"]
    return p.across(t.adm(*cols), cols, lambda c: c.cast("string")).groupBy(*cols).agg(n())


@query("p18_as_levels", f"""SELECT CASE WHEN race >= 4 THEN 'other' ELSE race::VARCHAR END AS race,
CASE teach WHEN 1 THEN 'Rural' WHEN 2 THEN 'Urban non-teaching' WHEN 3 THEN 'Urban teaching' END AS teach, teach AS teach_pos, {N} FROM adm GROUP BY ALL""")
def _(t):
    lv = p.Levels((1, 2, 3), ("Rural", "Urban non-teaching", "Urban teaching"))
    df = p.as_levels(t.adm("race", "teach"), "teach", lv).withColumn("race", p.collapse_levels("race", 4))
    return df.withColumn("teach_pos", lv.position("teach")).groupBy("race", "teach", "teach_pos").agg(n())


@query("p19_cast", f"SELECT (entity::VARCHAR)::INTEGER AS id, try_cast(payer AS INTEGER) AS bad, {N} FROM adm GROUP BY ALL")
def _(t):
    df = t.adm("entity", "payer").select(F.col("entity").cast("string").cast("int").alias("id"),
                                         F.col("payer").try_cast("int").alias("bad"))
    return df.groupBy("id", "bad").agg(n())


@query("p20_center", f"""SELECT period, round(period - (SELECT avg(period) FROM adm), 6) AS period_scaled, {N} FROM adm GROUP BY period""")
def _(t):
    df = p.center(t.adm("period"), "period")
    return df.groupBy("period", F.round("period_scaled", 6).alias("period_scaled")).agg(n())


@query("p21_from_dummies", f"""SELECT CASE region WHEN 1 THEN 'Northeast' WHEN 2 THEN 'Midwest' WHEN 3 THEN 'South' WHEN 4 THEN 'West' END AS region, {N}
FROM adm GROUP BY ALL""")
def _(t):
    flags = ["northeast", "midwest", "south", "west"]
    df = t.adm("region").select(*[(F.col("region") == i).cast("int").alias(f) for i, f in enumerate(flags, 1)])
    return df.groupBy(s.from_dummies(flags, REGIONS).alias("region")).agg(n())


@query("p22_derived", """SELECT entity, CAST(n - dead AS BIGINT) AS alive, round(n1 / n, 6) AS prop, round((r1 - r0) / r0, 6) AS excess
FROM (SELECT entity, count(*)::DOUBLE AS n, sum(outcome) AS dead, sum(cohort) AS n1,
      avg(CASE WHEN cohort = 1 THEN outcome END) AS r1, avg(CASE WHEN cohort = 0 THEN outcome END) AS r0 FROM adm GROUP BY entity)""")
def _(t):
    y = F.col("outcome").cast("double")
    g = t.adm("entity", "cohort", "outcome").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("dead"), F.sum("cohort").alias("n1"),
        F.avg(F.when(F.col("cohort") == 1, y)).alias("r1"), F.avg(F.when(F.col("cohort") == 0, y)).alias("r0"))
    return g.select("entity", (F.col("n") - F.col("dead")).alias("alive"), F.round(ratio("n1", "n"), 6).alias("prop"),
                    F.round(ratio(F.col("r1") - F.col("r0"), "r0"), 6).alias("excess"))


@query("p23_cut_bins", f"""SELECT CAST(CASE WHEN risk >= 0 AND risk <= 0.1::DOUBLE THEN 1 WHEN risk > 0.1::DOUBLE AND risk <= 0.2::DOUBLE THEN 2
 WHEN risk > 0.2::DOUBLE AND risk <= 0.3::DOUBLE THEN 3 END AS BIGINT) AS bin, {N} FROM adm GROUP BY ALL""")
def _(t):
    return t.adm("risk").groupBy(s.cut_bins("risk", [0.0, 0.1, 0.2, 0.3]).cast("bigint").alias("bin")).agg(n())


Q20 = ", ".join(f"{i}/20::DOUBLE" for i in range(21))


@query("p24_cut_quantiles", f"""WITH b AS (SELECT unnest(list_sort(list_distinct(quantile_cont(comorb::DOUBLE, [{Q20}])))) AS lo FROM adm),
e AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi, row_number() OVER (ORDER BY lo) AS bin, count(*) OVER () AS k FROM b)
SELECT CAST(e.bin AS BIGINT) AS bin, {N}, min(comorb) AS lowest FROM adm LEFT JOIN e
 ON hi IS NOT NULL AND comorb >= lo AND (comorb < hi OR (comorb = hi AND e.bin = k - 1)) GROUP BY e.bin""")
def _(t):
    df = p.cut_quantiles(t.adm("comorb"), "comorb", [i / 20 for i in range(21)])
    return df.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(n(), F.min("comorb").alias("lowest"))


@query("p25_round_half_even", f"SELECT round_even(age / 2, 0) AS half, round_even(100 * avg(outcome), 2) AS pct, {N} FROM adm GROUP BY 1")
def _(t):
    return t.adm("age", "outcome").groupBy(s.round_half_even(F.col("age") / 2).alias("half")).agg(
        s.percent(F.avg("outcome")).alias("pct"), n())


@query("p26_null_inf", """SELECT entity, CASE WHEN r0 > 0 THEN round(r1 / r0, 6) END AS rr FROM (
SELECT entity, avg(CASE WHEN cohort = 1 THEN outcome END) AS r1, avg(CASE WHEN cohort = 0 AND f_renal = 1 AND f_liver = 1 THEN outcome END) AS r0
FROM adm GROUP BY entity)""")
def _(t):
    y = F.col("outcome").cast("double")
    g = t.adm("entity", "cohort", "outcome", "f_renal", "f_liver").groupBy("entity").agg(
        F.avg(F.when(F.col("cohort") == 1, y)).alias("r1"),
        F.avg(F.when((F.col("cohort") == 0) & (F.col("f_renal") == 1) & (F.col("f_liver") == 1), y)).alias("r0"))
    infinite = F.when(F.col("r0") == 0, F.when(F.col("r1") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    g = g.withColumn("rr", F.coalesce(infinite, ratio("r1", "r0")))
    return null_inf(g, ["rr"]).select("entity", F.round("rr", 6).alias("rr"))


@query("p27_expit_logit", """SELECT risk, round(ln(risk / (1 - risk)), 6) AS lp, round(1 / (1 + exp(-risk)), 6) AS p, CAST(count(*) AS BIGINT) AS n
FROM (SELECT round(risk, 4) AS risk FROM adm) GROUP BY risk""")
def _(t):
    g = t.adm("risk").groupBy(F.round("risk", 4).alias("risk")).agg(n())
    return g.select("risk", F.round(s.logit("risk"), 6).alias("lp"), F.round(s.expit("risk"), 6).alias("p"), "n")


@query("p28_log_ratio", """SELECT entity, CASE WHEN o > 0 THEN round(ln(o / e), 6) END AS log_oe
FROM (SELECT entity, sum(outcome) AS o, sum(risk) AS e FROM adm WHERE cohort = 1 GROUP BY entity)""")
def _(t):
    g = t.adm("entity", "cohort", "outcome", "risk").filter("cohort = 1").groupBy("entity").agg(
        F.sum("outcome").alias("o"), F.sum("risk").alias("e"))
    return g.select("entity", F.round(s.log_ratio("o", "e"), 6).alias("log_oe"))


@query("p29_metric_view", """SELECT round(avg(vent), 6) AS x, round(avg(outcome), 6) AS y, CAST(count(*) AS BIGINT) AS size, max(bedsize) AS grp
FROM adm GROUP BY entity""")
def _(t):
    g = t.adm("entity", "vent", "outcome", "bedsize").groupBy("entity").agg(
        F.round(F.avg("vent"), 6).alias("vent_rate"), F.round(F.avg("outcome"), 6).alias("rate"), n(), F.max("bedsize").alias("bedsize"))
    return p.metric_view(g, "vent_rate", "rate", "n", "bedsize")


@query("p30_with_labels", "SELECT 'On ventilator' AS label, round(avg(vent), 6) AS share FROM adm UNION ALL SELECT 'Gender', round(avg(male), 6) FROM adm")
def _(t):
    df = p.with_labels(t.adm("vent", "male"), {"vent": "On ventilator", "male": "Gender"})
    names = p.labels_of(df)
    wide = df.agg(*[F.avg(c).alias(c) for c in df.columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(names[c]).alias("label"), F.round(c, 6).alias("share"))
                                          for c in df.columns])))


@query("t1_replace_first", f"SELECT regexp_replace(p_type, 'E', 'e') AS kind, {N} FROM part GROUP BY ALL")
def _(t):
    return t.table("part").groupBy(s.replace_first("p_type", "E", "e").alias("kind")).agg(n())


@query("t2_remove", f"SELECT regexp_replace(p_type, ' [A-Z]+', '') AS kind, {N} FROM part GROUP BY ALL")
def _(t):
    return t.table("part").groupBy(s.remove("p_type", " [A-Z]+").alias("kind")).agg(n())


@query("t3_title_case", f"""SELECT array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS kind, {N}
FROM part GROUP BY ALL""")
def _(t):
    return t.table("part").groupBy(s.title_case("p_type").alias("kind")).agg(n())


@query("t4_unite", f"SELECT coalesce(payer, 'NA') || ' / ' || coalesce(ses::VARCHAR, 'NA') AS cats, {N} FROM adm GROUP BY ALL")
def _(t):
    return p.unite(t.adm("payer", "ses"), "cats", ["payer", "ses"], " / ").groupBy("cats").agg(n())


@query("t5_separate", f"SELECT split_part(o_orderpriority, '-', 1) AS code, split_part(o_orderpriority, '-', 2) AS text, {N} FROM orders GROUP BY ALL")
def _(t):
    df = p.separate(t.table("orders").select("o_orderpriority"), "o_orderpriority", ["code", "text"], "-")
    return df.groupBy("code", "text").agg(n())


@query("t6_formats", """SELECT cohort, printf('%.2f (%.2f)', avg(age), stddev_samp(age)) AS age, printf('%.2f%%', round_even(100 * avg(vent), 2)) AS vent,
format('{:,}', count(*)) AS n FROM adm GROUP BY cohort""")
def _(t):
    g = t.adm("cohort", "age", "vent").groupBy("cohort").agg(F.avg("age").alias("m"), F.stddev_samp("age").alias("sd"),
                                                             F.avg("vent").alias("v"), n())
    return g.select("cohort", s.fmt_mean_sd("m", "sd").alias("age"), s.fmt_pct("v").alias("vent"), s.fmt_int("n").alias("n"))

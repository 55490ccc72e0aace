"""E: model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as e
from .registry import query
from .summaries_q import rounded

TENTHS = [i / 10 for i in range(11)]
CUTS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.65]


def bin_sql(breaks, col="risk"):
    arms = [f"WHEN {col} {'>=' if i == 0 else '>'} {lo}::DOUBLE AND {col} <= {hi}::DOUBLE THEN {i + 1}" for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]))]
    return f"CAST(CASE {' '.join(arms)} END AS BIGINT)"


def label_sql(breaks):
    arms = [f"WHEN {i + 1} THEN '{'[' if i == 0 else '('}{lo:g},{hi:g}]'" for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]))]
    return f"CASE bin {' '.join(arms)} END"


@query("e1_calibration", f"""SELECT bin, {label_sql(TENTHS)} AS label, round(avg(outcome), 6) AS obs_rate, round(avg(risk), 6) AS mean_pred
FROM (SELECT {bin_sql(TENTHS)} AS bin, outcome, risk FROM adm) GROUP BY bin""")
def _(t):
    return rounded(e.calibration(t.adm("risk", "outcome"), "risk", "outcome", TENTHS), "obs_rate", "mean_pred")


MID = "CASE bin " + " ".join(f"WHEN {i + 1} THEN round({(a + b) / 2!r}, 6)" for i, (a, b) in enumerate(zip(CUTS, CUTS[1:]))) + " END::DOUBLE"


@query("e2_calibration_se", f"""SELECT bin, {label_sql(CUTS)} AS label, n, round(m, 6) AS obs_rate, round(p, 6) AS mean_pred, round(sqrt(m * (1 - m) / n), 6) AS se,
round(m - 2 * sqrt(m * (1 - m) / n), 6) AS ymin, round(m + 2 * sqrt(m * (1 - m) / n), 6) AS ymax, {MID} AS mid
FROM (SELECT bin, CAST(count(*) AS BIGINT) AS n, avg(outcome) AS m, avg(risk) AS p FROM (SELECT {bin_sql(CUTS)} AS bin, outcome, risk FROM adm WHERE cohort = 1) GROUP BY bin)""")
def _(t):
    out = e.calibration(t.adm("cohort", "risk", "outcome").filter("cohort = 1"), "risk", "outcome", CUTS, se=True)
    return rounded(out, "obs_rate", "mean_pred", "se", "ymin", "ymax", "mid")


@query("e3_calibration_curve", """SELECT CAST(least(floor(risk * 20), 19) AS BIGINT) AS bin, round(avg(outcome), 6) AS frac_pos, round(avg(risk), 6) AS mean_pred FROM adm GROUP BY ALL""")
def _(t):
    return rounded(e.calibration_curve(t.adm("risk", "outcome"), "risk", "outcome"), "frac_pos", "mean_pred")


# Exact limits by bisection of the summed binomial tail.
@query("e4_calibration_ci", f"""WITH RECURSIVE b AS (SELECT bin, count(*) AS n, sum(outcome) AS x FROM (SELECT {bin_sql(TENTHS)} AS bin, outcome FROM adm) WHERE bin IS NOT NULL GROUP BY bin),
s AS (SELECT bin, n, x, 0.0::DOUBLE AS ll, 1.0::DOUBLE AS lh, 0.0::DOUBLE AS ul, 1.0::DOUBLE AS uh, 0 AS i FROM b
 UNION ALL SELECT bin, n, x, CASE WHEN tl < 0.025 THEN (ll + lh) / 2 ELSE ll END, CASE WHEN tl < 0.025 THEN lh ELSE (ll + lh) / 2 END,
  CASE WHEN tu > 0.025 THEN (ul + uh) / 2 ELSE ul END, CASE WHEN tu > 0.025 THEN uh ELSE (ul + uh) / 2 END, i + 1
 FROM (SELECT *, list_sum(list_transform(range(CAST(x AS BIGINT), CAST(n AS BIGINT) + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((ll + lh) / 2) + (n - k) * ln(1 - (ll + lh) / 2)))) AS tl,
   list_sum(list_transform(range(0, CAST(x AS BIGINT) + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((ul + uh) / 2) + (n - k) * ln(1 - (ul + uh) / 2)))) AS tu FROM s WHERE i < 45))
SELECT bin, CAST(n AS BIGINT) AS n, CAST(x AS BIGINT) AS events, round(100 * x / n, 6) AS pct, round(50 * (ll + lh), 6) AS lower, round(50 * (ul + uh), 6) AS upper FROM s WHERE i = 45""")
def _(t):
    return rounded(e.calibration_ci(t.adm("risk", "outcome"), "risk", "outcome"), "pct", "lower", "upper")


ROC = """SELECT risk AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr
FROM (SELECT risk, sum(outcome)::DOUBLE AS pos, sum(1 - outcome)::DOUBLE AS neg FROM adm GROUP BY risk) WINDOW w AS (ORDER BY risk DESC)"""


@query("e5_roc_curve", ROC)
def _(t):
    return rounded(e.roc_curve(t.adm("risk", "outcome"), "risk", "outcome"), "tpr", "fpr")


@query("e6_auc", """SELECT round((sum(CASE WHEN outcome = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM
(SELECT outcome, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2 AS r, sum(outcome) OVER ()::DOUBLE AS n1, sum(1 - outcome) OVER ()::DOUBLE AS n0 FROM adm) GROUP BY n1, n0""")
def _(t):
    return rounded(e.auc(t.adm("risk", "outcome"), "risk", "outcome"), "auc")


@query("e6_auc_labels", """SELECT round((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM
(SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r, sum(y) OVER ()::DOUBLE AS n1, sum(1 - y) OVER ()::DOUBLE AS n0
 FROM (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id))) GROUP BY n1, n0""")
def _(t):
    df = t.table("labels").join(t.table("documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(e.auc(df, "n_chars", "quality"), "auc")


@query("e7_brier", "SELECT round(avg(pow(outcome - risk, 2)), 6) AS brier FROM adm")
def _(t):
    return rounded(e.brier(t.adm("risk", "outcome"), "risk", "outcome"), "brier")


Q20 = ", ".join(f"{i}/20::DOUBLE" for i in range(21))


@query("e8_quantile_profile", f"""WITH c AS (SELECT * FROM adm WHERE cohort = 0),
b AS (SELECT unnest(list_sort(list_distinct(quantile_cont(comorb, [{Q20}])))) AS lo FROM c),
k AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi, row_number() OVER (ORDER BY lo) AS bin, count(*) OVER () AS m FROM b)
SELECT CAST(k.bin AS BIGINT) AS bin, round(avg(outcome), 6) AS p, round(avg(comorb), 6) AS x FROM c LEFT JOIN k
 ON hi IS NOT NULL AND comorb >= lo AND (comorb < hi OR (comorb = hi AND k.bin = m - 1)) GROUP BY k.bin""")
def _(t):
    return rounded(e.quantile_profile(t.adm("cohort", "comorb", "outcome").filter("cohort = 0"), "comorb", "outcome"), "p", "x")

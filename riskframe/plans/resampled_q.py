"""I5-I7 at full size: draws over cells and values, checked by the moments that they must have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import inference as inf, resample, summarize as a
from .inference_q import CORE
from .registry import query
from .summaries_q import rounded

REPS = 1000


def cells(t):
    """Risk in whole thousandths, as in the other bootstrap queries."""
    return t.adm(*CORE).withColumn("risk", F.round(F.col("risk") * 1000))


@query("i6_bootstrap_cells", """SELECT entity, cohort, CAST(count(*) AS BIGINT) AS n, CAST(sum(outcome) AS BIGINT) AS outcome,
 true AS n_centred, true AS n_spread, true AS outcome_centred, true AS outcome_spread FROM adm GROUP BY entity, cohort""")
def _(t):
    """A sum that is s in the data is binomial(N, s / N) over the replicates: mean and variance within 8 standard errors."""
    sums = resample.bootstrap_sums(cells(t), reps=REPS)
    size = sums.where("rep = 0").groupBy("cohort").agg(F.sum("w").alias("size"))
    checked = [("w", "n"), ("outcome", "outcome")]
    drawn = F.col("rep") > 0
    per = sums.groupBy("entity", "cohort").agg(
        *[F.max(F.when(F.col("rep") == 0, F.col(c))).alias(n) for c, n in checked],
        *[F.sum(F.when(drawn, F.col(c).cast("double"))).alias(f"{n}_1") for c, n in checked],
        *[F.sum(F.when(drawn, F.col(c).cast("double") * F.col(c))).alias(f"{n}_2") for c, n in checked])
    per = per.join(size, "cohort")
    for _, n in checked:
        s = F.col(n).cast("double")
        first, second = F.coalesce(f"{n}_1", F.lit(0.0)), F.coalesce(f"{n}_2", F.lit(0.0))
        var = s * (1 - s / F.col("size"))
        found = second / REPS - 2 * s * first / REPS + s * s
        per = per.withColumns({f"{n}_centred": F.abs(first / REPS - s) <= 8 * F.sqrt(var / REPS),
                               f"{n}_spread": F.abs(found - var) <= 8 * F.sqrt((2 * var * var + var) / REPS)})
    return per.select("entity", "cohort", F.col("n").cast("long").alias("n"), F.col("outcome").cast("long").alias("outcome"),
                      *[f"{n}_{k}" for _, n in checked for k in ("centred", "spread")])


@query("i6_bootstrap_totals", f"SELECT cohort, {REPS + 1}::BIGINT AS reps, CAST(count(*) AS BIGINT) AS least, CAST(count(*) AS BIGINT) AS most FROM adm GROUP BY cohort")
def _(t):
    """Every replicate has exactly the cases of each cohort."""
    totals = resample.bootstrap_sums(cells(t), reps=REPS).groupBy("rep", "cohort").agg(F.sum("w").alias("w"))
    return totals.groupBy("cohort").agg(F.count(F.lit(1)).alias("reps"), F.min("w").alias("least"), F.max("w").alias("most"))


@query("i7_bootstrap_cells", """WITH r AS (SELECT entity, sum(CASE WHEN cohort = 0 THEN outcome END)::DOUBLE AS o0, sum(CASE WHEN cohort = 0 THEN risk END) AS e0,
 sum(CASE WHEN cohort = 1 THEN outcome END)::DOUBLE AS o1, sum(CASE WHEN cohort = 1 THEN risk END) AS e1 FROM adm GROUP BY entity)
SELECT entity, CASE WHEN o0 > 0 AND e1 > 0 THEN round((o1 / e1) / (o0 / e0), 6) END AS rr, true AS ordered, true AS shares FROM r""")
def _(t):
    """Quantiles of 1,000 replicates in order around each other, exceedance a share that falls with the threshold."""
    reps = cut(resample.bootstrap_rr(cells(t), reps=REPS))
    drawn = reps.where("rep > 0")
    out = (reps.where("rep = 0").select("entity", "rr").join(a.summarize_replicates(drawn), "entity", "left")
           .join(a.exceed_prob(drawn, 2.0), "entity", "left").join(a.exceed_prob(drawn, 1.0, name="exceed_1"), "entity", "left"))
    steps = ["min", "lcb", "q1", "median", "q3", "ucb", "max"]
    ordered = F.lit(True)
    for x, y in zip(steps, steps[1:]):
        ordered = ordered & F.coalesce(F.col(x) <= F.col(y), F.lit(True))
    shares = F.coalesce((F.col("exceed") >= 0) & (F.col("exceed") <= F.col("exceed_1")) & (F.col("exceed_1") <= 1), F.lit(True))
    return rounded(out.select("entity", "rr", ordered.alias("ordered"), shares.alias("shares")), "rr")


def moments_sql(rows):
    """Observed difference, and its standard deviation over all relabellings of the rows (y, g)."""
    return f"""WITH {rows}, s AS (SELECT count(*)::DOUBLE AS n, sum(g)::DOUBLE AS n1, var_samp(y) AS v,
 avg(CASE WHEN g = 1 THEN y END) - avg(CASE WHEN g = 0 THEN y END) AS observed FROM d)
SELECT round(observed, 8) AS observed, round(sqrt(v * (1 / n1 + 1 / (n - n1))), 8) AS null_sd, 5000::BIGINT AS reps,
 true AS centred, true AS spread FROM s"""


def moments(df):
    g = F.col("g").cast("boolean")
    stats = inf.permutation_by_values(df, "y", "g")
    sd = df.agg(F.sqrt(F.var_samp(F.col("y").cast("double")) * (1 / F.sum(g.cast("int")) + 1 / F.sum((~g).cast("int")))).alias("null_sd"))
    drawn = F.when(F.col("rep") > 0, F.col("stat"))
    out = stats.agg(F.max(F.when(F.col("rep") == 0, F.col("stat"))).alias("observed"), F.count(drawn).alias("reps"),
                    F.avg(drawn).alias("m"), F.stddev_samp(drawn).alias("s")).withColumn("k", F.lit(1)).join(sd.withColumn("k", F.lit(1)), "k")
    return rounded(out.select("observed", "null_sd", "reps", (F.abs("m") <= 6 * F.col("null_sd") / F.sqrt("reps")).alias("centred"),
                              (F.abs(F.col("s") / F.col("null_sd") - 1) <= 0.08).alias("spread")), "observed", "null_sd", digits=8)


@query("i5_permutation_values", moments_sql("d AS (SELECT avg(outcome)::DOUBLE AS y, max(highvolume) AS g FROM adm GROUP BY entity)"))
def _(t):
    return moments(t.adm("entity", "outcome", "highvolume").groupBy("entity").agg(F.avg("outcome").alias("y"), F.max("highvolume").alias("g")))


@query("i5_permutation_case_values", moments_sql("d AS (SELECT outcome::DOUBLE AS y, cohort AS g FROM adm)"))
def _(t):
    return moments(t.adm("cohort", "outcome").select(F.col("outcome").alias("y"), F.col("cohort").alias("g")))

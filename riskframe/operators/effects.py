"""Logistic models with entity effects, fitted by Newton steps over grouped sums.

Cases are first counted per (entity, covariate cell). One step joins the current effects to the
cells, sums gradient and curvature per entity (map-side partial sums, so a large entity is no
bottleneck), and eliminates the entity effects: only a small system for the shared coefficients
reaches the driver. The entity table is checkpointed after each step.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import complete
from ..functions.scalar import expit, logit
from ..lineage import cut
from .features import levels_of
from .join import expand_by, min_volume
from .ordered import quantiles
from .summarize import quantile_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The reported percentiles.
QS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@dataclass
class EntityFit:
    """Shared coefficients, entity effects (entity, effect0[, effect1]) and the scored cells."""

    beta: dict[str, float]
    tau2: list[float]
    effects: DataFrame
    cells: DataFrame
    steps: int
    converged: bool
    terms: list[str] = field(default_factory=list)

    def mean_lp(self) -> float:
        """Mean linear predictor over the cases, entity effects included."""
        return self.cells.agg(F.sum(F.col("n") * F.col("lp")) / F.sum("n")).first()[0]


def _cells(df: DataFrame, keys: Sequence[str], covars: Sequence[str], outcome: str) -> DataFrame:
    cols = list(dict.fromkeys([*keys, *covars]))
    d = complete(df.select(*cols, F.col(outcome).cast("double").alias("_y")))
    return d.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("d"))


def _terms(cells: DataFrame, factors: Sequence[str], numerics: Sequence[str], crossed: Sequence[str],
           intercept: bool) -> list[tuple[str, Column, str | None]]:
    """(name, column, crossed group or None) of each shared coefficient."""
    levels = levels_of(cells, [*factors, *crossed])
    out: list[tuple[str, Column, str | None]] = []
    if intercept:
        out.append(("(Intercept)", F.lit(1.0), None))
    for c in factors:
        out += [(f"{c}{v}", (F.col(c) == F.lit(v)).cast("double"), None) for v in levels[c][1:]]
    out += [(c, F.col(c).cast("double"), None) for c in numerics]
    for c in crossed:
        out += [(f"{c}:{v}", (F.col(c) == F.lit(v)).cast("double"), c) for v in levels[c]]
    return out


def _doubles(values) -> str:
    return "CAST(array(" + ", ".join(f"{float(v)!r}D" for v in values) + ") AS array<double>)"


def _variances(ent: DataFrame, tau2: list[float], coarse: bool) -> list[float]:
    """Effect variances that maximise the likelihood of the entities' working values, from one pass.

    The working value of an entity is its effect plus gradient over curvature, with variance
    tau2 + 1 / curvature. All candidate variances are summed together.
    """
    grids = [np.geomspace(1e-4, 1e2, 37) if coarse else np.clip(t * np.geomspace(0.6, 1 / 0.6, 21), 1e-5, 1e3) for t in tau2]
    out = []
    for a, grid in enumerate(grids):
        rows = ent.filter(F.col(f"W{a}{a}") > 1e-9).select(
            (1 / F.col(f"W{a}{a}")).alias("v"), (F.col(f"u{a}") + F.col(f"R{a}") / F.col(f"W{a}{a}")).alias("y"),
            F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t"))
        loss = rows.groupBy("t").agg(F.sum(F.ln(F.col("t") + F.col("v")) + F.col("y") * F.col("y") / (F.col("t") + F.col("v"))).alias("s"))
        out.append(float(min(loss.collect(), key=lambda r: r.s).t))
    return out


def _penalties(s: np.ndarray, v: np.ndarray, groups: Sequence[str | None], variances: dict[str, float],
               prior_sd: float) -> np.ndarray:
    """Ridge of each shared coefficient; variances of crossed groups maximise the marginal likelihood.

    s and v are the curvature and the linear term of the shared coefficients.
    """
    def ridge():
        return np.array([1 / (variances[g] if g else prior_sd ** 2) for g in groups])

    for name in variances:
        def fit(value):
            variances[name] = value
            d = ridge()
            full = s + np.diag(d)
            return (np.linalg.slogdet(full)[1] - np.sum(np.log(d)) - v @ np.linalg.solve(full, v))
        variances[name] = float(min(np.geomspace(1e-5, 1e2, 71), key=fit))
    return ridge()


def fit_entity_effects(df: DataFrame, entity: str, outcome: str, factors: Sequence[str] = (),
                       numerics: Sequence[str] = (), crossed: Sequence[str] = (), slope: str | None = None,
                       pooling: str = "partial", prior_sd: float = 10.0, max_steps: int = 25,
                       tol: float = 1e-3) -> EntityFit:
    """Logistic regression with one effect per entity.

    pooling 'partial': effects are shrunk by a variance estimated from the data; with `slope`, a 0/1
    column gets its own independent entity effect. 'none': free effects under a wide normal prior,
    no intercept. `crossed` columns (few levels, such as the period) get shrunk effects too.
    Shared coefficients have a normal prior of standard deviation prior_sd.
    """
    if pooling not in ("partial", "none"):
        raise ValueError("pooling is 'partial' or 'none'")
    free = pooling == "none"
    covars = [*factors, *numerics, *crossed, *([slope] if slope else [])]
    cells = cut(_cells(df, [entity], covars, outcome))
    terms = _terms(cells, factors, numerics, crossed, intercept=not free)
    p, z = len(terms), [F.lit(1.0)] + ([F.col(slope).cast("double")] if slope else [])
    q = len(z)
    work = cells.select(*cells.columns, *[e.alias(f"x{j}") for j, (_, e, _) in enumerate(terms)],
                        *[e.alias(f"z{a}") for a, e in enumerate(z)])
    rate = cells.agg(F.sum("d") / F.sum("n")).first()[0]
    beta = np.zeros(p)
    start = float(np.log(rate / (1 - rate)))
    if not free:
        beta[0] = start
    tau2 = [prior_sd ** 2 if free else 0.1] * q
    ctau = {c: 0.1 for c in crossed}
    # The shared coefficients travel with the effects: every step then runs the same generated code.
    u = cells.select(entity).distinct().selectExpr(
        f"`{entity}`", *[f"{start if free and a == 0 else 0.0!r}D AS u{a}" for a in range(q)], "1e9D AS moved",
        _doubles(beta) + " AS b", _doubles(tau2) + " AS t")
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    zz = [(a, b) for a in range(q) for b in range(a, q)]
    ab = [(a, b) for a in range(q) for b in range(q)]
    converged, step = False, 0

    def score(eff):
        parts = [f"b[{j}] * x{j}" for j in range(p)] + [f"u{a} * z{a}" for a in range(q)]
        return work.join(eff, entity).withColumn("lp", F.expr(" + ".join(parts)))

    def inv(a, b):
        return f"V{min(a, b)}{max(a, b)}"

    # Sums are written as SQL text: hundreds of small column objects would cost more than the job.
    sums = [f"sum(w * z{a} * z{b}) AS W{a}{b}" for a, b in zz] + [f"sum(r * z{a}) AS R{a}" for a in range(q)]
    sums += [f"sum(w * z{a} * x{j}) AS C{a}_{j}" for a in range(q) for j in range(p)]
    sums += [f"sum(w * x{j} * x{k}) AS H{j}_{k}" for j, k in pairs] + [f"sum(r * x{j}) AS E{j}" for j in range(p)]
    sums += [f"first({c}) AS {c}" for c in (*[f"u{a}" for a in range(q)], "moved", "t")]
    local = [f"R{a} - u{a} / t[{a}] AS g{a}" for a in range(q)]
    local += [f"W{a}{b}" + (f" + 1 / t[{a}]" if a == b else "") + f" AS A{a}{b}" for a, b in zz]
    inverse = ["1 / A00 AS V00"] if q == 1 else [f"{c} / (A00 * A11 - A01 * A01) AS {v}" for c, v in
                                                  (("A11", "V00"), ("A00", "V11"), ("-A01", "V01"))]
    total = [f"sum(H{j}_{k} - (" + " + ".join(f"C{a}_{j} * {inv(a, b)} * C{b}_{k}" for a, b in ab) + f")) AS S{j}_{k}" for j, k in pairs]
    total += [f"sum(E{j} - (" + " + ".join(f"C{a}_{j} * {inv(a, b)} * g{b}" for a, b in ab) + f")) AS T{j}" for j in range(p)]

    for step in range(1, max_steps + 1):
        rows = score(u).withColumn("pr", F.expr("1 / (1 + exp(-lp))")).selectExpr(
            "*", "n * pr * (1 - pr) AS w", "d - n * pr AS r")
        ent = cut(rows.groupBy(entity).agg(*[F.expr(e) for e in sums]))
        ent = ent.selectExpr("*", *local).selectExpr("*", *inverse)
        tot = ent.agg(*[F.expr(e) for e in total], F.max("moved").alias("moved")).first()
        delta = np.zeros(0)
        if p:
            s = np.zeros((p, p))
            for j, k in pairs:
                s[j, k] = s[k, j] = tot[f"S{j}_{k}"]
            grad = np.array([tot[f"T{j}"] for j in range(p)])
            penalty = _penalties(s, s @ beta + grad, [g for _, _, g in terms], ctau, prior_sd)
            delta = np.linalg.solve(s + np.diag(penalty), grad - penalty * beta)
        beta = beta + delta
        if not free:
            tau2 = _variances(ent, tau2, coarse=step <= 2)
        gaps = ["(" + " + ".join(f"{inv(a, b)} * (g{b}" + "".join(f" - ({float(delta[j])!r}D) * C{b}_{j}" for j in range(p)) + ")"
                                 for b in range(q)) + ")" for a in range(q)]
        u = ent.selectExpr(f"`{entity}`", *[f"u{a} + {gaps[a]} AS u{a}" for a in range(q)],
                           "greatest(" + ", ".join(f"abs({x})" for x in gaps) + ", 0D) AS moved",
                           _doubles(beta) + " AS b", _doubles(tau2) + " AS t")
        if step > 1 and max([tot["moved"], *np.abs(delta)]) < tol:
            converged = True
            break
    u = cut(u)
    names = [n for n, _, _ in terms]
    scored = score(u).select(*cells.columns, "lp")
    return EntityFit(dict(zip(names, map(float, beta))), tau2, u.select(entity, *[F.col(f"u{a}").alias(f"effect{a}") for a in range(q)]),
                     scored, step, converged, names)


def fit_random_intercept(df: DataFrame, entity: str, outcome: str, factors: Sequence[str] = (),
                         numerics: Sequence[str] = (), **kw) -> EntityFit:
    """Partial pooling: random intercept per entity."""
    return fit_entity_effects(df, entity, outcome, factors, numerics, pooling="partial", **kw)


def _finished(fit: EntityFit) -> EntityFit:
    if not fit.converged:
        raise ValueError("the fit has not converged; allow more steps")
    return fit


def reliability_adjusted(fit: EntityFit, probs: Sequence[float] = QS) -> DataFrame:
    """Quantiles of the adjusted rate (percent): mean linear predictor plus entity effect."""
    rates = _finished(fit).effects.select((expit(F.lit(fit.mean_lp()) + F.col("effect0")) * 100).alias("rate"))
    return quantile_table(rates, "rate", probs, "rate")


def adjusted_by_period(fit: EntityFit, period: str, probs: Sequence[float] = QS) -> DataFrame:
    """Adjusted rate of every entity in every period (percent): its quantiles per period."""
    means = _finished(fit).cells.groupBy(period).agg((F.sum(F.col("n") * F.col("lp")) / F.sum("n")).alias("mean_lp"))
    grid = expand_by(fit.effects.select("effect0"), means)
    rates = grid.select(period, (expit(F.col("effect0") + F.col("mean_lp")) * 100).alias("rate"))
    return quantiles(rates, "rate", probs, [period], [f"p{x * 100:g}" for x in probs])


def sensitivity(df: DataFrame, entity: str, outcome: str, factors: Sequence[str], drop: Sequence[str],
                min_rows: Sequence[int] = (5, 10), probs: Sequence[float] = QS, **kw) -> DataFrame:
    """Adjusted-rate quantiles with and without some covariates, for several minimum entity sizes."""
    out = None
    for k in min_rows:
        part = min_volume(df, entity, k)
        full = reliability_adjusted(fit_random_intercept(part, entity, outcome, factors, **kw), probs)
        less = reliability_adjusted(fit_random_intercept(part, entity, outcome, [f for f in factors if f not in drop], **kw), probs)
        one = full.withColumnRenamed("rate", "with").join(less.withColumnRenamed("rate", "without"), "percentile", "left")
        one = one.withColumn("min_rows", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def crude_logit(df: DataFrame, entity: str, outcome: str) -> DataFrame:
    """Unpooled, unadjusted entity effects: the log odds of the entity rate (NULL at 0 and 1)."""
    return df.groupBy(entity).agg(logit(F.avg(F.col(outcome).cast("double"))).alias("effect0"))


_DONE = 1e-14  # gain in log likelihood that a full step still promises
_SURE = 1e-6  # what counts as zero in a certificate of separation, relative to its reach


def _basis(h: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """Columns of each entity that are no combination of those before them in the given order."""
    scale = np.sqrt(np.einsum("mjj->mj", h))
    scale = np.where(scale > 0, scale, 1.0)
    rest = h / (scale[:, :, None] * scale[:, None, :])
    keep = np.zeros(scale.shape, bool)
    for j in order:
        own = rest[:, j, j]
        keep[:, j] = own > 1e-9
        rest = rest - np.where(keep[:, j], 1 / np.where(keep[:, j], own, 1.0), 0.0)[:, None, None] * (
            rest[:, :, j, None] * rest[:, None, j, :])
    return keep


def _newton_steps(h: np.ndarray, g: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """One Newton step of every entity in the columns of its basis, all systems solved together."""
    both = keep[:, :, None] & keep[:, None, :]
    m = np.where(both, h, 0.0) + np.where(keep, 0.0, 1.0)[:, :, None] * np.eye(h.shape[1])
    scale = np.sqrt(np.maximum(np.einsum("mjj->mj", m), 1e-300))
    unit = m / (scale[:, :, None] * scale[:, None, :]) + 1e-14 * np.eye(h.shape[1])
    return np.linalg.solve(unit, (np.where(keep, g, 0.0) / scale)[:, :, None])[:, :, 0] / scale


def _advance(p: int, at: int, columns: list[str]):
    upper = np.triu_indices(p)
    order = [0, at, *[j for j in range(p) if j not in (0, at)]]

    def run(batches):
        for d in batches:
            h = np.zeros((len(d), p, p))
            h[:, upper[0], upper[1]] = np.stack(d["h"].to_list())
            h[:, upper[1], upper[0]] = h[:, upper[0], upper[1]]
            g, b, before = (np.stack(d[c].to_list()).astype(float) for c in ("g", "b", "before"))
            first = d["best"].isna().to_numpy()
            keep = np.stack([np.array(k, bool) if k is not None else np.ones(p, bool) for k in d["keep"]])
            if first.any():
                keep[first] = _basis(h[first], order)
            step = _newton_steps(h, g, keep)
            promise = np.einsum("mj,mj->m", np.where(keep, g, 0.0), step) / 2
            ll, best = d["ll"].to_numpy(), d["best"].fillna(-np.inf).to_numpy()
            worse = ll < best - 1e-9 * (1 + np.abs(ll))
            reach = d["reach"].to_numpy()
            apart = (reach > 0.1) & (d["mixed"].to_numpy() <= _SURE * reach) & (d["against"].to_numpy() <= _SURE * reach)
            done = (promise <= _DONE) & ~worse
            state = np.where(~keep[:, at], "singular", np.where(apart, "separated", np.where(done, "converged", "open")))
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.nanmax(np.where(keep, np.abs(g) / np.sqrt(np.einsum("mjj->mj", h)), 0.0), axis=1)
            new = np.where(worse[:, None], (b + before) / 2, b + step)
            out = d[[columns[0]]].assign(
                b=list(new), before=list(np.where(worse[:, None], before, b)),
                step=list(np.where(worse[:, None], 0.0, step)), best=np.where(worse, best, ll), keep=list(keep), state=state,
                score=score)
            yield out[columns]
    return run


def logit_by(df: DataFrame, entity: str, outcome: str, term: str, factors: Sequence[str] = (),
             numerics: Sequence[str] = (), steps: int = 100) -> DataFrame:
    """A separate logistic regression per entity: (entity, estimate, state, score) for the coefficient of `term`.

    All entities advance together by Newton steps, halved where the likelihood falls; each pass sums gradient and
    curvature per entity over its cells, and entities that are done leave. Columns that are combinations of earlier
    ones in an entity (intercept and term come first) are left out there. state says how a fit ended: `converged`;
    `singular`, where the term does not vary on its own; `separated`, where the data prove that no finite estimate
    exists - the last step moves every cell with one outcome towards it or not at all, and no cell with both; `open`
    after `steps` passes. The estimate is NULL unless converged. score is the largest gradient in standard errors at
    the end; it is 0 but for rounding where the score equations hold.
    """
    cells = cut(_cells(df, [entity], [term, *factors, *numerics], outcome))
    terms = _terms(cells, factors, [term, *numerics], [], intercept=True)
    p, at = len(terms), 1 + [n for n, _, _ in terms[1:]].index(term)
    work = cells.select(entity, "n", "d", *[e.alias(f"x{j}") for j, (_, e, _) in enumerate(terms)])
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    rate = cells.groupBy(entity).agg(((F.sum("d") + 0.5) / (F.sum("n") + 1)).alias("rate"))
    start, nothing = F.array(logit("rate"), *[F.lit(0.0)] * (p - 1)), F.array(*[F.lit(0.0)] * p)
    coef = rate.select(entity, start.alias("b"), start.alias("before"), nothing.alias("step"), F.lit(None).cast("double").alias("best"),
                       F.lit(None).cast("array<boolean>").alias("keep"))
    kept = ["b", "before", "step", "best", "keep"]
    lp = F.expr(" + ".join(f"b[{j}] * x{j}" for j in range(p)))
    move = F.expr(" + ".join(f"step[{j}] * x{j}" for j in range(p)))
    way = F.when(F.col("d") >= F.col("n"), F.col("move")).when(F.col("d") <= 0, -F.col("move"))
    sums = [*[F.first(c).alias(c) for c in kept],
            F.sum(F.expr("d * lp - n * (greatest(lp, 0) + log1p(exp(-abs(lp))))")).alias("ll"),
            F.array(*[F.expr(f"sum(w * x{j} * x{k})") for j, k in pairs]).alias("h"),
            F.array(*[F.expr(f"sum(r * x{j})") for j in range(p)]).alias("g"),
            F.coalesce(F.max(way), F.lit(0.0)).alias("reach"), F.coalesce(F.max(-way), F.lit(0.0)).alias("against"),
            F.coalesce(F.max(F.when(way.isNull(), F.abs("move"))), F.lit(0.0)).alias("mixed")]
    kind = df.schema[entity].dataType.simpleString()
    schema = (f"`{entity}` {kind}, b array<double>, before array<double>, step array<double>, best double, "
              "keep array<boolean>, state string, score double")
    columns = [entity, *kept, "state", "score"]
    done, left = [], steps
    while True:
        rows = work.join(coef, entity).withColumns({"lp": lp, "move": move}).withColumn("pr", F.expr("1 / (1 + exp(-lp))"))
        rows = rows.selectExpr("*", "n * pr * (1 - pr) AS w", "d - n * pr AS r")
        state = cut(rows.groupBy(entity).agg(*sums).mapInPandas(_advance(p, at, columns), schema))
        left -= 1
        over = state if left <= 0 else state.where("state <> 'open'")
        done.append(over.select(entity, F.when(F.col("state") == "converged", F.get("b", at)).alias("estimate"), "state", "score"))
        coef = state.where("state = 'open'").select(entity, *kept)
        if left <= 0 or coef.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)

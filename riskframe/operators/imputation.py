"""Multiple imputation by chained equations, with draws of the models' coefficients, and pooling of the results.

The imputations are one table with a number, so every pass serves all of them. A column is filled from a model of all
others: equal rows where it is known are one cell, the cross products of the cells are summed in one pass for each
step, the coefficients are drawn from their posterior on the driver, and rows are filled where they lie. Rows without a
missing value stay in one table; only the others are written for each imputation.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import uniform
from ..lineage import Tables, spread
from .features import known_cells, take_donors

# Ship these helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RIDGE = 1e-8
STEPS = 25
ENOUGH = 1e-3


def _sums(cells: DataFrame, x: Sequence[str], y: str, m: int, terms) -> list[list[np.ndarray]]:
    """terms(k, X, y, n) gives arrays; their sums over the cells of every imputation k, each of n equal rows, X with a
    first column of ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, len(x) + 3)]
            matrix, known, size = np.stack([np.ones(len(batch)), *columns[:-2]], 1), columns[-2], columns[-1]
            number = batch.column(0).to_numpy()
            for k in np.unique(number).tolist():
                part = terms(k, matrix[number == k], known[number == k], size[number == k])
                total[k] = [a + b for a, b in zip(total[k], part)] if k in total else part
        for k, arrays in total.items():
            for i, a in enumerate(arrays):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(a.size, k, np.int32)), pa.array(np.full(a.size, i, np.int32)),
                     pa.array(np.arange(a.size, dtype=np.int32)), pa.array(np.ravel(a).astype(float))], names=["k", "i", "at", "v"])
    got = (cells.select("imputation", *x, y, "_n").mapInArrow(run, "k int, i int, at int, v double").groupBy("k", "i", "at")
           .agg(F.sum("v").alias("v")).orderBy("k", "i", "at").collect())
    out: list[list[list[float]]] = [[] for _ in range(m)]
    for r in got:
        some = out[r.k - 1]
        while len(some) <= r.i:
            some.append([])
        some[r.i].append(r.v)
    return [[np.array(a) for a in some] for some in out]


def _posterior(h: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """A draw around 0 with covariance scale^2 h^-1; columns are brought to one size first."""
    size = np.sqrt(np.maximum(np.diag(h), 1e-300))
    root = np.linalg.cholesky(h / np.outer(size, size) + RIDGE * np.eye(len(h)))
    return scale * np.linalg.solve(root.T, rng.standard_normal(len(h))) / size


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(np.diag(h), 1e-300))
    return np.linalg.solve(h / np.outer(size, size) + RIDGE * np.eye(len(h)), g / size) / size


def _linear(known: DataFrame, x: Sequence[str], y: str, m: int, rngs) -> tuple[list, list]:
    """Estimated and drawn coefficients of every imputation."""
    sums = _sums(known, x, y, m, lambda k, a, b, n: [(a * n[:, None]).T @ a, a.T @ (n * b), np.array([b @ (n * b), n.sum()])])
    p = len(x) + 1
    fitted, drawn = [], []
    for (h, g, (yy, n)), rng in zip(sums, rngs):
        h = h.reshape(p, p)
        b = _solve(h, g)
        rss = max(yy - 2 * b @ g + b @ h @ b, 0.0)
        sigma = np.sqrt(rss / rng.chisquare(max(n - p, 1)))
        fitted.append(b)
        drawn.append(b + _posterior(h, sigma, rng))
    return fitted, drawn


def _logistic(known: DataFrame, x: Sequence[str], y: str, m: int, rngs, start: list | None) -> tuple[list, list]:
    """Estimated and drawn coefficients of every imputation; a weak ridge keeps separated data finite.

    Steps end when the likelihood has no more than ENOUGH to gain; `start` are the estimates of the sweep before.
    """
    p = len(x) + 1
    now = start or [np.zeros(p) for _ in range(m)]
    h: list[np.ndarray] = []
    for _ in range(STEPS):
        def terms(k, a, b, n, now=now):
            chance = 1 / (1 + np.exp(-np.clip(a @ now[k - 1], -500, 500)))
            return [(a * (n * chance * (1 - chance))[:, None]).T @ a, a.T @ (n * (b - chance)), (a * a * n[:, None]).sum(0)]
        sums = _sums(known, x, y, m, terms)
        ridge = [1e-4 * s[2] / max(s[2][0], 1) for s in sums]
        h = [s[0].reshape(p, p) + np.diag(r) for s, r in zip(sums, ridge)]
        slopes = [s[1] - r * b for s, r, b in zip(sums, ridge, now)]
        steps = [_solve(a, g) for a, g in zip(h, slopes)]
        now = [b + np.clip(d, -5, 5) for b, d in zip(now, steps)]
        if max(g @ d / 2 for g, d in zip(slopes, steps)) < ENOUGH:
            break
    return now, [b + _posterior(a, 1.0, rng) for b, a, rng in zip(now, h, rngs)]


def _predicted(betas: Sequence[np.ndarray], x: Sequence[str]) -> Column:
    """The linear predictor of a row under the coefficients of its imputation."""
    b = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in one]) for one in betas]), F.col("imputation") - 1)
    out = F.get(b, 0)
    for j, c in enumerate(x, 1):
        out = out + F.get(b, j) * F.col(c)
    return out


def impute_multiple(df: DataFrame, methods: Mapping[str, str], row_id: str, m: int = 3, iters: int = 5, seed: int = 1,
                    donors: int = 5, exclude: Sequence[str] = ()) -> DataFrame:
    """m completed copies of df, told apart by the column `imputation` (from 1).

    methods: column -> 'pmm' (numeric, predictive mean matching: known rows by the estimated coefficients, missing
    ones by coefficients drawn from their posterior, the value of one of the nearest `donors`) or 'logreg' (0/1, drawn
    with the probability under drawn coefficients). Columns are filled one after the other from all others, for
    `iters` sweeps; other columns must be known. Missing values start at the column mean, 0/1 columns at its rate.
    Draws depend on seed, imputation and row_id alone. Columns in `exclude` pass through and predict nothing.
    """
    spark = df.sparkSession
    targets = list(methods)
    if unknown := set(methods.values()) - {"pmm", "logreg"}:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(str(i)) for i, c in enumerate(targets)]).first()
    plain = {c: f"_x{i}" for i, c in enumerate(c for c in df.columns if c not in (row_id, *exclude))}
    work = spread(df.select(row_id, *exclude, *[F.col(f"`{c}`").cast("double").alias(a) for c, a in plain.items()]))
    flags = {c: f"_na{i}" for i, c in enumerate(targets)}
    stay, tables = Tables(spark, "imputed"), Tables(spark, "imputation")
    whole = stay.keep(work.withColumns({flags[c]: F.col(plain[c]).isNull().cast("int") for c in targets}))
    gaps = sum((F.col(x) for x in flags.values()), F.lit(0))
    number = F.explode(F.sequence(F.lit(1), F.lit(m))).alias("imputation")
    cells = stay.keep(whole.where(gaps == 0).groupBy(*plain.values()).agg(F.count(F.lit(1)).alias("_n"))).select("*", number)
    fixed, work = whole.where(gaps == 0).select("*", number), whole.where(gaps > 0).select("*", number)
    for i, c in enumerate(targets):
        chance = uniform(F.lit(f"{seed}:start:{i}"), "imputation", row_id)
        start = F.lit(means[i]) if methods[c] == "pmm" else (chance < means[i]).cast("double")
        work = work.withColumn(plain[c], F.coalesce(F.col(plain[c]), start))
    work = tables.keep(work)
    estimates: dict[str, list] = {}
    for sweep in range(iters):
        for i, c in enumerate(targets):
            y, missing, x = plain[c], flags[c], [a for a in plain.values() if a != plain[c]]
            known = tables.keep(known_cells(cells, work, y, missing, list(plain.values()), ["imputation"]))
            draw = uniform(F.lit(f"{seed}:{sweep}:{i}"), "imputation", row_id)
            rngs = [np.random.default_rng([seed, sweep, i, k]) for k in range(m)]
            if methods[c] == "pmm":
                fitted, drawn = _linear(known, x, y, m, rngs)
                donor = ["imputation", row_id, _predicted(fitted, x).alias("_pred"), F.col(y).alias("_value")]
                pool = fixed.select(*donor).unionByName(work.where(F.col(missing) == 0).select(*donor))
                empty = work.where(F.col(missing) == 1).withColumn("_pred", _predicted(drawn, x))
                filled = take_donors(pool, empty, y, row_id, draw, donors, tables, ["imputation"])
                work = work.where(F.col(missing) == 0).unionByName(filled)
            else:
                estimates[c], drawn = _logistic(known, x, y, m, rngs, estimates.get(c))
                hit = (draw < 1 / (1 + F.exp(-_predicted(drawn, x)))).cast("double")
                work = work.withColumn(y, F.when(F.col(missing) == 1, hit).otherwise(F.col(y)))
            work = tables.keep(work)
            tables.drop(last=1)
    out = fixed.unionByName(stay.keep(work)).select(
        "imputation", row_id, *exclude, *[F.col(a).alias(c) for c, a in plain.items()])
    tables.drop()
    return out


def pool(estimates: DataFrame, by: Sequence[str] = ("term",), estimate: str = "estimate", variance: str = "variance") -> DataFrame:
    """One estimate from those of the imputations: mean, within and between variance, their total, degrees of freedom.

    total = within + (1 + 1/m) between; df = (m - 1) (1 + within / ((1 + 1/m) between))^2, NULL without variance
    between the imputations.
    """
    m = F.count(F.lit(1)).cast("double")
    out = estimates.groupBy(*by).agg(m.alias("m"), F.avg(estimate).alias("estimate"), F.avg(variance).alias("within"),
                                     F.var_samp(F.col(estimate)).alias("between"))
    extra = (1 + 1 / F.col("m")) * F.col("between")
    return out.select(*by, "m", "estimate", "within", "between", (F.col("within") + F.coalesce(extra, F.lit(0.0))).alias("total"),
                      ((F.col("m") - 1) * F.pow(1 + F.try_divide(F.col("within"), extra), 2)).alias("df"))

"""Feature preparation: dummies, design matrices, splits, folds and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import hash32, uniform
from ..functions.nulls import complete
from ..lineage import Tables, cut, store
from .ordered import row_index, running_sums

MAX_LEVELS = 10_000
PARTS = 64  # tasks over which donors of one prediction are numbered


def levels_of(df: DataFrame, cols: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted levels of categorical columns, found in one pass.

    Levels become columns of a plan, so a column of over `most` of them is an error, whatever other columns are
    asked for with it; pass a larger `most`, or levels of your own, to go beyond.
    """
    if not cols:
        return {}
    items = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]
    found = (df.select(F.explode(F.array(*items)).alias("x")).select("x.*").filter(F.col("v").isNotNull())
             .distinct().persist())
    counts = {r["c"]: r["count"] for r in found.groupBy("c").count().collect()}
    wide = sorted(c for c, n in counts.items() if n > most)
    rows = [] if wide else found.collect()
    found.unpersist()
    if wide:
        raise ValueError(f"more than {most} levels in {', '.join(wide)}: not categorical")
    kinds = dict(df.dtypes)
    number = {c: int if kinds[c] in ("int", "bigint", "smallint", "tinyint") else float if kinds[c] == "double" else str
              for c in cols}
    return {c: sorted(number[c](r.v) for r in rows if r.c == c) for c in cols}


def dummies_full(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Replace each column by one 0/1 column per level, named column.level; NULL gives NULL in each."""
    levels = levels or levels_of(df, cols)
    out = []
    for c in df.columns:
        if c in cols:
            out += [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}.{v}") for v in levels[c]]
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def design_matrix(df: DataFrame, terms: Sequence[str], factors: Sequence[str], row_id: str,
                  levels: Mapping[str, Sequence] | None = None, keep: Sequence[str] = (),
                  vector: str | None = "features") -> DataFrame:
    """Numeric design without intercept: the first factor gets all levels, later ones drop their first.

    Rows with a NULL in any term are left out; the row id stays for joining scores back.
    """
    d = complete(df.select(row_id, *keep, *terms), terms)
    levels = levels or levels_of(d, factors)
    cols, seen = [], False
    for c in terms:
        if c in factors:
            cols += [((F.col(c) == F.lit(v)).cast("double"), f"{c}{v}") for v in levels[c][1 if seen else 0:]]
            seen = True
        else:
            cols.append((F.col(c).cast("double"), c))
    out = d.select(row_id, *keep, *[e.alias(f"x_{n}") for e, n in cols])
    if vector:
        out = VectorAssembler(inputCols=[f"x_{n}" for _, n in cols], outputCol=vector).transform(out)
    return out.withColumnsRenamed({f"x_{n}": n for _, n in cols if n not in (row_id, *keep)})


def feature_map(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Index, name and type ('q' for quantitative) of each feature."""
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("feature"), F.lit("q").alias("type"))
                              for i, n in enumerate(features)]))
    return df.sparkSession.range(1).select(rows)


def split(df: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts by the hash of a key: no shuffle, the same rows on every run."""
    first = uniform(F.lit(seed), key) < share
    return df.filter(first), df.filter(~first)


def assign_folds(df: DataFrame, k: int, label: str, key: str, seed: int, name: str = "fold") -> DataFrame:
    """Fold number 0..k-1 from the hash of label and key. Folds are balanced within labels on average."""
    return df.withColumn(name, (hash32(F.lit(seed), label, key) % k).cast("int"))


def known_cells(fixed: DataFrame, rows: DataFrame, target: str, missing: str, cols: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """(by, cols, _n): equal rows counted once, of the cells of complete rows and of the rows that know the target."""
    own = rows.where(F.col(missing) == 0).groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("_n"))
    return (fixed.select(*by, *cols, "_n").unionByName(own).groupBy(*by, *cols)
            .agg(F.sum("_n").cast("double").alias("_n")))


def take_donors(known: DataFrame, rows: DataFrame, target: str, row_id: str, draw: Column, donors: int, tables: Tables,
                by: Sequence[str] = ()) -> DataFrame:
    """`rows` with the value of a random one of the nearest donors, by their predictions `_pred`.

    known holds the donors (row_id, by, _pred, _value). They are numbered in the order of their prediction, equal ones
    by hash. A row looks up its own position in that order and joins the donor number it draws around it, so it meets
    one donor, not all.
    """
    keys = [*by, "_pred"]
    counted = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    wanted = rows.select(*keys).distinct().withColumn("_d", F.lit(0).cast("bigint"))
    per = counted.unionByName(wanted).groupBy(*keys).agg(F.sum("_d").alias("_d"))
    at = tables.keep(running_sums(per, "_pred", ["_d"], by).select(
        *keys, F.col("prev__d").alias("_before"), "_d", F.col("all__d").alias("_all")))
    numbered = (row_index(known, row_id, keys, name="_i", parts=PARTS).join(at, keys)
                .select(*by, (F.col("_before") + F.col("_i")).alias("_rank"), "_value"))
    half = donors // 2
    pick = F.col("_before") - half + F.floor(draw * (F.col("_d") + 2 * half))
    found = (rows.join(at, keys).withColumn("_rank", F.greatest(F.lit(0), F.least(F.col("_all") - 1, pick)))
             .join(numbered, [*by, "_rank"]).withColumn(target, F.col("_value")))
    return found.select(*rows.columns).drop("_pred")


def impute_chained(df: DataFrame, methods: Mapping[str, str], row_id: str, iters: int = 5, seed: int = 1,
                   donors: int = 5, exclude: Sequence[str] = ()) -> DataFrame:
    """Fill missing values column by column from all others, for some sweeps.

    methods: column -> 'logreg' (0/1 column, drawn from its fitted probability) or 'pmm' (numeric,
    predictive mean matching). Missing values start at the column mean (0/1 columns: by its rate).
    Models are fitted to cells of equal rows. Only rows with a missing value are written again after each column, and
    the tables of the columns before are deleted.
    """
    if unknown := set(methods.values()) - {"pmm", "logreg"}:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    targets = list(methods)
    means = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(str(i)) for i, c in enumerate(targets)]).first()
    plain = {c: f"_x{i}" for i, c in enumerate(c for c in df.columns if c not in (row_id, *exclude))}
    work = df.select(row_id, *exclude, *[F.col(f"`{c}`").cast("double").alias(a) for c, a in plain.items()])
    flags = {}
    for i, c in enumerate(targets):
        a, flags[c] = plain[c], f"_na{i}"
        start = F.lit(means[i]) if methods[c] == "pmm" else (uniform(F.lit(f"{seed}:start:{i}"), row_id) < means[i]).cast("double")
        work = work.withColumn(flags[c], F.col(a).isNull().cast("int")).withColumn(a, F.coalesce(F.col(a), start))
    whole, tables = store(work), Tables(df.sparkSession, "chained")
    gaps = sum((F.col(x) for x in flags.values()), F.lit(0))
    fixed, work = whole.where(gaps == 0), whole.where(gaps > 0)
    cells = cut(fixed.groupBy(*plain.values()).agg(F.count(F.lit(1)).alias("_n")))
    for sweep in range(iters):
        for i, c in enumerate(targets):
            y, missing, draw = plain[c], flags[c], uniform(F.lit(f"{seed}:{sweep}:{i}"), row_id)
            own = dict(featuresCol="_f", labelCol=y, weightCol="_n", regParam=1e-4)
            assembler = VectorAssembler(inputCols=[a for a in plain.values() if a != y], outputCol="_f")
            known = assembler.transform(tables.keep(known_cells(cells, work, y, missing, list(plain.values()))))
            if methods[c] == "logreg":
                model = LogisticRegression(probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", maxIter=25, **own).fit(known)
                drawn = (draw < F.get(vector_to_array("_p"), 1)).cast("double")
                work = model.transform(assembler.transform(work)).withColumn(
                    y, F.when(F.col(missing) == 1, drawn).otherwise(F.col(y))).drop("_f", "_p", "_r", "_c")
            else:
                model = LinearRegression(predictionCol="_pred", **own).fit(known)
                scored = model.transform(assembler.transform(work)).drop("_f")
                pool = (model.transform(assembler.transform(fixed)).select(row_id, "_pred", F.col(y).alias("_value"))
                        .unionByName(scored.where(F.col(missing) == 0).select(row_id, "_pred", F.col(y).alias("_value"))))
                filled = take_donors(pool, scored.where(F.col(missing) == 1), y, row_id, draw, donors, tables)
                work = work.where(F.col(missing) == 0).unionByName(filled)
            work = tables.keep(work)
            tables.drop(last=1)
    return fixed.unionByName(work).select(row_id, *exclude, *[F.col(a).alias(c) for c, a in plain.items()])

"""Risk models and explanatory models on Spark ML."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import RFormula, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.nulls import complete
from ..functions.scalar import recode
from ..lineage import cut, spread, store
from .features import assign_folds
from .forest import Forest, fit_forest
from .order import rel_to_max
from .ordered import running_sums

SCORE = "risk"
WEIGHT = "_weight"
NODES = 2**20  # forests that may have more nodes are grown tree by tree in tasks; Spark's keep them all on the driver
FEWER = 4  # equal rows are fitted as weighted ones where there are this many times fewer of them


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")


def weighted_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame | None:
    """(cols, WEIGHT): equal rows counted once, for fits that see no difference; None where too few rows are equal.

    Trees of Spark draw their split candidates from a sample that takes every row with the same chance, so a count above
    the mean is dealt over several rows of about the mean: frequent rows stay as likely in the sample as they were.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if not all(isinstance(kinds.get(c), (NumericType, BooleanType)) for c in cols):
        return None
    keys = [F.col(f"`{c}`") for c in dict.fromkeys(cols)]
    counted = store(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    cells, n = counted.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if cells == 0 or cells * FEWER > n:
        return None
    parts = F.ceil(F.col("_n") * F.lit(cells / n))
    dealt = counted.select(*keys, (F.col("_n") / parts).alias(WEIGHT), F.explode(F.sequence(F.lit(1), parts)).alias("_part"))
    return spread(dealt).drop("_part")


def _fit_gbt(df: DataFrame, features: Sequence[str], label: str, gbt: GBTClassifier, *marks: str) -> PipelineModel:
    """Assemble the features and fit boosted trees, on weighted rows where many are equal; marks are other columns they need."""
    rows = weighted_rows(df, [*features, label, *marks])
    if rows is not None:
        df, gbt = cut(rows), gbt.setWeightCol(WEIGHT)
    return Pipeline(stages=[_assembler(features), gbt]).fit(df)


def fit_risk_gbt(df: DataFrame, features: Sequence[str], label: str, rounds: int = 10, depth: int = 6,
                 step: float = 0.1, seed: int = 2049) -> PipelineModel:
    """Boosted trees for the risk of every case."""
    gbt = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed,
                        predictionCol="_class").setProbabilityCol("_prob").setRawPredictionCol("_raw")
    return _fit_gbt(df, features, label, gbt)


def fit_counterfactual(df: DataFrame, features: Sequence[str], label: str, cohort: str, rounds: int = 50,
                       depth: int = 6, step: float = 0.1, min_gain: float = 0.0, stop_tol: float = 0.001,
                       seed: int = 102) -> PipelineModel:
    """Boosted trees trained on cohort 0; cohort 1 decides when to stop early."""
    marked = df.withColumn("_held", F.col(cohort) == 1)
    gbt = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed,
                        minInfoGain=min_gain, validationIndicatorCol="_held", validationTol=stop_tol,
                        predictionCol="_class").setProbabilityCol("_prob").setRawPredictionCol("_raw")
    return _fit_gbt(marked, features, label, gbt, "_held")


def fit_risk_rf(df: DataFrame, features: Sequence[str], label: str, trees: int = 250, min_leaf: int = 10,
                depth: int = 20, subset: str = "all", seed: int = 1) -> PipelineModel | Forest:
    """Random forest of regression trees on the 0/1 outcome: its mean prediction is the risk.

    A forest of over NODES possible nodes that tries all features is a Forest, if its cells of equal rows are few enough.
    """
    if subset == "all" and trees * 2**depth > NODES:
        grown = fit_forest(df, features, label, trees, min_leaf, depth, seed)
        if grown is not None:
            return grown
    rf = RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="_mean", numTrees=trees,
                               minInstancesPerNode=min_leaf, maxDepth=depth, featureSubsetStrategy=subset, seed=seed)
    return Pipeline(stages=[_assembler(features), rf]).fit(df)


def score(model: PipelineModel | Forest, df: DataFrame, name: str = SCORE) -> DataFrame:
    """Add the predicted risk; the columns that scoring needs on the way are dropped."""
    out = model.transform(df)
    value = F.get(vector_to_array("_prob"), 1) if "_prob" in out.columns else F.col("_mean")
    return out.withColumn(name, value).drop("_features", "_prob", "_raw", "_class", "_mean")


def score_out_of_fold(df: DataFrame, fit, k: int, label: str, key: str, seed: int, name: str = SCORE) -> DataFrame:
    """Score each row with a model that did not see it: fit(df) -> model, once per fold."""
    folds = assign_folds(df, k, label, key, seed, "_fold")
    out = None
    for i in range(k):
        part = score(fit(folds.filter(F.col("_fold") != i)), folds.filter(F.col("_fold") == i), name)
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def last_stage(model: Model) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def importance(model: Model, df: DataFrame, names: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Importance of each feature, its share of the largest, and a display name."""
    values = last_stage(model).featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    out = rel_to_max(df.sparkSession.createDataFrame(rows, "feature string, importance double"), "importance", "relative")
    return out.withColumn("label", recode("feature", dict(labels), keep_other=True) if labels else F.col("feature"))


def tree_text(model: Model, df: DataFrame) -> DataFrame:
    """The fitted tree or trees as numbered text lines."""
    lines = list(enumerate(last_stage(model).toDebugString.splitlines()))
    return df.sparkSession.createDataFrame(lines, "line int, text string")


def _fold_rows(df: DataFrame, features: Sequence[str], label: str, key: str, k: int, seed: int,
               count_equal: bool = True) -> tuple[DataFrame, bool]:
    """(_features, _y, _fold, WEIGHT) and whether rows are weighted ones; each weighs 1 where too few are equal."""
    folds = assign_folds(df, k, label, key, seed, "_fold").withColumn("_y", F.col(label).cast("double"))
    rows = weighted_rows(folds, [*features, "_y", "_fold"]) if count_equal else None
    out = folds.withColumn(WEIGHT, F.lit(1.0)) if rows is None else rows
    return cut(_assembler(features).transform(out).select("_features", "_y", "_fold", WEIGHT)), rows is not None


def cv_rounds(df: DataFrame, features: Sequence[str], label: str, key: str, rounds: int = 100, k: int = 5,
              depth: int = 6, step: float = 0.1, seed: int = 2049, share_of_best: float = 0.997) -> DataFrame:
    """Held-out AUC after each boosting round, averaged over folds; flags the first round near the best.

    Each fold is fitted once. The margin after r rounds is the running sum over its trees.
    """
    folds, weighted = _fold_rows(df, features, label, key, k, seed)
    parts = []
    for i in range(k):
        gbt = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
        gbt = gbt.setWeightCol(WEIGHT) if weighted else gbt
        model = gbt.fit(folds.filter(F.col("_fold") != i))
        held, margin, cols = folds.filter(F.col("_fold") == i), F.lit(0.0), []
        for r, (tree, weight) in enumerate(zip(model.trees, model.treeWeights), 1):
            held = tree.setFeaturesCol("_features").setPredictionCol(f"_t{r}").transform(held)
            margin = margin + F.col(f"_t{r}") * F.lit(float(weight))
            held = held.withColumn(f"_m{r}", margin)
            margin = F.col(f"_m{r}")
            cols.append(F.struct(F.lit(r).alias("round"), F.col(f"_m{r}").alias("margin")))
        long = held.select("_fold", "_y", WEIGHT, F.inline(F.array(*cols)))
        parts.append(long.groupBy("_fold", "round", "margin").agg(
            F.sum(F.col("_y") * F.col(WEIGHT)).alias("pos"), F.sum((1 - F.col("_y")) * F.col(WEIGHT)).alias("neg")))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    run = running_sums(counts, "margin", ["neg"], ["_fold", "round"])
    per = run.groupBy("_fold", "round").agg(F.try_divide(
        F.sum(F.col("pos") * (F.col("prev_neg") + F.col("neg") / 2)), F.sum("pos") * F.max("all_neg")).alias("auc"))
    out = cut(per.groupBy("round").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd")))
    best = out.agg(F.max("auc")).scalar()
    enough = out.filter(F.col("auc") >= best * share_of_best).agg(F.min("round")).scalar()
    return out.withColumn("chosen", F.col("round") == enough)


# The full search grid.
FULL_GRID = {"stepSize": [0.1, 0.3], "maxDepth": [2, 4, 6, 8], "minInfoGain": [0.0, 1.0, 2.0],
             "minInstancesPerNode": [1, 5, 10]}


def _weighted_setting(gbt: GBTClassifier, setting: Mapping, size: int) -> dict:
    """The setting for weighted rows: Spark counts rows for a node's least number of instances, so their weight stands in."""
    own = {**gbt.extractParamMap(), **setting}
    least = own[gbt.minInstancesPerNode]
    if 2 * least > size:  # no node can be split
        return {**setting, gbt.maxDepth: 0}
    share = max(own[gbt.minWeightFractionPerNode], (least - 0.5) / size)
    return {**setting, gbt.minInstancesPerNode: 1, gbt.minWeightFractionPerNode: share}


def grid_search(df: DataFrame, features: Sequence[str], label: str, key: str, grid: Mapping[str, Sequence] = FULL_GRID,
                rounds: int = 100, k: int = 5, seed: int = 1, parallelism: int = 4) -> DataFrame:
    """Cross-validated AUC of boosted trees for every setting of the grid, best first."""
    folds, weighted = _fold_rows(df, features, label, key, k, seed, "subsamplingRate" not in grid)
    gbt = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=rounds, seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(gbt.getParam(name), list(values))
    maps = builder.build()
    metric = BinaryClassificationEvaluator(labelCol="_y", metricName="areaUnderROC", numBins=0)
    if weighted:
        gbt, metric = gbt.setWeightCol(WEIGHT), metric.setWeightCol(WEIGHT)
    aucs = np.zeros((k, len(maps)))
    for i in range(k):
        train, held = folds.filter(F.col("_fold") != i).persist(), folds.filter(F.col("_fold") == i).persist()
        if train.isEmpty() or held.isEmpty():
            raise ValueError(f"fold {i} leaves no rows to fit or to score")
        size = round(train.agg(F.sum(WEIGHT)).first()[0])

        def fitted(setting):
            own = _weighted_setting(gbt, setting, size) if weighted else setting
            return metric.evaluate(gbt.fit(train, own).transform(held))

        with ThreadPool(min(parallelism, len(maps))) as pool:
            aucs[i] = pool.map(inheritable_thread_target(df.sparkSession)(fitted), maps, chunksize=1)
        train.unpersist()
        held.unpersist()
    names = list(grid)
    rows = [(*[float(m[gbt.getParam(n)]) for n in names], float(a), float(s))
            for m, a, s in zip(maps, aucs.mean(axis=0), aucs.std(axis=0))]
    schema = ", ".join(f"{n} double" for n in names) + ", auc double, sd double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("auc").desc())


def fit_logit(df: DataFrame, formula: str) -> PipelineModel:
    """Pooled logistic regression from a formula with factors, ':' and '*' terms; first level is the base.

    Each covariate cell enters as its outcome share weighted by its size, so the iterations run over
    cells, not cases.
    """
    label = formula.split("~")[0].strip()
    used = [c for c in df.columns if c in set(re.findall(r"\w+", formula)) and c != label]
    cells = cut(complete(df.select(label, *used)).groupBy(*used).agg(
        F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("_weight")))
    prep = RFormula(formula=formula, featuresCol="_features", labelCol="_label", stringIndexerOrderType="alphabetDesc",
                    forceIndexLabel=False)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_features", labelCol="_label",
                                      predictionCol="_mean", weightCol="_weight", maxIter=50, tol=1e-10)
    return Pipeline(stages=[prep, glr]).fit(cells)


def fit_intercept(df: DataFrame, label: str) -> DataFrame:
    """Intercept-only logistic regression: log odds of the rate and its standard error."""
    s = df.agg(F.sum(F.col(label).cast("double")).alias("d"), F.count(label).cast("double").alias("n"))
    return s.select(F.lit("(Intercept)").alias("term"), F.ln(F.col("d") / (F.col("n") - F.col("d"))).alias("estimate"),
                    F.sqrt(1 / F.col("d") + 1 / (F.col("n") - F.col("d"))).alias("std_error"))


def _feature_names(df: DataFrame, column: str) -> list[str]:
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    both = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    return [n for _, n in both]


def coef_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Term, estimate, standard error, z and p of a fitted logistic regression."""
    glm = last_stage(model)
    names = _feature_names(model.transform(df.limit(1)), "_features")
    s = glm.summary
    est = [*map(float, glm.coefficients), float(glm.intercept)]
    rows = list(zip([*names, "(Intercept)"], est, map(float, s.coefficientStandardErrors), map(float, s.tValues),
                    map(float, s.pValues)))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z double, p_value double")


def fit_tree(df: DataFrame, y: str, x: Sequence[str], task: str = "regression", depth: int = 5, min_split: int = 20,
             min_gain: float = 0.0, seed: int = 1) -> PipelineModel:
    """One tree on an entity table: regression, or classification of text or 0/1 classes."""
    common = dict(featuresCol="_features", maxDepth=depth, minInstancesPerNode=max(1, round(min_split / 3)),
                  minInfoGain=min_gain, seed=seed)
    clean = complete(df, [y, *x])
    if task == "regression":
        stages = [_assembler(x), DecisionTreeRegressor(labelCol=y, predictionCol="_mean", **common)]
    elif task == "class":
        clean = clean.withColumn(y, F.col(y).cast("string"))
        tree = DecisionTreeClassifier(labelCol="_label", predictionCol="_code", probabilityCol="_probs",
                                      rawPredictionCol="_raw", **common)
        stages = [StringIndexer(inputCol=y, outputCol="_label", stringOrderType="alphabetAsc"), _assembler(x), tree]
    else:
        raise ValueError("task is 'regression' or 'class'")
    return Pipeline(stages=stages).fit(clean)


def class_labels(model: PipelineModel) -> list[str]:
    """Class names of a classification tree, in code order."""
    return list(model.stages[0].labels)


def fit_entity_rf(df: DataFrame, y: str, x: Sequence[str], trees: int = 500, seed: int = 1) -> PipelineModel:
    """Forest on the entity table with a third of the features per split."""
    return fit_risk_rf(complete(df, [y, *x]), x, y, trees, 5, 10, "onethird", seed)


def default_estimators(label: str) -> dict[str, Estimator]:
    common = dict(featuresCol="_features", labelCol=label, predictionCol="_pred")
    return {"gbt": GBTRegressor(maxIter=50, maxDepth=1, stepSize=0.1, seed=1, **common),
            "forest": RandomForestRegressor(numTrees=100, featureSubsetStrategy="onethird", seed=1, **common),
            "ridge": LinearRegression(regParam=0.01, elasticNetParam=0.0, **common)}


def cv_compare(train: DataFrame, other: DataFrame, features: Sequence[str], label: str, key: str,
               estimators: Mapping[str, Estimator] | None = None, k: int = 10, repeats: int = 10, seed: int = 3028,
               parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """Repeated cross-validated RMSE of several regressors, and the other table with their predictions."""
    estimators = estimators or default_estimators(label)
    base = cut(_assembler(features).transform(complete(train, [label, *features])))
    scored = _assembler(features).transform(complete(other, features))
    metric = RegressionEvaluator(labelCol=label, predictionCol="_pred", metricName="rmse")
    rows = []
    for name, est in estimators.items():
        fitted = None
        for rep in range(repeats):
            folds = base.withColumn("_fold", (F.pmod(F.xxhash64(F.lit(seed + rep), F.col(key)), F.lit(k))).cast("int"))
            cv = CrossValidator(estimator=est, estimatorParamMaps=[{}], evaluator=metric, numFolds=k, foldCol="_fold",
                                parallelism=parallelism)
            fitted = cv.fit(folds)
            rows.append((name, rep, float(fitted.avgMetrics[0])))
        scored = fitted.bestModel.transform(scored).withColumnRenamed("_pred", f"pred_{name}")
    table = train.sparkSession.createDataFrame(rows, "model string, repeat int, rmse double")
    return (table.groupBy("model").agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("repeats")),
            scored.drop("_features"))


def fit_logit_counts(df: DataFrame, dead: str, alive: str, features: Sequence[str], key: str,
                     penalties: Sequence[float] = (0.0, 0.001, 0.01, 0.1), mixing: Sequence[float] = (0.1, 0.55, 1.0),
                     k: int = 3, seed: int = 1) -> tuple[PipelineModel, DataFrame]:
    """Penalised logistic regression on counts: two weighted rows per entity, penalty by cross-validated AUC."""
    two = F.inline(F.array(F.struct(F.lit(1.0).alias("_y"), F.col(dead).cast("double").alias("_w")),
                           F.struct(F.lit(0.0).alias("_y"), F.col(alive).cast("double").alias("_w"))))
    rows = (complete(df, [dead, alive, *features]).select(key, *features, two).filter(F.col("_w") > 0)
            .withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")))
    stage = _assembler(features)
    lr = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_w", probabilityCol="_prob",
                            rawPredictionCol="_raw", predictionCol="_class")
    maps = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).addGrid(lr.elasticNetParam, list(mixing)).build()
    metric = BinaryClassificationEvaluator(labelCol="_y", rawPredictionCol="_raw", weightCol="_w", numBins=0)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=maps, evaluator=metric, numFolds=k, foldCol="_fold", parallelism=4)
    fitted = cv.fit(cut(stage.transform(rows)))
    table = [(float(m[lr.regParam]), float(m[lr.elasticNetParam]), float(a)) for m, a in zip(maps, fitted.avgMetrics)]
    return (PipelineModel([stage, fitted.bestModel]),
            df.sparkSession.createDataFrame(table, "penalty double, mixing double, auc double"))

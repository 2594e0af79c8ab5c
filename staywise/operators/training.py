"""Training and selection of four classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.functions.expressions import label_strict
from staywise.operators.evaluation import DIGITS, champion, model_metrics, ranking_summary
from staywise.operators.features import (
    Feature,
    FittedPreparation,
    encode,
    feature_list,
    fit_preparation,
    impute,
    learned_levels,
    stratified_folds,
    stratified_split,
)
from staywise.operators.contract import accepted
from staywise.operators.scoring import PROBABILITY, Scorecard, decide, model_probability, probability_percent
from staywise.roles import ColumnRoles, ContractSpec
from staywise.session import fresh_path, stage

SEED = 42
FOLDS = 5
TEST_SHARE = 0.2
MARGIN_SCALE = 2.0  # boosted margins F give the probability sigmoid(2F)

# The searched grids, names in selection order.
C_GRID = (0.1, 1.0, 10.0)
DEPTH_GRID = (3, 5, 10)
FOREST_GRID = ((50, 5), (50, 10), (100, 5), (100, 10))
BOOST_GRID = ((50, 0.1), (50, 0.01), (100, 0.1), (100, 0.01))
BOOST_DEPTH = 3
MODEL_NAMES = (
    "LogisticRegression",
    "DecisionTreeClassifier",
    "RandomForestClassifier",
    "GradientBoostingClassifier",
)


@dataclass(frozen=True)
class PreparedData:
    """Assembled training and test rows with the statistics learned on the training rows."""

    train: DataFrame
    test: DataFrame
    features: tuple[Feature, ...]
    fitted: FittedPreparation
    train_rows: int
    #: Training rows as they were before preparation, with label and fold.
    raw: DataFrame
    carry: tuple[str, ...]
    numerics: tuple[str, ...]
    #: Statistics learned without a fold, filled in when they are first needed.
    per_fold: dict[int, FittedPreparation] = field(default_factory=dict)
    #: Staged training and validation rows of the folds, likewise; each is made under its lock.
    staged: dict[int, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    locks: tuple[Lock, ...] = field(default_factory=lambda: tuple(Lock() for _ in range(FOLDS)))


@dataclass(frozen=True)
class Candidate:
    """A fitted model with its cross-validated score and chosen settings."""

    name: str
    model: Model
    settings: str
    mean_auc: float
    std_auc: float
    #: Score of every fold and setting, and the folder of the scores it was computed from, if kept.
    fold_auc: tuple[tuple[float, ...], ...] = ()
    kept: str | None = None


def assemble(df: DataFrame, fitted: FittedPreparation, features: Sequence[Feature], carry: Sequence[str]) -> DataFrame:
    filled = impute(df, fitted.medians, fitted.modes)
    wide = encode(filled, features, fitted.means, fitted.deviations, carry)
    names = [f.name for f in features]
    # Column names may hold spaces and dots, so the vector is built from plain aliases.
    plain = wide.select(*carry, *[F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(names)])
    assembler = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features")
    return assembler.transform(plain).select(*carry, "features")


def prepare(df: DataFrame, roles: ColumnRoles, levels: dict[str, tuple[str, ...]] | None, drop_first: bool = False) -> PreparedData:
    """Stratified split, fold numbers, then preparation learned on the training rows only.

    Without ``levels`` those of each category are learned from the training rows too.
    """
    label = label_strict(roles.target, roles.positive, roles.negative).cast("double")
    labelled = df.withColumn("label", label).where(F.col("label").isNotNull())
    split = stratified_split(labelled, roles.id, roles.target, TEST_SHARE, SEED)
    train_raw = split.where(~F.col("is_test"))
    if levels is None:
        levels = learned_levels(train_raw, [c for c in roles.features if c not in roles.numerics])
    fitted = fit_preparation(train_raw, roles.numerics, levels)
    features = feature_list(roles.numerics, levels, drop_first)
    folded = stage(stratified_folds(train_raw, roles.id, roles.target, FOLDS, SEED + 1), "folds")
    carry = [roles.id, "label", "fold"]
    # Bootstrap draws follow the row order, so it is fixed: the same table gives the same models.
    ordered = assemble(folded, fitted, features, carry).repartition(roles.id).sortWithinPartitions(roles.id)
    train = stage(ordered, "train")
    test = stage(assemble(split.where("is_test"), fitted, features, carry[:2]), "test")
    return PreparedData(train, test, tuple(features), fitted, train.count(), folded, tuple(carry), tuple(roles.numerics))


def fold_preparation(data: PreparedData, fold: int) -> FittedPreparation:
    """Statistics of the training rows outside one fold, so that its rows take no part in their own scaling."""
    if fold not in data.per_fold:
        outside = data.raw.where(F.col("fold") != fold)
        data.per_fold[fold] = fit_preparation(outside, data.numerics, data.fitted.levels)
    return data.per_fold[fold]


def fold_rows(data: PreparedData, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold, both prepared with what the training rows show."""
    rows = assemble(data.raw, fold_preparation(data, fold), data.features, data.carry)
    key = data.carry[0]
    train = rows.where(F.col("fold") != fold).repartition(key).sortWithinPartitions(key)
    return train, rows.where(F.col("fold") == fold)


def staged_fold(data: PreparedData, fold: int) -> tuple[DataFrame, DataFrame]:
    """:func:`fold_rows`, written once for all fits."""
    with data.locks[fold]:
        if fold not in data.staged:
            train, held = fold_rows(data, fold)
            data.staged[fold] = stage(train, "fold"), stage(held, "fold")
        return data.staged[fold]


def penalty(c: float, rows: int) -> float:
    """Spark averages the loss over rows, so an inverse strength C becomes 1 / (C · rows)."""
    return 1.0 / (c * rows)


def logistic_model(c: float, rows: int, iterations: int = 1000) -> LogisticRegression:
    return LogisticRegression(
        maxIter=iterations, regParam=penalty(c, rows), elasticNetParam=0.0, standardization=False
    )


#: The fixed forest sets no depth; 30 is the deepest that Spark's trees go.
FOREST_DEPTH = 30


def legacy_estimators(rows: int) -> dict[str, object]:
    """The four classifiers at their fixed settings.

    The deep forest keeps each row's node between levels, which gives the same
    trees; else every level sends all trees so far to the tasks.
    """
    return {
        MODEL_NAMES[0]: logistic_model(1.0, rows),
        MODEL_NAMES[1]: DecisionTreeClassifier(maxDepth=10, seed=SEED),
        MODEL_NAMES[2]: RandomForestClassifier(numTrees=100, maxDepth=FOREST_DEPTH, seed=SEED, cacheNodeIds=True),
        MODEL_NAMES[3]: GBTClassifier(maxIter=100, maxDepth=BOOST_DEPTH, stepSize=0.1, seed=SEED),
    }


def search_space(name: str, rows: int) -> tuple[object, list[dict]]:
    """Estimator and parameter grid of one classifier; ``rows`` is the size of a fold's training part."""
    grid = ParamGridBuilder()
    if name == MODEL_NAMES[0]:
        estimator = logistic_model(1.0, rows)
        return estimator, grid.addGrid(estimator.regParam, [penalty(c, rows) for c in C_GRID]).build()
    if name == MODEL_NAMES[1]:
        estimator = DecisionTreeClassifier(seed=SEED)
        return estimator, grid.addGrid(estimator.maxDepth, list(DEPTH_GRID)).build()
    if name == MODEL_NAMES[2]:
        # Kept nodes give the same trees without walking every row down every tree at each level.
        estimator = RandomForestClassifier(seed=SEED, cacheNodeIds=True)
        return estimator, [{estimator.numTrees: n, estimator.maxDepth: d} for n, d in FOREST_GRID]
    if name == MODEL_NAMES[3]:
        estimator = GBTClassifier(maxDepth=BOOST_DEPTH, seed=SEED)
        return estimator, [{estimator.maxIter: n, estimator.stepSize: r} for n, r in BOOST_GRID]
    raise ValueError(f"unknown classifier {name}")


def served_settings(name: str, estimator: object, grid: Sequence[dict]) -> list[list[int]]:
    """Settings that one fit serves, the one that is fitted first.

    A boosted model's first rounds don't depend on the later ones, so of
    settings that differ in the rounds alone the longest is fitted.
    """
    if name != MODEL_NAMES[3]:
        return [[i] for i in range(len(grid))]
    alike: dict[tuple, list[int]] = {}
    for i, setting in enumerate(grid):
        rest = tuple(sorted((param.name, value) for param, value in setting.items() if param != estimator.maxIter))
        alike.setdefault(rest, []).append(i)
    return [sorted(found, key=lambda i: -grid[i][estimator.maxIter]) for found in alike.values()]


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model as it was after so many rounds."""
    if rounds >= model.getNumTrees:
        return model
    whole, jvm = model._java_obj, SparkContext._active_spark_context._jvm
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        whole.uid(), whole.trees()[:rounds], whole.treeWeights()[:rounds], model.numFeatures, model.numClasses
    )
    return model._copyValues(GBTClassificationModel(made))._set(maxIter=rounds)


def exact_auc(column: str = "probability") -> BinaryClassificationEvaluator:
    """Area under ROC over every distinct probability.

    The defaults would bin them and, for a tree, rank its leaves by their
    number of positives instead of their share.
    """
    return BinaryClassificationEvaluator(rawPredictionCol=column, metricName="areaUnderROC", numBins=0)


#: Fits that a search runs at a time while the rows fill few partitions.
MOST_FITS = 8


def fits_at_once(data: PreparedData) -> int:
    """As many fits as keep all cores busy: each holds its rows in memory, so large tables get few."""
    cores, parts = data.train.sparkSession.sparkContext.defaultParallelism, data.train.rdd.getNumPartitions()
    return max(2, min(MOST_FITS, -(-2 * cores // max(1, parts))))


def search(data: PreparedData, name: str, parallelism: int | None = None, keep: str | None = None) -> tuple[DataFrame, Candidate]:
    """Grid search over the folds, preparation learned anew in each; every setting's score and the refitted winner.

    With ``keep`` the scores of each fold's rows, by models fitted on the
    others, are stored in that folder, so that every figure can be checked.
    """
    return search_all(data, {name: keep}, parallelism)[name]


def search_all(data: PreparedData, keeps: Mapping[str, str | None], parallelism: int | None = None) -> dict[str, tuple[DataFrame, Candidate]]:
    """:func:`search` of several classifiers, all their fits, of any fold, ``parallelism`` at a time; ``keeps`` has a folder for each."""
    spark = data.train.sparkSession
    rows = round(data.train_rows * (FOLDS - 1) / FOLDS)

    def searched(name: str) -> tuple[DataFrame, Candidate]:
        estimator, grid = search_space(name, rows)
        folder = keeps[name] or fresh_path(spark, "out-of-fold")

        def tried(fold: int, served: list[int]) -> list[tuple[int, int, float]]:
            train, held = staged_fold(data, fold)
            model, found = estimator.fit(train, grid[served[0]]), []
            for at in served:
                of_setting = model if at == served[0] else first_rounds(model, grid[at][estimator.maxIter])
                scored, path = scored_with(of_setting, held, name, data.carry[0]), f"{folder}/fold={fold}/setting={at}"
                scored.write.mode("overwrite").parquet(path)
                found.append((fold, at, exact_auc("score").evaluate(spark.read.schema(scored.schema).parquet(path))))
            return found

        fits = [fits_pool.submit(tried, fold, served) for fold in range(FOLDS) for served in served_settings(name, estimator, grid)]
        found = np.empty((FOLDS, len(grid)))
        for fit in fits:
            for fold, at, auc in fit.result():
                found[fold, at] = auc
        means, deviations = found.mean(axis=0).tolist(), found.std(axis=0).tolist()
        settings = [describe_settings(name, i) for i in range(len(grid))]
        best = max(range(len(grid)), key=lambda i: (means[i], -i))
        # The winner is fitted on all training rows; a strength per row follows their number.
        chosen = search_space(name, data.train_rows)
        model = fits_pool.submit(chosen[0].fit, data.train, chosen[1][best]).result()
        table = spark.createDataFrame(
            list(zip([name] * len(grid), settings, means, deviations)), "model string, settings string, mean_roc_auc double, std_roc_auc double"
        )
        folds = tuple(tuple(row) for row in found.tolist())
        return table, Candidate(name, model, settings[best], means[best], deviations[best], folds, keeps[name])

    names = sorted(keeps, key=MODEL_NAMES.index, reverse=True)  # the longest chains of jobs begin first
    with ThreadPoolExecutor(parallelism or fits_at_once(data)) as fits_pool, ThreadPoolExecutor(len(names) or 1) as pool:
        return dict(zip(names, pool.map(searched, names)))


def out_of_fold(candidate: Candidate, spark: SparkSession) -> DataFrame:
    """(model, fold, setting, positives, negatives, agrees): the kept scores ranked anew against the search's own figures."""
    again = ranking_summary(spark.read.parquet(candidate.kept), "score", "label", ["model", "fold", "setting"])
    told = [(fold, setting, auc) for fold, row in enumerate(candidate.fold_auc) for setting, auc in enumerate(row)]
    figures = spark.createDataFrame(told, "fold int, setting int, told double")
    agrees = F.abs(F.col("roc_auc") - F.col("told")) <= 10.0**-DIGITS
    return again.join(figures, ["fold", "setting"]).select("model", "fold", "setting", "positives", "negatives", agrees.alias("agrees"))


def describe_settings(name: str, index: int) -> str:
    if name == MODEL_NAMES[0]:
        return f"C={C_GRID[index]}"
    if name == MODEL_NAMES[1]:
        return f"depth={DEPTH_GRID[index]}"
    if name == MODEL_NAMES[2]:
        return "trees={}, depth={}".format(*FOREST_GRID[index])
    return "rounds={}, rate={}".format(*BOOST_GRID[index])


def scored_with(model: Model, rows: DataFrame, name: str, key: str) -> DataFrame:
    """(model, key, label, score): the positive class is index 1 of the 0/1 label."""
    return model.transform(rows).select(
        F.lit(name).alias("model"),
        key,
        F.col("label").cast("int").alias("label"),
        vector_to_array("probability").getItem(1).alias("score"),
    )


def score_models(models: dict[str, Model], rows: DataFrame, key: str) -> DataFrame:
    """All models over the same rows, staged once for every later metric."""
    union = None
    for name, model in models.items():
        part = scored_with(model, rows, name, key)
        union = part if union is None else union.unionByName(part)
    return stage(union, "model-scores")


def test_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return model_metrics(scored, "score", "label", threshold, ["model"])


def train_legacy(data: PreparedData, key: str) -> tuple[DataFrame, DataFrame, dict[str, Model]]:
    """Fit the four fixed classifiers; (metrics to 4 digits, champion by F1, models).

    Names are listed in the order they are tried, so a tie on F1 keeps the first.
    They are fitted at the same time, as each waits for one small job after the other.
    """
    estimators = legacy_estimators(data.train_rows)
    with ThreadPoolExecutor(len(estimators)) as pool:
        models = dict(zip(estimators, pool.map(lambda estimator: estimator.fit(data.train), estimators.values())))
    metrics = test_metrics(score_models(models, data.test, key))
    rounded = stage(metrics.select("model", *[F.round(c, 4).alias(c) for c in metrics.columns if c != "model"]), "metrics")
    order = F.lit(0)
    for i, name in enumerate(models):
        order = F.when(F.col("model") == name, i).otherwise(order)
    best = rounded.orderBy(F.col("f1").desc(), order).limit(1)
    return rounded, best, models


def experiment_record(data: PreparedData, candidates: Sequence[Candidate], key: str) -> tuple[DataFrame, Candidate]:
    """One row per classifier: settings, cross-validated score, test metrics, champion flag.

    The champion is chosen on the cross-validated score; test rows are scored once, afterwards.
    """
    spark = data.train.sparkSession
    scores = spark.createDataFrame(
        [(c.name, c.settings, c.mean_auc, c.std_auc) for c in candidates],
        "model string, settings string, mean_roc_auc double, std_roc_auc double",
    )
    chosen = select_champion(scores).first()["model"]
    metrics = test_metrics(score_models({c.name: c.model for c in candidates}, data.test, key))
    record = scores.join(metrics, "model").withColumn("champion", F.col("model") == chosen)
    return record, next(c for c in candidates if c.name == chosen)


def select_champion(candidates: DataFrame) -> DataFrame:
    """Highest mean cross-validated ROC-AUC; the test rows take no part."""
    return champion(candidates, "mean_roc_auc")


def feature_importance(model: Model, features: Sequence[Feature], spark: SparkSession) -> DataFrame:
    """(feature, importance): tree importance, or the magnitude of the coefficient."""
    values = model.coefficients if isinstance(model, LogisticRegressionModel) else model.featureImportances
    numbers = [abs(float(v)) for v in values.toArray()]
    if len(numbers) != len(features):
        raise ValueError(f"model has {len(numbers)} inputs, dictionary has {len(features)}")
    return spark.createDataFrame([(f.name, n) for f, n in zip(features, numbers)], "feature string, importance double")


def top_features(importance: DataFrame, top: int) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(top)


def frozen_scorecard(
    model: LogisticRegressionModel, data: PreparedData, version: str, threshold: float = 0.5
) -> Scorecard:
    """A fitted logistic model as an open scorecard, so it can be bundled, explained and compared."""
    numerics = [f.raw for f in data.features if f.level is None]
    kept: dict[str, list[str]] = {}
    for f in data.features:
        if f.level is not None:
            kept.setdefault(f.raw, []).append(f.level)
    return Scorecard(
        version=version,
        intercept=float(model.intercept),
        numerics=tuple(numerics),
        means={name: float(data.fitted.means[name]) for name in numerics},
        deviations={name: float(data.fitted.deviations[name] or 1.0) for name in numerics},
        levels={name: tuple(levels) for name, levels in kept.items()},
        weights={f.name: float(w) for f, w in zip(data.features, model.coefficients.toArray())},
        drop_first=False,
        threshold=threshold,
    )


def score_with_trained(
    df: DataFrame, spec: ContractSpec, fitted: FittedPreparation, model: Model, key: str, threshold: float = 0.5, carry: Sequence[str] = (), drop_first: bool = False
) -> DataFrame:
    """Contract, preparation and a fitted classifier of any kind, as a bundle holds them: probability, percentage and label.

    ``carry`` names columns to keep beside the key, among them ``features``, the assembled inputs.
    """
    clean = accepted(df, spec, [key])
    features = feature_list(tuple(fitted.means), fitted.levels, drop_first)
    rows = assemble(clean, fitted, features, [key])
    probability = model_probability("probability", [0, 1])
    scored = model.transform(rows).select(key, *carry, probability.alias(PROBABILITY))
    return scored.withColumns(
        {
            "churn_pct": probability_percent(F.col(PROBABILITY)),
            "prediction": decide(F.col(PROBABILITY), threshold),
        }
    )


def score_with_model(
    df: DataFrame, spec: ContractSpec, data: PreparedData, model: Model, key: str, threshold: float = 0.5
) -> DataFrame:
    """The same with what :func:`prepare` has learned."""
    whole = [f.name for f in feature_list(data.numerics, data.fitted.levels, False)]
    drop_first = [f.name for f in data.features] != whole
    return score_with_trained(df, spec, data.fitted, model, key, threshold, drop_first=drop_first)

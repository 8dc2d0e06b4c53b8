"""Classifiers: four MLlib pipelines on one prepared table, comparison, folds, hold-out test.

The preparation (imputer, assembler, scaler) and the classifier form one PipelineModel, so a saved
model carries its features and scaling.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from mailsift import fixed
from mailsift.operators import metrics, prep
from mailsift.operators.forest import DeepForest
from mailsift.session import ROWS_PER_PARTITION, cut_lineage, keep, spread, written

FEATURES = "scaled"


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed,
                            DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose dot products approach the RBF kernel exp(-gamma |x-y|^2)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "number of cosines", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, width=256, seed=fixed.SEED):
        super().__init__()
        self._setDefault(gamma=1.0, width=256, seed=fixed.SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, width, seed = self.getOrDefault("gamma"), self.getOrDefault("width"), self.getSeed()

        @F.arrow_udf("array<double>")
        def cosines(x: pa.Array) -> pa.Array:
            n = len(x)
            if not n:
                return pa.array([], pa.list_(pa.float64()))
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            rng = np.random.RandomState(seed)
            w = rng.normal(0.0, math.sqrt(2.0 * gamma), (rows.shape[1], width))
            b = rng.uniform(0.0, 2.0 * math.pi, width)
            out = math.sqrt(2.0 / width) * np.cos(rows @ w + b)
            return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), out.ravel())

        return dataset.withColumn(
            self.getOutputCol(), array_to_vector(cosines(vector_to_array(F.col(self.getInputCol())))))


class FeatureProfile(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Says which features a pipeline was trained with; rows pass unchanged if they have them."""

    profile = Param(Params._dummy(), "profile", "feature profile", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "features in order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, profile=None, columns=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def getProfile(self) -> str:
        return self.getOrDefault(self.profile)

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        absent = [c for c in self.getColumns() if c not in dataset.columns]
        if absent:
            raise ValueError(f"the rows lack {absent}")
        return dataset


def preparation(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Mean imputation, one vector, zero mean and unit population deviation: fitted on ``train``."""
    n = train.count()
    filled = [f"{c}_filled" for c in columns]
    stages = [
        Imputer(inputCols=columns, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=filled, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="unit", withMean=True, withStd=True),
        # MLlib divides by the sample deviation
        ElementwiseProduct(inputCol="unit", outputCol=FEATURES,
                           scalingVec=Vectors.dense([math.sqrt(n / max(n - 1, 1))] * len(columns))),
    ]
    return Pipeline(stages=stages).fit(as_double(train, columns))


def as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def kernel_width(df: DataFrame) -> float:
    """1 / (features x variance of all matrix entries)."""
    entry = df.select(F.size(vector_to_array(F.col(FEATURES))).alias("d"), F.explode(vector_to_array(F.col(FEATURES))).alias("v"))
    r = entry.agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).head()
    return 1.0 / (r["d"] * r["v"]) if r["v"] else 1.0


def logistic_regression(df: DataFrame, n: int) -> list:
    return [LogisticRegression(featuresCol=FEATURES, regParam=1.0 / n, elasticNetParam=0.0,
                               standardization=False, maxIter=1000, tol=1e-8)]


def rbf_svm(df: DataFrame, n: int) -> list:
    """Linear machine on random cosine features, probabilities by a logistic curve on the margin."""
    return [
        RandomFourierFeatures(inputCol=FEATURES, outputCol="cosines", gamma=kernel_width(df)),
        LinearSVC(featuresCol="cosines", rawPredictionCol="margin", regParam=1.0 / n, maxIter=100),
        LogisticRegression(featuresCol="margin", predictionCol="calibrated", rawPredictionCol="logit",
                           regParam=1e-6, standardization=False, maxIter=100),
    ]


def random_forest(df: DataFrame, n: int) -> list:
    """100 trees of up to 30 levels; on large tables their lower levels are grown leaf by leaf, apart from the driver."""
    return [DeepForest(FEATURES, n)]


def boosted_trees(df: DataFrame, n: int) -> list:
    return [GBTClassifier(featuresCol=FEATURES, maxIter=100, stepSize=0.1, maxDepth=6, seed=fixed.SEED)]


REGISTRY = {
    "Logistic Regression": logistic_regression,
    "SVM": rbf_svm,
    "Random Forest": random_forest,
    "Boosted Trees": boosted_trees,
}


def fit_classifier(name: str, train: DataFrame) -> PipelineModel:
    """``train`` has the scaled vector and a numeric label, and is best cached.

    What a stage after a fitted one reads is a narrow table, held while it is fitted: its passes do not go through the
    stages before it again.
    """
    n = train.count()
    stages: list[Estimator] = REGISTRY[name](train, n)
    fitted, rows, held = [], train, []
    for i, stage in enumerate(stages):
        learns = isinstance(stage, Estimator)
        if learns and any(isinstance(s, Estimator) for s in stages[:i]):
            rows = keep(rows.select("label", stage.getFeaturesCol()))
            held.append(rows)
        fitted.append(stage.fit(rows) if learns else stage)
        if i + 1 < len(stages):
            rows = fitted[-1].transform(rows)
    for rows in held:
        rows.unpersist()
    return PipelineModel(stages=fitted)


def predict(model: PipelineModel, df: DataFrame, name: str, key: str = "email_id") -> DataFrame:
    return model.transform(df).select(
        key, F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"))


class Prepared:
    """Split, scaled and (below the gate) balanced tables, ready for any number of fits."""

    def __init__(self, df: DataFrame, columns: list[str], shares: dict[str, float] | None = None,
                 balance: bool = True, key: str = "email_id", profile: str = "app"):
        shares = shares or {"train": 0.70, "val": 0.15, "test": 0.15}
        self.columns, self.key, self.profile, self.balance = prep_columns(df, columns), key, profile, balance
        slim = df.select(key, F.col("label").cast("double").alias("label"), *self.columns)
        # The split is used by many fits: stored once, not derived again for each of them.
        self.rows = slim.count()
        split = prep.stratified_split(as_double(slim, self.columns), shares, key=key)
        self.split = cut_lineage(spread(split, key, self.rows))
        raw_train = self.split.where("split = 'train'")
        self.preparation = preparation(raw_train, self.columns)
        scaled = self.preparation.transform(self.split).select(key, "label", "split", FEATURES)
        self.scaled = keep(scaled)

    @cached_property
    def train(self) -> DataFrame:
        """Scaled (and balanced) training rows, made when they are first asked for: folds balance their own."""
        part = self.part("train")
        return cut_lineage(self.spread_out(self.balanced(part) if self.balance else part, self.rows))

    def balanced(self, train: DataFrame) -> DataFrame:
        """Scaled rows with synthetic ones of the smaller class, below the gate."""
        both = prep.balance_by_synthesis(train.withColumn("x", vector_to_array(FEATURES)), "x", key=self.key)
        return both.withColumn(FEATURES, array_to_vector("x")).drop("x")

    def spread_out(self, train: DataFrame, rows: int) -> DataFrame:
        """Even partitions by key and features: synthetic rows of one mail share its key, but not their place."""
        return spread(train.withColumn("_deal", F.xxhash64(self.key, vector_to_array(FEATURES))), "_deal", rows).drop("_deal")

    def part(self, name: str) -> DataFrame:
        return self.scaled.where(F.col("split") == name).select(self.key, "label", FEATURES)

    def pipeline(self, classifier: PipelineModel) -> PipelineModel:
        """Feature list, preparation and classifier as one saveable model."""
        carried = FeatureProfile(profile=self.profile, columns=self.columns)
        return PipelineModel(stages=[carried, *self.preparation.stages, *classifier.stages])


def prep_columns(df: DataFrame, columns: list[str]) -> list[str]:
    from mailsift.operators.cleaning import choose_features
    return choose_features(df, columns)


def train_suite(data: Prepared, names: list[str] | None = None, on: str = "val") -> tuple[dict, DataFrame]:
    """Fitted classifiers and their predictions on one part; unknown names are left out."""
    models, found = {}, None
    for name in names or list(REGISTRY):
        if name not in REGISTRY:
            continue
        models[name] = fit_classifier(name, data.train)
        rows = predict(models[name], data.part(on), name, data.key)
        found = rows if found is None else found.unionByName(rows)
    return models, found


def best_model(table: DataFrame, names: list[str], metric: str = "f1") -> str:
    """Highest metric, the first trained on ties (the table has one row per model)."""
    rank = {n: i for i, n in enumerate(names)}
    rows = table.select("model", metric).collect()
    return min(rows, key=lambda r: (-r[metric], rank[r["model"]]))["model"]


#: Fits that run side by side; they share the cores, so each has as many fewer partitions.
PARALLEL_FITS = 8


def fold_predictions(data: Prepared, names: list[str], folds: int = 5, balance: bool = True) -> DataFrame:
    """(key, model, label, prediction, probability, fold) of every training row by the models of the other folds.

    Imputation, scaling and synthetic rows come from the other folds alone, so no test fold holds a
    synthetic row. Folds are prepared side by side and stored, then all models of all folds are fitted side by side; each
    prediction is written once, so nothing is fitted or scored again by what reads them.
    """
    spark = data.split.sparkSession
    raw = data.split.where("split = 'train'").drop("split")
    rows = written(prep.stratified_folds(raw, folds, key=data.key), "folds")
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    parts = max(-(-cores // PARALLEL_FITS), -(-n // ROWS_PER_PARTITION))
    columns = [data.key, "label", FEATURES]

    def prepared(fold: int) -> tuple[DataFrame, DataFrame]:
        rest = rows.where(F.col("fold") != fold).drop("fold")
        ready = preparation(rest, data.columns)
        train = ready.transform(rest).select(columns)
        train = data.balanced(train) if balance else train
        dealt = train.repartition(parts, data.key, F.xxhash64(vector_to_array(FEATURES)))
        test = ready.transform(rows.where(F.col("fold") == fold)).select(columns)
        return keep(written(dealt.select(columns), "fold-train").coalesce(parts)), written(test, "fold-test")

    def predicted(job: tuple[int, str]) -> DataFrame:
        fold, name = job
        train, test = ready[fold]
        return written(predict(fit_classifier(name, train), test, name, data.key).withColumn("fold", F.lit(fold)), "fold-scores")

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        ready = list(pool.map(prepared, range(folds)))
        # The longest fits begin first.
        order = sorted(names, key=list(REGISTRY).index, reverse=True)
        found = list(pool.map(predicted, [(fold, name) for name in order for fold in range(folds)]))
    for train, _ in ready:
        train.unpersist()
    return reduce(DataFrame.unionByName, found)


def cross_validate(data: Prepared, names: list[str], folds: int = 5, balance: bool = True) -> DataFrame:
    """(model, mean, spread): weighted F1 over folds of the training part, spread = 2 population deviations.

    All fold predictions are stacked and measured in one aggregate.
    """
    scores = metrics.weighted_metrics(fold_predictions(data, names, folds, balance), ["model", "fold"])
    return scores.groupBy("model").agg(
        F.avg("f1").alias("mean"), (2 * F.stddev_pop("f1")).alias("spread"))


def feature_importance(model: PipelineModel, columns: list[str], spark, top: int = 10) -> DataFrame:
    """Top features of a fitted tree model (one row per feature at most)."""
    weights = next(s.featureImportances.toArray() for s in model.stages if hasattr(s, "featureImportances"))
    rows = sorted(zip(columns, map(float, weights)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(
        [(i + 1, f, w) for i, (f, w) in enumerate(rows)], "rank int, feature string, importance double")

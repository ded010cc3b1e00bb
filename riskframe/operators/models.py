"""Spark ML training and scoring.

Models are ``pyspark.ml`` Pipelines (assembler + scaler + estimator) fit on one cached,
assembled frame; class balance enters as a weight column (I06), never by resampling the
majority class away.  Evaluation reuses the exact metric operators (M01-M05).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.sampling import attach_class_weights

#: Node numbers, one a row and tree, that a forest keeps at most; they spare a walk from the root per row, tree and
#: level, and the trees are the same.  A number takes four bytes, in some copies.
NODE_NUMBERS = 250_000_000

ESTIMATORS = {
    # L2, balanced weights, 1000 iterations
    "logistic_regression": lambda **kw: LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=kw.get("max_iter", 1000),
        regParam=kw.get("reg", 0.01), elasticNetParam=0.0, standardization=False),
    # 200 trees of depth 15, balanced
    "random_forest": lambda **kw: RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=kw.get("trees", 200),
        maxDepth=kw.get("depth", 15), seed=42, maxMemoryInMB=1024,
        cacheNodeIds=kw.get("rows", 0) * kw.get("trees", 200) <= NODE_NUMBERS),
    # Boosted trees (200 x depth 6, step .1, subsample .8)
    "boosted": lambda **kw: GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=kw.get("trees", 200),
        maxDepth=kw.get("depth", 6), stepSize=0.1, subsamplingRate=0.8, seed=42, maxMemoryInMB=1024),
}


#: Rows of a training task, at least and at most: every tree level or gradient step is a job over all tasks, and
#: the points of a task stay in its executor's storage.
TRAIN_ROWS, MOST_ROWS = 10_000, 1_000_000


def training_tasks(n: int, cores: int, least: int = TRAIN_ROWS) -> int:
    """Tasks for ``n`` rows: one a core, fewer if they would have less than ``least`` rows, more if over ``MOST_ROWS``.

    A forest sends the statistics of every open node from each task, so more tasks than needed are work on their own.
    """
    return max(1, min(cores, -(-n // least)), -(-n // MOST_ROWS))


def packed(df: DataFrame, n: int, least: int = TRAIN_ROWS, scanned: bool = False) -> DataFrame:
    """``df`` with its ``n`` rows dealt evenly over ``training_tasks``, whatever the files that it was read from.

    More than ``MOST_ROWS`` rows of a written table (``scanned``) are read by more tasks than that, each of one split; these are
    put together and not shuffled, because every fit's shuffle files are a copy of its rows on disk.
    """
    tasks = training_tasks(n, df.sparkSession.sparkContext.defaultParallelism, least)
    return df.coalesce(tasks) if scanned and n > MOST_ROWS else df.repartition(tasks)


def build_estimator(kind: str, **kw):
    """Model factory: unknown type raises."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model type {kind!r}")
    return ESTIMATORS[kind](**kw)


def train(train_df: DataFrame, features: list[str], kind: str, label: str = "Class", scanned: bool = False, **kw) -> PipelineModel:
    """Fit assembler -> standard scaler -> estimator with balanced class weights; ``scanned``: ``train_df`` is read from a written table."""
    x = attach_class_weights(train_df, label).withColumn("label", F.col(label).cast("double"))
    n = x.count()
    if kind == "logistic_regression" and "reg" not in kw:
        # 1 / (C * sum of weights); balanced weights add up to the number of rows
        kw["reg"] = 1.0 / (kw.pop("C", 1.0) * max(n, 1))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            build_estimator(kind, rows=n, **kw)])
    return pipe.fit(packed(x, n, scanned=scanned))


def score(model: PipelineModel, df: DataFrame, id_col: str = "event_id", label: str = "Class") -> DataFrame:
    """p = probability of the positive class, pred, plus the label when present."""
    out = model.transform(df)
    cols = [id_col] + ([F.col(label).alias("y")] if label in df.columns else [])
    return out.select(*cols, vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("pred"))


def cluster_transactions(df: DataFrame, k: int = 10, seed: int = 42,
                         cols: tuple = ("Amount", "Time", "V1", "V2", "V3", "V4", "V5")) -> PipelineModel:
    """Standardise Amount, Time, V1..V5 and fit k-means (k = 10, seed 42)."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed)])
    return pipe.fit(df)


def cluster_assign(model: PipelineModel, df: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored cluster model + the cluster -> category table (k rows, broadcast)."""
    return model.transform(df).join(F.broadcast(labels.select("cluster", "merchant_category")), "cluster", "left")

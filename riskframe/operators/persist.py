"""Saved models with their metadata.

A model is a folder with Spark ML's own files and a one-row metadata table; the folder
lies in storage that all executors share.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskframe.session import checkpoint_dir

METADATA = "name string, model_type string, features array<string>, stages array<string>, details string"


def save_model(model: PipelineModel, path: str, name: str, model_type: str, features: list[str], **details) -> None:
    """Write a fitted pipeline and its metadata; an older one at the same path is replaced."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    row = (name, model_type, list(features), [type(s).__name__ for s in model.stages], json.dumps(details, sort_keys=True))
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).parquet(f"{path}/metadata")


def exists(spark: SparkSession, path: str) -> bool:
    """The metadata is written last, so a model that has it is whole."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def stored(spark: SparkSession, sf_dir: str, name: str, model_type: str, features: list[str], fit: Callable[[], PipelineModel], **details) -> PipelineModel:
    """The model of this name for this folder of tables; fitted and saved on first use, loaded from then on."""
    path = model_path(spark, sf_dir, name)
    if not exists(spark, path):
        model = fit()
        save_model(model, path, name, model_type, features, **details)
        return model
    return load_model(spark, path)


def model_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/models/{name}-{hashlib.md5(sf_dir.rstrip('/').encode()).hexdigest()[:12]}"

"""Sinks. Every writer is distributed and returns the written data read back."""

from __future__ import annotations

import json

from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_scores(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_model(spark: SparkSession, path: str, params: dict, model: Transformer | None = None) -> None:
    """Parameters (columns, idf, components, threshold) as one JSON row, a Spark model beside it."""
    spark.createDataFrame([(json.dumps(params),)], "params string").write.mode("overwrite").json(f"{path}/params")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


def load_model(spark: SparkSession, path: str, with_model: bool = False) -> tuple[dict, LogisticRegressionModel | None]:
    params = json.loads(spark.read.schema("params string").json(f"{path}/params").first()["params"])
    return params, LogisticRegressionModel.load(f"{path}/model") if with_model else None

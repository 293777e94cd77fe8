"""Model artifacts and evaluation results on shared storage."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.detectors.iforest import IsolationForest
from flowguard.detectors.ocsvm import OneClassSVM
from flowguard.detectors.vae import VAE
from flowguard.operators.ensemble import EnsembleParams
from flowguard.operators.normalise import NormalizationParams
from flowguard.operators.prep import ScalerParams
from flowguard.plans.training import DetectorModel

# Artifact names and the fields that must be present.
SCALER_JSON, BOUNDS_JSON, ENSEMBLE_JSON = "scaler.json", "normalization_params.json", "ensemble_config.json"
REQUIRED = {
    SCALER_JSON: ["mean", "scale", "feature_names", "n_features", "log_transformed_columns", "dropped_mi_columns"],
    BOUNDS_JSON: [
        "isolation_forest.p1", "isolation_forest.p99", "autoencoder.score_min", "autoencoder.score_max",
        "one_class_svm.score_min", "one_class_svm.score_max",
    ],
    ENSEMBLE_JSON: ["type", "n_models", "coefficients", "intercept", "threshold", "model_names", "optimized"],
}


def read_config(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One JSON document with a strict schema; malformed text, wrong types or missing fields are errors."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/{name}")
        row = rows.first()
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError(f"cannot read {name}") from e
    if row is None:
        raise ValueError(f"{name} is empty")
    for path in REQUIRED[name]:
        value = row
        for part in path.split("."):
            value = None if value is None else value[part]
        if value is None:
            raise ValueError(f"{name}: {path} is missing")
    return rows


def load_configs(spark: SparkSession, folder: str) -> tuple[ScalerParams, NormalizationParams, EnsembleParams]:
    """Scaler, normalisation bounds and ensemble parameters."""
    return (
        ScalerParams.from_df(read_config(spark, folder, SCALER_JSON, ScalerParams.SCHEMA)),
        NormalizationParams.from_df(read_config(spark, folder, BOUNDS_JSON, NormalizationParams.SCHEMA)),
        EnsembleParams.from_df(read_config(spark, folder, ENSEMBLE_JSON, EnsembleParams.SCHEMA)),
    )


def load_artifacts(spark: SparkSession, folder: str) -> DetectorModel:
    scaler, bounds, ensemble = load_configs(spark, folder)
    nodes = spark.read.parquet(f"{folder}/isolation_forest.parquet")
    rows = nodes.filter("node = 0").agg(F.max("size")).first()[0]
    forest = IsolationForest.from_df(nodes, scaler.feature_names, rows)
    svm = OneClassSVM.from_df(spark.read.parquet(f"{folder}/one_class_svm.parquet"))
    vae = VAE.from_df(spark.read.parquet(f"{folder}/autoencoder.parquet"))
    return DetectorModel(scaler, forest, svm, vae, bounds, ensemble)


def _write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def save_artifacts(spark: SparkSession, model: DetectorModel, folder: str) -> None:
    """Three JSON documents and three parquet tables."""
    _write_json(model.scaler.to_df(spark), f"{folder}/{SCALER_JSON}")
    _write_json(model.bounds.to_df(spark), f"{folder}/{BOUNDS_JSON}")
    _write_json(model.ensemble.to_df(spark), f"{folder}/{ENSEMBLE_JSON}")
    model.forest.to_df(spark).write.mode("overwrite").parquet(f"{folder}/isolation_forest.parquet")
    model.svm.to_df(spark).write.mode("overwrite").parquet(f"{folder}/one_class_svm.parquet")
    model.vae.to_df(spark).write.mode("overwrite").parquet(f"{folder}/autoencoder.parquet")


def save_metrics(overall: DataFrame, per_type: DataFrame, seconds: float, path: str) -> None:
    """Overall metrics, a map of per-type results and the elapsed time as one JSON document."""
    types = per_type.agg(
        F.map_from_entries(
            F.collect_list(F.struct("attack_type", F.struct("count", "detected", "recall")))
        ).alias("per_attack_type")
    )
    one = overall.withColumn("_k", F.lit(1)).join(types.withColumn("_k", F.lit(1)), "_k").drop("_k")
    _write_json(one.withColumn("training_time_seconds", F.lit(float(seconds))), path)


def write_detections(detections: DataFrame, path: str) -> None:
    """Append classified flows, partitioned by the decision."""
    detections.write.mode("append").partitionBy("is_attack").parquet(path)

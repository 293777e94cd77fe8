"""Artifacts written by one job and read by another."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.operators import metrics as mt, prep as pp
from flowguard.plans.catalog.evaluation import COUNTS, scored
from flowguard.plans.catalog.preparation import SCALE_COLS, SCALER, split
from flowguard.plans.registry import query
from flowguard.sources import artifacts as ar
from flowguard.streaming.runs import run_folder


@query("load_artifacts", SCALER + "SELECT row_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in SCALE_COLS) + " FROM split, sc")
def load_artifacts(spark, sf):
    rows = split(spark, sf)
    folder = run_folder(spark)
    fitted = pp.fit_scaler(rows.filter("split = 'train'"), SCALE_COLS)
    fitted.to_df(spark).coalesce(1).write.json(f"{folder}/{ar.SCALER_JSON}")
    stored = pp.ScalerParams.from_df(ar.read_config(spark, folder, ar.SCALER_JSON, pp.ScalerParams.SCHEMA))
    out = pp.apply_scaler(rows, stored)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in SCALE_COLS])


@query(
    "save_metrics",
    COUNTS
    + """, t AS (SELECT attack_type, count(*) AS n, count(*) FILTER (CASE WHEN attack_type='Benign' THEN pred=0 ELSE pred=1 END) AS hit FROM scored GROUP BY attack_type)
SELECT attack_type, n AS count, hit AS detected, round((tp+tn)/(tp+fp+fn+tn), 9) AS accuracy, 1.5::DOUBLE AS training_time_seconds FROM t, c""",
)
def save_metrics(spark, sf):
    rows = scored(spark, sf)
    path = f"{run_folder(spark)}/metrics"
    ar.save_metrics(mt.binary_metrics(rows), mt.per_type_recall(rows), 1.5, path)
    schema = "accuracy double, training_time_seconds double, per_attack_type map<string, struct<count:bigint,detected:bigint,recall:double>>"
    stored = spark.read.schema(schema).json(path)
    return stored.select(F.explode("per_attack_type").alias("attack_type", "v"), "accuracy", "training_time_seconds").select(
        "attack_type", "v.count", "v.detected", F.round("accuracy", 9).alias("accuracy"), "training_time_seconds"
    )

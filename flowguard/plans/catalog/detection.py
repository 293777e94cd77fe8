"""Packets to alerts with a model of fixed weights, so that SQL can say every score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowguard.detectors.iforest import IsolationForest, average_path
from flowguard.detectors.ocsvm import OneClassSVM, cosine_map
from flowguard.detectors.vae import BN_EPSILON, KL_WEIGHT, SLOPE, VAE
from flowguard.fixtures import spark_view
from flowguard.operators.ensemble import EnsembleParams
from flowguard.operators.flows import FEATURE_NAMES
from flowguard.operators.normalise import NormalizationParams
from flowguard.operators.prep import ScalerParams
from flowguard.plans import detection as de
from flowguard.plans.catalog.flows import FEATURE_IDENT, FLOWS, IDENT, IS_CLOSED, features_sql
from flowguard.plans.catalog.monitoring import ALERT
from flowguard.plans.catalog.streams import capture_end, stream_view
from flowguard.plans.registry import query
from flowguard.plans.training import DetectorModel, with_raw_scores
from flowguard.streaming.runs import drain_to_end, read_detections, run_folder, write_detections_stream

DIM = len(FEATURE_NAMES)
PLAIN = ["Protocol", "Down/Up Ratio"]  # not logged
FLAT = FEATURE_NAMES.index("URG Flag Count")  # its scale vanishes, so it counts as 0


def rule(shape: tuple[int, ...], shift: float, size: float) -> np.ndarray:
    """Stand-in weights: a sine over the position."""
    return size * np.sin(np.arange(int(np.prod(shape)), dtype=np.float64) * 0.7 + shift).reshape(shape)


def stand_in_scaler() -> ScalerParams:
    scale = [0.0 if i == FLAT else 4.0 for i in range(DIM)]
    return ScalerParams([5.0] * DIM, scale, list(FEATURE_NAMES), [c for c in FEATURE_NAMES if c not in PLAIN], [])


NODES = pd.DataFrame(
    [
        (0, 0, FEATURE_NAMES.index("Flow Duration"), 2.6, 1, 2, 8, 0), (0, 1, -1, 0.0, -1, -1, 3, 1),
        (0, 2, FEATURE_NAMES.index("Total Fwd Packets"), -0.7, 3, 4, 5, 1), (0, 3, -1, 0.0, -1, -1, 4, 2), (0, 4, -1, 0.0, -1, -1, 1, 2),
        (1, 0, FEATURE_NAMES.index("Packet Length Mean"), 0.3, 1, 2, 8, 0), (1, 1, -1, 0.0, -1, -1, 6, 1), (1, 2, -1, 0.0, -1, -1, 2, 1),
    ],
    columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"],
)
SVM = OneClassSVM(list(FEATURE_NAMES), 0.002, 6, 7, rule((6,), 0.3, 0.8), 0.1)
_LAYERS = {"e1": (DIM, 4), "e2": (4, 3), "mu": (3, 2), "lv": (3, 2), "d1": (5, 3), "d2": (7, 4), "out": (4, DIM)}
_PARAMS: dict[str, np.ndarray] = {}
_MOMENTS: dict[str, np.ndarray] = {}
for _no, (_name, _shape) in enumerate(_LAYERS.items()):
    _PARAMS[f"{_name}.w"], _PARAMS[f"{_name}.b"] = rule(_shape, 0.1 * _no, 0.4), rule(_shape[1:], 0.5 + _no, 0.2)
    if _name in ("e1", "e2", "d1", "d2"):
        _PARAMS[f"{_name}.g"], _PARAMS[f"{_name}.s"] = 1.0 + rule(_shape[1:], 1.0 + _no, 0.1), rule(_shape[1:], 2.0 + _no, 0.1)
        _MOMENTS[f"{_name}.mean"], _MOMENTS[f"{_name}.var"] = rule(_shape[1:], 3.0 + _no, 0.3), 1.0 + rule(_shape[1:], 4.0 + _no, 0.5)
AUTOENCODER = VAE(list(FEATURE_NAMES), _PARAMS, _MOMENTS)
MODEL = DetectorModel(
    stand_in_scaler(), IsolationForest(list(FEATURE_NAMES), NODES, 8), SVM, AUTOENCODER,
    NormalizationParams(-0.62, -0.46, 1.5, 3.7, -0.75, 0.25), EnsembleParams([1.5, 2.5, 1.0], -2.6, 0.68),
)


def lit(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def product(columns: list[str], weights: np.ndarray, bias: float) -> str:
    return "(" + " + ".join([f"{c} * {lit(w)}" for c, w in zip(columns, weights, strict=True)] + [lit(bias)]) + ")"


def _dense(name: str, columns: list[str]) -> list[str]:
    w, b = _PARAMS[f"{name}.w"], _PARAMS[f"{name}.b"]
    return [product(columns, w[:, j], b[j]) for j in range(w.shape[1])]


def _activated(name: str, columns: list[str]) -> list[str]:
    out = []
    for j, z in enumerate(_dense(name, columns)):
        scale = f"({lit(_PARAMS[f'{name}.g'][j])} / sqrt({lit(_MOMENTS[f'{name}.var'][j])} + {lit(np.float32(BN_EPSILON))}))"
        out.append(f"(({z} - {lit(_MOMENTS[f'{name}.mean'][j])}) * {scale} + {lit(_PARAMS[f'{name}.s'][j])})")
    return out


def _named(prefix: str, texts: list[str]) -> str:
    return ", ".join(f"{t} AS {prefix}{j}" for j, t in enumerate(texts))


def _leaky(prefix: str, n: int) -> str:
    return ", ".join(f"CASE WHEN {prefix}{j} > 0 THEN {prefix}{j} ELSE {lit(np.float32(SLOPE))} * {prefix}{j} END AS {prefix}{j}" for j in range(n))


def _names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(n)]


def _scaled_sql() -> str:
    out = []
    for i, c in enumerate(FEATURE_NAMES):
        x = f'"{c}"'
        x = x if c in PLAIN else f"sign({x}) * ln(1 + abs({x}))"
        out.append("0.0::DOUBLE" if i == FLAT else f"({x} - 5.0::DOUBLE) / 4.0::DOUBLE")
    return _named("x", out)


def vae_sql(source: str) -> str:
    """CTEs from scaled columns x0, x1, ... of ``source`` to ``ae`` with mse, kl and ae_raw."""
    x = _names("x", DIM)
    error = " + ".join(f"({r} - x{j}) * ({r} - x{j})" for j, r in enumerate(_dense("out", _names("v", 4))))
    kl = " + ".join(f"(1 + l{j} - m{j} * m{j} - exp(l{j}))" for j in range(2))
    return f"""
e1z AS (SELECT *, {_named("h", _activated("e1", x))} FROM {source}), e1 AS (SELECT * REPLACE ({_leaky("h", 4)}) FROM e1z),
e2z AS (SELECT *, {_named("g", _activated("e2", _names("h", 4)))} FROM e1), e2 AS (SELECT * REPLACE ({_leaky("g", 3)}) FROM e2z),
ml AS (SELECT *, {_named("m", _dense("mu", _names("g", 3)))}, {_named("l", _dense("lv", _names("g", 3)))} FROM e2),
d1z AS (SELECT *, {_named("u", _activated("d1", _names("m", 2) + _names("g", 3)))} FROM ml), d1 AS (SELECT * REPLACE ({_leaky("u", 3)}) FROM d1z),
d2z AS (SELECT *, {_named("v", _activated("d2", _names("u", 3) + _names("h", 4)))} FROM d1), d2 AS (SELECT * REPLACE ({_leaky("v", 4)}) FROM d2z),
ae AS (SELECT *, ({error}) / {DIM} AS mse, -0.5::DOUBLE * ({kl}) AS kl, mse + {lit(KL_WEIGHT)} * kl AS ae_raw FROM d2)"""


def svm_sql() -> str:
    w, b = cosine_map(DIM, SVM.gamma, SVM.map_size, SVM.seed)
    cosines = [f"cos({product(_names('x', DIM), w[:, j], b[j])}) * {lit(SVM.weights[j])}" for j in range(SVM.map_size)]
    return f"sqrt(2.0::DOUBLE / {SVM.map_size}) * ({' + '.join(cosines)}) - {lit(SVM.rho)}"


def _c(n: int) -> str:
    return lit(float(average_path(n)))


def forest_sql() -> str:
    duration, forward, length = (f"x{FEATURE_NAMES.index(n)}" for n in ("Flow Duration", "Total Fwd Packets", "Packet Length Mean"))
    first = f"CASE WHEN {duration} <= 2.6 THEN 1 + {_c(3)} WHEN {forward} <= -0.7 THEN 2 + {_c(4)} ELSE 2 + {_c(1)} END"
    second = f"CASE WHEN {length} <= 0.3 THEN 1 + {_c(6)} ELSE 1 + {_c(2)} END"
    return f"-pow(2, -(({first} + {second}) / 2) / {_c(8)})"


def clipped(value: str, span: float) -> str:
    return f"least(greatest(({value}) / {lit(span)}, 0.0::DOUBLE), 1.0::DOUBLE)"


_B, _E = MODEL.bounds, MODEL.ensemble
SCORED = (
    FLOWS
    + f""",
features AS (SELECT {FEATURE_IDENT}, n AS packets, {IS_CLOSED}, {features_sql()} FROM kept),
scaled AS (SELECT {IDENT.replace("protocol", "ip_protocol")}, packets, closed, {_scaled_sql()} FROM features),{vae_sql("scaled")},
raws AS (SELECT *, {forest_sql()} AS if_raw, {svm_sql()} AS svm_raw FROM ae),
scores AS (SELECT *, {clipped(f"{lit(_B.p99)} - if_raw", _B.p99 - _B.p1)} AS if_score, {clipped(f"ae_raw - {lit(_B.ae_min)}", _B.ae_max - _B.ae_min)} AS ae_score,
  {clipped(f"{lit(_B.svm_max)} - svm_raw", _B.svm_max - _B.svm_min)} AS svm_score FROM raws),
decided AS (SELECT *, 1 / (1 + exp(-(if_score * {lit(_E.coefficients[0])} + ae_score * {lit(_E.coefficients[1])} + svm_score * {lit(_E.coefficients[2])}
  + {lit(_E.intercept)}))) AS prob FROM scores),
det AS (SELECT *, prob >= {lit(_E.threshold)} AS is_attack, last_us + 120000000 AS close_us, ip_protocol AS protocol FROM decided)
"""
)
ROUNDED = ["if_raw", "ae_raw", "svm_raw", "if_score", "ae_score", "svm_score", "prob"]
DETECTION = ", ".join([IDENT.replace("protocol", "ip_protocol"), "closed", "packets", *[f"round({c}, 8) AS {c}" for c in ROUNDED], "is_attack"])


def rounded(found: DataFrame) -> DataFrame:
    return found.select(*de.IDENTITY, *[F.round(c, 8).alias(c) for c in ROUNDED], "is_attack")


@query("detect_flows", SCORED + f"SELECT {DETECTION} FROM det")
def detect_flows(spark, sf):
    return rounded(de.detect_flows(spark_view(spark, sf, "packets"), MODEL))


@query("detect_flows_stream", SCORED + f"SELECT {DETECTION} FROM det")
def detect_flows_streamed(spark, sf):
    end = capture_end(spark, sf)
    found = drain_to_end(stream_view(spark, sf, "packets"), lambda p: de.detect_flows_stream(p, MODEL, watermark="0 seconds", end_us=end))
    return rounded(found)


@query("detection_sink", SCORED + f"SELECT {DETECTION} FROM det")
def detection_sink(spark, sf):
    """Detections as the sink has recorded them: every flow with its scores."""
    end = capture_end(spark, sf)
    path = run_folder(spark)

    def build(packets):
        return de.detect_flows_stream(packets, MODEL, watermark="0 seconds", end_us=end)

    def run(found, folder):
        write_detections_stream(found, path, f"{folder}/checkpoint", available_now=True).awaitTermination()
        return read_detections(spark, path, found.schema)

    return rounded(drain_to_end(stream_view(spark, sf, "packets"), build, run))


@query("detect_alerts", SCORED + f"SELECT flow_id, {ALERT} AS message FROM det WHERE is_attack")
def detect_alerts(spark, sf):
    return de.alerts(de.detect_flows(spark_view(spark, sf, "packets"), MODEL)).select("flow_id", "message")


@query(
    "detect_sweeps_stream",
    SCORED
    + "SELECT CAST(floor(((last_us + 120000000) // 5000000 + 1) * 5000000 / 10000000) AS BIGINT) * 10000000 AS tick_us, count(*) AS expired, "
    "count(*) FILTER (NOT is_attack) AS benign, count(*) FILTER (is_attack) AS attacks FROM det GROUP BY 1",
)
def detect_sweeps_streamed(spark, sf):
    return drain_to_end(stream_view(spark, sf, "packets"), lambda p: de.sweeps_stream(p, MODEL, watermark="0 seconds"))


@query("ocsvm_score_fixed", SCORED + "SELECT flow_id, round(svm_raw, 8) AS svm_raw FROM det")
def ocsvm_score_fixed(spark, sf):
    found = de.detect_flows(spark_view(spark, sf, "packets"), MODEL)
    return found.select("flow_id", F.round("svm_raw", 8).alias("svm_raw"))


@query("vae_score_fixed", SCORED + "SELECT flow_id, round(ae_raw, 8) AS ae_raw, round(mse, 8) AS served FROM det")
def vae_score_fixed(spark, sf):
    """Score with and, as when serving, without the KL term."""
    from flowguard.operators.flows import features_of, flow_table
    from flowguard.operators.prep import transform_features

    ready = transform_features(features_of(flow_table(spark_view(spark, sf, "packets"))), MODEL.scaler, ["flow_id"])
    served = with_raw_scores(ready, MODEL.forest, MODEL.svm, MODEL.vae, mode="serve").withColumnRenamed("ae_raw", "served").drop("if_raw", "svm_raw")
    full = with_raw_scores(served, MODEL.forest, MODEL.svm, MODEL.vae)
    return full.select("flow_id", F.round("ae_raw", 8).alias("ae_raw"), F.round("served", 8).alias("served"))

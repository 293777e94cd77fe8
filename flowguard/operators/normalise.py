"""Calibration bounds and score normalisation of the three detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.stats import col
from flowguard.operators.quantiles import exact_percentiles

# Percentiles used for the bounds, smallest usable span, single-detector threshold.
FOREST_PERCENTILES = (1.0, 99.0)
VAE_TOP_PERCENTILE = 99.5
MIN_SPAN = 1e-10
SINGLE_THRESHOLD = 0.5


@dataclass
class NormalizationParams:
    """Bounds of raw training scores: forest p1/p99, autoencoder and SVM min/max."""

    p1: float
    p99: float
    ae_min: float
    ae_max: float
    svm_min: float
    svm_max: float

    SCHEMA = (
        "isolation_forest struct<p1:double,p99:double>, autoencoder struct<score_min:double,score_max:double>, "
        "one_class_svm struct<score_min:double,score_max:double>"
    )

    def to_df(self, spark) -> DataFrame:
        row = ((self.p1, self.p99), (self.ae_min, self.ae_max), (self.svm_min, self.svm_max))
        return spark.createDataFrame([row], self.SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame) -> "NormalizationParams":
        r = df.first()
        f, a, s = r["isolation_forest"], r["autoencoder"], r["one_class_svm"]
        return cls(f["p1"], f["p99"], a["score_min"], a["score_max"], s["score_min"], s["score_max"])


def calibrate_percentile(df: DataFrame, raw: str, low: float = 1.0, high: float = 99.0) -> tuple[float, float]:
    """Exact percentiles of raw scores."""
    lo, hi = exact_percentiles(df, {raw: [low / 100.0, high / 100.0]})[raw]
    return lo, hi


def calibrate_minmax(df: DataFrame, raw: str) -> tuple[float, float]:
    r = df.agg(F.min(raw), F.max(raw)).first()
    return r[0], r[1]


def calibrate_min_pct(df: DataFrame, raw: str, top: float = VAE_TOP_PERCENTILE) -> tuple[float, float]:
    """Minimum and an exact upper percentile of raw scores."""
    lo, hi = exact_percentiles(df, {raw: [0.0, top / 100.0]})[raw]
    return lo, hi


def _clipped(value: Column, span: float) -> Column:
    if span < MIN_SPAN:
        return F.lit(0.0)
    return F.least(F.greatest(value / F.lit(span), F.lit(0.0)), F.lit(1.0))


def normalise_if(raw: Column | str, p1: float, p99: float) -> Column:
    """Forest score: low raw values are anomalous, so p99 maps to 0 and p1 to 1."""
    return _clipped(F.lit(p99) - col(raw), p99 - p1)


def normalise_svm(raw: Column | str, score_min: float, score_max: float) -> Column:
    """Decision value: high raw values are normal, so the maximum maps to 0."""
    return _clipped(F.lit(score_max) - col(raw), score_max - score_min)


def normalise_ae(raw: Column | str, score_min: float, score_max: float) -> Column:
    """Reconstruction score: high raw values are anomalous."""
    return _clipped(col(raw) - F.lit(score_min), score_max - score_min)


def reconstruction_error(x: Column | str, reconstructed: Column | str) -> Column:
    """Mean squared difference of two equally long arrays."""
    a, b = col(x), col(reconstructed)
    squares = F.zip_with(a, b, lambda u, v: (u - v) * (u - v))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def predict(score: Column | str, threshold: float = SINGLE_THRESHOLD) -> Column:
    return (col(score) >= threshold).cast("int")

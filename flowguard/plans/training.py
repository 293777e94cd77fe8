"""Labelled flows -> fitted detector model -> evaluation."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from flowguard.detectors.common import raw_scores, spread
from flowguard.detectors.iforest import IsolationForest
from flowguard.detectors.ocsvm import OneClassSVM
from flowguard.detectors.vae import VAE
from flowguard.operators import ensemble as en, metrics as mt, normalise as nm, prep as pp, selection as sl
from flowguard.operators.quantiles import exact_percentiles
from flowguard.session import release, staged


@dataclass
class TrainingConfig:
    seed: int = pp.SEED
    skew_threshold: float = pp.SKEW_THRESHOLD
    mi_drop_percentile: float = sl.DROP_PERCENTILE
    mi_sample: int | None = None  # rows for mutual information; all by default
    trees: int = 300
    tree_rows: int = 256
    svm_rounds: int = 4
    vae_epochs: int = 100
    vae_local_epochs: int = 5


@dataclass
class DetectorModel:
    """Everything a scoring job needs; small and of fixed size."""

    scaler: pp.ScalerParams
    forest: IsolationForest
    svm: OneClassSVM
    vae: VAE
    bounds: nm.NormalizationParams
    ensemble: en.EnsembleParams
    info: dict = field(default_factory=dict)


def prepare(flows: DataFrame, config: TrainingConfig, id_columns: list[str]) -> tuple[DataFrame, pp.ScalerParams]:
    """Clean, log-transform, impute, select, split and scale: (rows with split and scaled features, scaler)."""
    labelled = pp.drop_listed(pp.binarise_label(pp.normalise_label(flows)))
    features = [c for c in pp.numeric_columns(labelled) if c not in (*id_columns, "label")]
    labelled = labelled.select(*id_columns, "label", "attack_type", *[pp.q(c) for c in features])
    labelled = spread(labelled)
    skewed = pp.skewed_columns(labelled, features, config.skew_threshold)
    logged = pp.signed_log1p(labelled, skewed)
    constant = set(pp.zero_variance_columns(logged, features))
    features = [c for c in features if c not in constant]
    clean = pp.nonfinite_to_null(logged, features)
    filled = pp.impute_median(clean, features).select(*id_columns, "label", "attack_type", *[pp.q(c) for c in features])
    # Everything below reads this table several times; it is written once. A table that is read no more is deleted.
    filled = staged(filled)
    release(labelled)
    scores = sl.mutual_information(filled, features, sample=config.mi_sample, seed=config.seed, id_columns=id_columns)
    kept = {r["feature"]: r["kept"] for r in sl.select_by_mi(scores, config.mi_drop_percentile).collect()}
    release(scores)
    dropped = [c for c in features if not kept.get(c, False)]
    features = [c for c in features if kept.get(c, False)]
    parts = pp.one_class_split(filled.drop(*dropped), config.seed, id_columns)
    scaler = pp.fit_scaler(parts.filter("split = 'train'"), features, skewed, dropped)
    return pp.apply_scaler(parts, scaler), scaler


def with_raw_scores(rows: DataFrame, forest: IsolationForest, svm: OneClassSVM, vae: VAE, mode: str = "full") -> DataFrame:
    """if_raw, ae_raw, svm_raw from one pass through Python over the feature columns."""
    scorers = {"if_raw": forest.scorer(), "ae_raw": vae.scorer(mode), "svm_raw": svm.scorer()}
    return rows.withColumn("_raw", raw_scores(forest.columns, scorers)).select(*rows.columns, "_raw.*")


def with_scores(rows: DataFrame, b: nm.NormalizationParams) -> DataFrame:
    return rows.withColumns(
        {
            "if_score": nm.normalise_if("if_raw", b.p1, b.p99),
            "ae_score": nm.normalise_ae("ae_raw", b.ae_min, b.ae_max),
            "svm_score": nm.normalise_svm("svm_raw", b.svm_min, b.svm_max),
        }
    )


def with_decision(rows: DataFrame, e: en.EnsembleParams) -> DataFrame:
    return rows.withColumn("prob", en.combine(en.SCORE_COLUMNS, e.coefficients, e.intercept)).withColumn(
        "is_attack", en.decide("prob", e.threshold)
    )


def with_row_id(flows: DataFrame, name: str = "row_id") -> DataFrame:
    """``flows`` with an id from the content of each row, the same at any partitioning; equal rows share it, which all operators allow."""
    return flows if name in flows.columns else flows.withColumn(name, F.hex(F.xxhash64(*[pp.q(c) for c in sorted(flows.columns)])))


def train(flows: DataFrame, config: TrainingConfig | None = None, id_columns: list[str] | None = None) -> tuple[DetectorModel, DataFrame]:
    """Fit on labelled flows; returns the model and the scored validation and test rows.

    Without ``id_columns`` the column ``row_id`` tells rows apart, or an id from their content if there is none.
    """
    cfg = config or TrainingConfig()
    ids = id_columns or ["row_id"]
    flows = flows if id_columns else with_row_id(flows)
    started = time.time()
    info: dict[str, float] = {}

    def lap(name: str) -> None:
        info[name] = time.time() - started - sum(info.values())

    prepared, scaler = prepare(flows, cfg, ids)
    names = scaler.feature_names
    rows = staged(prepared)
    release(prepared)
    lap("prepare_seconds")
    benign = rows.filter("split = 'train'")
    forest = IsolationForest.fit(benign, names, cfg.trees, cfg.tree_rows, cfg.seed, ids)
    lap("forest_seconds")
    vae = VAE.fit(benign, rows.filter("split = 'val' AND label = 0"), names, cfg.vae_epochs, cfg.vae_local_epochs, seed=cfg.seed, id_columns=ids)
    lap("vae_seconds")
    svm = OneClassSVM.fit(benign, names, rounds=cfg.svm_rounds, seed=cfg.seed, id_columns=ids)
    lap("svm_seconds")
    raw = staged(with_raw_scores(rows, forest, svm, vae).drop(*names))
    release(rows)
    on_train = raw.filter("split = 'train'")
    lap("scoring_seconds")
    cut = exact_percentiles(on_train, {"if_raw": [0.01, 0.99], "ae_raw": [0.0, 0.995], "svm_raw": [0.0, 1.0]})
    bounds = nm.NormalizationParams(*cut["if_raw"], *cut["ae_raw"], *cut["svm_raw"])
    scored = with_scores(raw.filter("split <> 'train'"), bounds)
    val = scored.filter("split = 'val'")
    ensemble = en.fit_stacker(val)
    best = en.tune_threshold(val.withColumn("prob", en.combine(en.SCORE_COLUMNS, ensemble.coefficients, ensemble.intercept))).first()
    ensemble.threshold, ensemble.best_metric_value, ensemble.optimized = best["threshold"], best["metric"], True
    lap("ensemble_seconds")
    info["training_time_seconds"] = time.time() - started
    model = DetectorModel(scaler, forest, svm, vae, bounds, ensemble, info)
    return model, with_decision(scored, ensemble)


def evaluate_model(scored: DataFrame, split: str = "test") -> DataFrame:
    """One row: overall metrics of the ensemble on a split."""
    rows = scored.filter(F.col("split") == split).withColumn("pred", F.col("is_attack").cast("int"))
    return mt.evaluate(rows)


def evaluate_types(scored: DataFrame, split: str = "test") -> DataFrame:
    rows = scored.filter(F.col("split") == split).withColumn("pred", F.col("is_attack").cast("int"))
    return mt.per_type_recall(rows)


def score_flows(flows: DataFrame, model: DetectorModel, keep: list[str] | None = None, mode: str = "full") -> DataFrame:
    """Raw flow features -> transform -> three scores -> probability -> decision, as one lazy plan."""
    ready = pp.transform_features(flows, model.scaler, keep)
    raw = with_raw_scores(ready, model.forest, model.svm, model.vae, mode).drop(*model.scaler.feature_names)
    return with_decision(with_scores(raw, model.bounds), model.ensemble)

"""Stacked combination of the three scores and the constrained threshold search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

# Score order, regularisation, threshold grid and constraint.
MODEL_NAMES = ["isolation_forest", "autoencoder", "one_class_svm"]
SCORE_COLUMNS = ["if_score", "ae_score", "svm_score"]
INVERSE_REGULARISATION = 1.0
MAX_ITERATIONS = 1000
GRID_START, GRID_END, GRID_SIZE = 0.01, 0.99, 200
BETA = 0.5
MIN_BENIGN_RECALL = 0.85
FALLBACK_THRESHOLD, FALLBACK_METRIC = 0.5, -1.0


@dataclass
class EnsembleParams:
    coefficients: list[float]
    intercept: float
    threshold: float = FALLBACK_THRESHOLD
    optimized: bool = False
    best_metric_value: float = FALLBACK_METRIC
    metric_name: str = f"macro_fbeta_b{BETA}"
    model_names: list[str] = field(default_factory=lambda: list(MODEL_NAMES))

    SCHEMA = (
        "type string, n_models bigint, coefficients array<double>, intercept double, threshold double, "
        "model_names array<string>, optimized boolean, ensemble_result struct<coefficients:array<double>,"
        "intercept:double,threshold:double,best_metric_value:double,metric_name:string>"
    )

    def to_df(self, spark) -> DataFrame:
        result = (self.coefficients, self.intercept, self.threshold, self.best_metric_value, self.metric_name)
        row = (
            "logistic_regression", len(self.coefficients), self.coefficients, self.intercept, self.threshold,
            self.model_names, self.optimized, result,
        )
        return spark.createDataFrame([row], self.SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame) -> "EnsembleParams":
        r = df.first()
        out = cls(list(r["coefficients"]), r["intercept"], r["threshold"], r["optimized"], model_names=list(r["model_names"]))
        extra = r["ensemble_result"] if "ensemble_result" in r else None
        if extra is not None:
            out.best_metric_value, out.metric_name = extra["best_metric_value"], extra["metric_name"]
        return out


def fit_stacker(df: DataFrame, scores: list[str] | None = None, label: str = "label") -> EnsembleParams:
    """L2 logistic regression on the scores: mean loss + |w|^2 / (2 n C), no standardisation."""
    cols = scores or SCORE_COLUMNS
    n = df.count()
    data = VectorAssembler(inputCols=cols, outputCol="_scores").transform(df.select(*cols, F.col(label).cast("double").alias("_y")))
    model = LogisticRegression(
        featuresCol="_scores",
        labelCol="_y",
        regParam=1.0 / (n * INVERSE_REGULARISATION),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
        tol=1e-8,
    ).fit(data)
    return EnsembleParams([float(c) for c in model.coefficients], float(model.intercept))


def stacker_gradient(df: DataFrame, fitted: EnsembleParams, scores: list[str] | None = None, label: str = "label") -> list[float]:
    """Gradient of ``fit_stacker``'s objective, times the rows, at the fitted coefficients and intercept: zero at the optimum."""
    cols = scores or SCORE_COLUMNS
    error = combine(list(cols), fitted.coefficients, fitted.intercept) - F.col(label).cast("double")
    sums = df.agg(*[F.sum(error * F.col(c)) for c in cols], F.sum(error), F.count(F.lit(1))).first()
    pulls = [*[c / INVERSE_REGULARISATION for c in fitted.coefficients], 0.0]
    return [(s + pull) / sums[-1] for s, pull in zip(sums[:-1], pulls, strict=True)]


def combine(scores: list[Column | str], coefficients: list[float], intercept: float) -> Column:
    """Probability: sigmoid of the weighted scores."""
    logit = F.lit(0.0)
    for s, c in zip(scores, coefficients, strict=True):
        logit = logit + (F.col(s) if isinstance(s, str) else s) * F.lit(float(c))
    return 1.0 / (1.0 + F.exp(-(logit + F.lit(float(intercept)))))


def grid_threshold(i: Column) -> Column:
    """i-th of the equally spaced thresholds (the last one is exact)."""
    step = (GRID_END - GRID_START) / (GRID_SIZE - 1)
    return F.when(i >= GRID_SIZE - 1, F.lit(GRID_END)).otherwise(i.cast("double") * F.lit(step) + F.lit(GRID_START))


def thresholds_passed(prob: Column) -> Column:
    """How many thresholds are <= prob; the arithmetic guess is corrected against the real grid values."""
    step = (GRID_END - GRID_START) / (GRID_SIZE - 1)
    guess = F.greatest(F.least(F.floor((prob - GRID_START) / F.lit(step)), F.lit(GRID_SIZE - 1)), F.lit(-1)).cast("int")
    above = (guess + 1 <= GRID_SIZE - 1) & (grid_threshold(guess + 1) <= prob)
    below = (guess >= 0) & (grid_threshold(guess) > prob)
    return F.when(above, guess + 2).when(below, guess).otherwise(guess + 1)


def threshold_table(df: DataFrame, prob: str = "prob", label: str = "label", beta: float = BETA) -> DataFrame:
    """One row per threshold with confusion counts, benign recall and macro F-beta; one pass over the data."""
    spark = df.sparkSession
    counts = (
        df.select(thresholds_passed(F.col(prob)).alias("passed"), F.col(label).cast("int").alias("y"))
        .groupBy("passed")
        .agg(F.count_if(F.col("y") == 1).alias("attack"), F.count_if(F.col("y") == 0).alias("benign"))
    )
    # GRID_SIZE + 1 rows from here on.
    grid = spark.range(0, GRID_SIZE + 1, 1, 1).select(F.col("id").cast("int").alias("passed"))
    filled = grid.join(counts, "passed", "left").na.fill(0)
    everything = Window.partitionBy(F.lit(0))
    upwards = Window.partitionBy(F.lit(0)).orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)
    totals = filled.select(
        (F.col("passed") - 1).alias("i"),
        F.sum("attack").over(upwards).alias("tp"),
        F.sum("benign").over(upwards).alias("fp"),
        F.sum("attack").over(everything).alias("positives"),
        F.sum("benign").over(everything).alias("negatives"),
    ).filter("i >= 0")
    one = F.lit(1)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp

    def fbeta(hit: Column, wrong: Column, missed: Column) -> Column:
        p = hit / F.greatest(hit + wrong, one)
        r = hit / F.greatest(hit + missed, one)
        d = beta * beta * p + r
        return F.when(d > 0, (1 + beta * beta) * p * r / d).otherwise(F.lit(0.0))

    return totals.select(
        "i",
        grid_threshold(F.col("i")).alias("threshold"),
        "tp", "fp", fn.alias("fn"), tn.alias("tn"),
        (tn / F.greatest(F.col("negatives"), one)).alias("benign_recall"),
        ((fbeta(tp, fp, fn) + fbeta(tn, fn, fp)) / 2.0).alias("macro_fbeta"),
    )


def tune_threshold(
    df: DataFrame, prob: str = "prob", label: str = "label", beta: float = BETA, min_benign_recall: float = MIN_BENIGN_RECALL
) -> DataFrame:
    """(threshold, metric): best macro F-beta with enough benign recall; lowest threshold wins ties."""
    allowed = threshold_table(df, prob, label, beta).filter(F.col("benign_recall") >= min_benign_recall)
    best = allowed.agg(F.max(F.struct("macro_fbeta", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(
        F.coalesce(-F.col("b.t"), F.lit(FALLBACK_THRESHOLD)).alias("threshold"),
        F.coalesce(F.col("b.macro_fbeta"), F.lit(FALLBACK_METRIC)).alias("metric"),
    )


def decide(prob: Column | str, threshold: float) -> Column:
    return (F.col(prob) if isinstance(prob, str) else prob) >= F.lit(threshold)

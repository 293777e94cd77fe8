"""Score normalisation, ensemble decision and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.fixtures import duckdb_view, spark_view
from flowguard.operators import ensemble as en, metrics as mt, normalise as nm
from flowguard.plans.registry import query

SCORED = f"WITH scored AS ({duckdb_view('scored')})"
COUNTS = (
    SCORED
    + """, c AS (SELECT count(*) FILTER (label=1 AND pred=1) AS tp, count(*) FILTER (label=0 AND pred=1) AS fp,
  count(*) FILTER (label=1 AND pred=0) AS fn, count(*) FILTER (label=0 AND pred=0) AS tn FROM scored)"""
)

# Stand-in bounds and coefficients.
P1, P99 = -0.6, -0.35
AE_MIN, AE_MAX = 0.0, 0.1
SVM_MIN, SVM_MAX = -4.0, 3.5
COEF, INTERCEPT = [-1.5, 12.0, 1.25], -3.0
THRESHOLD = 0.35


def scored(spark, sf):
    return spark_view(spark, sf, "scored")


def d(x: float) -> str:
    return f"({x!r})::DOUBLE"


@query("confusion", SCORED + "SELECT y.v AS label, p.v AS pred, count(row_id) AS n FROM (VALUES (0),(1)) y(v) CROSS JOIN (VALUES (0),(1)) p(v) LEFT JOIN scored s ON s.label=y.v AND s.pred=p.v GROUP BY ALL")
def confusion(spark, sf):
    return mt.confusion(scored(spark, sf))


@query(
    "binary_metrics",
    COUNTS + " SELECT (tp+tn)/(tp+fp+fn+tn) AS accuracy, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS precision, "
    "CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1 FROM c",
)
def binary_metrics(spark, sf):
    return mt.binary_metrics(scored(spark, sf))


def _auc_sql(source: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""g AS (SELECT {by}score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM {source} GROUP BY {by}score),
b AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT {by}CASE WHEN sum(pos)*sum(neg) > 0 THEN CAST(sum(pos*(2*below+neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE)*2) ELSE 0 END AS roc_auc FROM b {group})"""


@query("roc_auc", SCORED + f", s AS (SELECT label, prob AS score FROM scored), {_auc_sql('s')} SELECT roc_auc FROM auc")
def roc_auc(spark, sf):
    return mt.roc_auc(scored(spark, sf), score="prob")


@query(
    "roc_curve",
    SCORED
    + """, g AS (SELECT svm_score AS threshold, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER o AS npos, lead(neg) OVER o AS nneg, lag(pos) OVER o AS ppos, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM g WINDOW o AS (ORDER BY threshold DESC), w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT round(fp::DOUBLE / n::DOUBLE, 9) AS fpr, round(tp::DOUBLE / p::DOUBLE, 9) AS tpr, threshold FROM c WHERE npos IS NULL OR ppos IS NULL OR npos <> pos OR nneg <> neg
UNION ALL SELECT 0, 0, 'inf'::DOUBLE""",
)
def roc_curve(spark, sf):
    out = mt.roc_curve(scored(spark, sf), score="svm_score")
    # As its SQL rounds: the scaled double, not the decimal digits that F.round(c, 9) takes; they part near half a unit.
    return out.withColumns({c: F.round(F.col(c) * 1e9) / 1e9 for c in ("fpr", "tpr")})


@query(
    "classification_report",
    COUNTS
    + """, r AS (SELECT 'Benign' AS class, tn/(tn+fn) AS precision, tn/(tn+fp) AS recall, 2*tn/(2*tn+fn+fp) AS f1, tn+fp AS support FROM c
UNION ALL SELECT 'Attack', tp/(tp+fp), tp/(tp+fn), 2*tp/(2*tp+fp+fn), tp+fn FROM c),
a AS (SELECT * FROM r UNION ALL SELECT 'accuracy', NULL, NULL, (tp+tn)/(tp+fp+fn+tn), tp+fp+fn+tn FROM c
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM r)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM a""",
)
def classification_report(spark, sf):
    out = mt.classification_report(scored(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "per_type_recall",
    SCORED
    + "SELECT attack_type, count(*) AS count, count(*) FILTER (CASE WHEN lower(attack_type)='benign' THEN pred=0 ELSE pred=1 END) AS detected, "
    "count(*) FILTER (CASE WHEN lower(attack_type)='benign' THEN pred=0 ELSE pred=1 END) / count(*) AS recall FROM scored GROUP BY attack_type",
)
def per_type_recall(spark, sf):
    return mt.per_type_recall(scored(spark, sf))


@query(
    "evaluate_each",
    SCORED
    + f""", s AS (SELECT split, label, 'if_score' AS model, if_score AS score FROM scored UNION ALL SELECT split, label, 'ae_score', ae_score FROM scored
UNION ALL SELECT split, label, 'svm_score', svm_score FROM scored), {_auc_sql("s", "model, split")},
c AS (SELECT model, split, count(*) FILTER (label=1 AND score>=0.5) AS tp, count(*) FILTER (label=0 AND score>=0.5) AS fp,
  count(*) FILTER (label=1 AND score<0.5) AS fn, count(*) FILTER (label=0 AND score<0.5) AS tn FROM s GROUP BY ALL)
SELECT c.model, c.split, (tp+tn)/(tp+fp+fn+tn) AS accuracy, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*tp/(2*tp+fp+fn) AS f1, roc_auc
FROM c JOIN auc ON c.model=auc.model AND c.split=auc.split""",
)
def evaluate_each(spark, sf):
    return mt.evaluate_each(scored(spark, sf), en.SCORE_COLUMNS, by=["split"])


RAW = SCORED + ", raw AS (SELECT *, -if_score AS if_raw, ae_score/10 AS ae_raw, svm_score*8-4 AS svm_raw FROM scored)"


def raw(spark, sf):
    return scored(spark, sf).withColumns(
        {"if_raw": -F.col("if_score"), "ae_raw": F.col("ae_score") / 10, "svm_raw": F.col("svm_score") * 8 - 4}
    )


@query("normalise_if", RAW + f"SELECT row_id, least(greatest(({d(P99)} - if_raw) / {d(P99 - P1)}, 0), 1) AS score FROM raw")
def normalise_if(spark, sf):
    return raw(spark, sf).select("row_id", nm.normalise_if("if_raw", P1, P99).alias("score"))


@query("normalise_svm", RAW + f"SELECT row_id, least(greatest(({d(SVM_MAX)} - svm_raw) / {d(SVM_MAX - SVM_MIN)}, 0), 1) AS score FROM raw")
def normalise_svm(spark, sf):
    return raw(spark, sf).select("row_id", nm.normalise_svm("svm_raw", SVM_MIN, SVM_MAX).alias("score"))


@query("normalise_ae", RAW + f"SELECT row_id, least(greatest((ae_raw - {d(AE_MIN)}) / {d(AE_MAX - AE_MIN)}, 0), 1) AS score FROM raw")
def normalise_ae(spark, sf):
    return raw(spark, sf).select("row_id", nm.normalise_ae("ae_raw", AE_MIN, AE_MAX).alias("score"))


@query("calibrate_percentile", RAW + "SELECT round(quantile_cont(if_raw, 0.01), 9) AS p1, round(quantile_cont(if_raw, 0.99), 9) AS p99 FROM raw")
def calibrate_percentile(spark, sf):
    lo, hi = nm.calibrate_percentile(raw(spark, sf), "if_raw")
    return spark.createDataFrame([(round(lo, 9), round(hi, 9))], "p1 double, p99 double")


@query("calibrate_minmax", RAW + "SELECT min(svm_raw) AS score_min, max(svm_raw) AS score_max FROM raw")
def calibrate_minmax(spark, sf):
    return spark.createDataFrame([nm.calibrate_minmax(raw(spark, sf), "svm_raw")], "score_min double, score_max double")


@query("calibrate_min_pct", RAW + "SELECT round(min(svm_raw), 9) AS score_min, round(quantile_cont(svm_raw, 0.995), 9) AS score_max FROM raw")
def calibrate_min_pct(spark, sf):
    lo, hi = nm.calibrate_min_pct(raw(spark, sf), "svm_raw")
    return spark.createDataFrame([(round(lo, 9), round(hi, 9))], "score_min double, score_max double")


@query(
    "reconstruction_error",
    SCORED + "SELECT row_id, round(((if_score-ae_score)*(if_score-ae_score) + (ae_score-svm_score)*(ae_score-svm_score) + (svm_score-if_score)*(svm_score-if_score))/3, 9) AS mse FROM scored",
)
def reconstruction_error(spark, sf):
    x, y = F.array("if_score", "ae_score", "svm_score"), F.array("ae_score", "svm_score", "if_score")
    return scored(spark, sf).select("row_id", F.round(nm.reconstruction_error(x, y), 9).alias("mse"))


@query("predict_single", SCORED + "SELECT row_id, CASE WHEN if_score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored")
def predict_single(spark, sf):
    return scored(spark, sf).select("row_id", nm.predict("if_score").alias("pred"))


COMBINED = (
    SCORED
    + f", combined AS (SELECT *, 1/(1+exp(-(if_score*{d(COEF[0])} + ae_score*{d(COEF[1])} + svm_score*{d(COEF[2])} + {d(INTERCEPT)}))) AS p FROM scored)"
)


@query("combine", COMBINED + "SELECT row_id, round(p, 9) AS prob FROM combined")
def combine(spark, sf):
    return scored(spark, sf).select("row_id", F.round(en.combine(en.SCORE_COLUMNS, COEF, INTERCEPT), 9).alias("prob"))


@query("decide", COMBINED + f"SELECT row_id, p >= {THRESHOLD}::DOUBLE AS is_attack FROM combined")
def decide(spark, sf):
    p = scored(spark, sf).withColumn("p", en.combine(en.SCORE_COLUMNS, COEF, INTERCEPT))
    return p.select("row_id", en.decide("p", THRESHOLD).alias("is_attack"))


SWEEP = """, t AS (SELECT i, CASE WHEN i = 199 THEN 0.99::DOUBLE ELSE i * ((0.99::DOUBLE - 0.01::DOUBLE) / 199) + 0.01::DOUBLE END AS thr FROM generate_series(0, 199) s(i)),
c AS (SELECT thr, count(*) FILTER (label=1 AND prob>=thr) AS tp, count(*) FILTER (label=0 AND prob>=thr) AS fp,
  count(*) FILTER (label=1 AND prob<thr) AS fn, count(*) FILTER (label=0 AND prob<thr) AS tn FROM scored, t GROUP BY thr),
r AS (SELECT *, tp/greatest(tp+fp,1) AS pa, tp/greatest(tp+fn,1) AS ra, tn/greatest(tn+fn,1) AS pb, tn/greatest(tn+fp,1) AS rb FROM c),
f AS (SELECT thr, tp, fp, fn, tn, tn/greatest(tn+fp,1) AS benign_recall,
  ((CASE WHEN 0.25::DOUBLE*pa+ra > 0 THEN 1.25::DOUBLE*pa*ra/(0.25::DOUBLE*pa+ra) ELSE 0 END) + (CASE WHEN 0.25::DOUBLE*pb+rb > 0 THEN 1.25::DOUBLE*pb*rb/(0.25::DOUBLE*pb+rb) ELSE 0 END)) / 2 AS metric FROM r)"""


@query("threshold_table", SCORED + SWEEP + " SELECT thr AS threshold, tp, fp, fn, tn, round(benign_recall, 9) AS benign_recall, round(metric, 9) AS macro_fbeta FROM f")
def threshold_table(spark, sf):
    out = en.threshold_table(scored(spark, sf)).drop("i")
    return out.withColumns({c: F.round(c, 9) for c in ("benign_recall", "macro_fbeta")})


@query(
    "tune_threshold",
    SCORED + SWEEP + " SELECT thr AS threshold, round(metric, 9) AS metric FROM (SELECT * FROM f WHERE benign_recall >= 0.85 UNION ALL SELECT 0.5, 0,0,0,0, 0, -1) ORDER BY metric DESC, thr LIMIT 1",
)
def tune_threshold(spark, sf):
    return en.tune_threshold(scored(spark, sf)).withColumn("metric", F.round("metric", 9))


@query("fit_stacker")
def fit_stacker(spark, sf):
    p = en.fit_stacker(scored(spark, sf).filter("split = 'val'"))
    return spark.createDataFrame([(*p.coefficients, p.intercept)], "w_if double, w_ae double, w_svm double, intercept double")


# The objective is strictly convex, so a vanishing gradient proves the optimum; SQL counts the rows it is taken over.
@query(
    "stacker_optimum",
    SCORED + " SELECT p.name, 0.0::DOUBLE AS gradient, count(*) AS n_rows FROM scored, (SELECT unnest(['if_score', 'ae_score', 'svm_score', 'intercept']) AS name) p "
    "WHERE split = 'val' GROUP BY p.name",
)
def stacker_optimum(spark, sf):
    rows = scored(spark, sf).filter("split = 'val'")
    gradient = en.stacker_gradient(rows, en.fit_stacker(rows))
    named = zip([*en.SCORE_COLUMNS, "intercept"], [round(g, 5) + 0.0 for g in gradient], strict=True)
    return spark.createDataFrame(list(named), "name string, gradient double").withColumn("n_rows", F.lit(rows.count()).cast("long"))

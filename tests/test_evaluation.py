import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.operators import ensemble as en, metrics as mt, normalise as nm

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

# Known per-type counts (rows, detected) with their published totals.
TYPES = {
    "Benign": (14675, 13544), "DrDoS_DNS": (1832, 1822), "DrDoS_LDAP": (711, 710), "DrDoS_MSSQL": (3086, 3085), "DrDoS_NTP": (60659, 60505),
    "DrDoS_NetBIOS": (282, 280), "DrDoS_SNMP": (1328, 1327), "DrDoS_UDP": (5203, 5201), "LDAP": (937, 937), "MSSQL": (4260, 4259), "NetBIOS": (313, 313),
    "Portmap": (329, 307), "Syn": (24799, 24689), "TFTP": (49386, 49321), "UDP": (9152, 9152), "UDP-lag": (4450, 4168), "UDPLag": (20, 18), "WebDDoS": (23, 3),
}


@pytest.fixture(scope="module")
def published(spark):
    rows = [(t, int(t != "Benign"), n, d) for t, (n, d) in TYPES.items()]
    grid = spark.createDataFrame(rows, "attack_type string, label int, n int, d int")
    each = grid.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    hit = F.col("i") <= F.col("d")
    return each.withColumn("pred", F.when(F.col("label") == 1, hit.cast("int")).otherwise((~hit).cast("int"))).cache()


def test_published_metrics(published):
    r = mt.binary_metrics(published).first()
    want = (0.9900575932100637, 0.9932367785299112, 0.9959645020087545, 0.9945987700525153)
    assert np.allclose(tuple(r), want, atol=1e-15)
    assert {(c["label"], c["pred"]): c["n"] for c in mt.confusion(published).collect()} == {(1, 1): 166097, (1, 0): 673, (0, 0): 13544, (0, 1): 1131}
    types = mt.per_type_recall(published).collect()
    assert [t["attack_type"] for t in types] == sorted(TYPES)
    assert {t["attack_type"]: (t["count"], t["detected"]) for t in types} == TYPES
    report = {x["class"]: x for x in mt.classification_report(published).collect()}
    assert report["Benign"]["support"] == 14675 and abs(report["Benign"]["recall"] - 0.9229301533219761) < 1e-15


def test_one_class_and_empty(spark):
    ones = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.2)], "label int, pred int, score double")
    assert mt.roc_auc(ones).first()[0] == 0.0
    nothing = spark.createDataFrame([(0, 0, 0.5)], "label int, pred int, score double")
    assert tuple(mt.binary_metrics(nothing).first()) == (1.0, 0.0, 0.0, 0.0)


def scored(spark, n=2000, seed=0, levels=None):
    rng = np.random.RandomState(seed)
    y = (rng.random_sample(n) < 0.4).astype(int)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)
    if levels:
        s = np.round(s * levels) / levels
    return y, s, spark.createDataFrame(pd.DataFrame({"label": y, "score": s, "prob": s}))


@pytest.mark.parametrize("levels", [None, 10])
def test_auc_and_curve_by_brute_force(spark, levels):
    y, s, df = scored(spark, levels=levels)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(mt.roc_auc(df).first()[0] - want) < 1e-12
    pts = mt.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert tuple(pts.iloc[0]) == (0.0, 0.0, np.inf) and (pts.iloc[-1].fpr, pts.iloc[-1].tpr) == (1.0, 1.0)
    for _, p in pts.iloc[1:].iterrows():
        assert abs(p.fpr - (neg >= p.threshold).mean()) < 1e-12 and abs(p.tpr - (pos >= p.threshold).mean()) < 1e-12
    assert abs(np.trapezoid(pts.tpr, pts.fpr) - want) < 1e-9


def brute_threshold(y, p, floor=0.85, b2=0.25):
    best, at = -1.0, 0.5
    for thr in np.linspace(0.01, 0.99, 200):
        tp, fp = ((p >= thr) & (y == 1)).sum(), ((p >= thr) & (y == 0)).sum()
        fn, tn = ((p < thr) & (y == 1)).sum(), ((p < thr) & (y == 0)).sum()
        if tn / max(tn + fp, 1) < floor:
            continue
        fb = []
        for hit, wrong, miss in ((tp, fp, fn), (tn, fn, fp)):
            pr, rc = hit / max(hit + wrong, 1), hit / max(hit + miss, 1)
            fb.append((1 + b2) * pr * rc / (b2 * pr + rc) if b2 * pr + rc > 0 else 0)
        if np.mean(fb) > best:
            best, at = np.mean(fb), thr
    return at, best


@pytest.mark.parametrize("levels", [None, 4])
def test_threshold_search(spark, levels):
    y, s, df = scored(spark, levels=levels)
    at, best = brute_threshold(y, s)
    r = en.tune_threshold(df).first()
    assert r["threshold"] == at and abs(r["metric"] - best) < 1e-12


def test_threshold_fallback_and_grid(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0)], "label int, prob double")
    assert tuple(en.tune_threshold(df).first()) == (0.5, -1.0)
    grid = [float(x) for x in np.linspace(0.01, 0.99, 200)]
    assert grid[64] == 0.32517587939698495
    probs = spark.createDataFrame([(float(v),) for g in grid for v in (g, np.nextafter(g, 0), np.nextafter(g, 1))], "p double")
    got = [r[0] for r in probs.select(en.thresholds_passed(F.col("p"))).collect()]
    assert got == [x for i in range(200) for x in (i + 1, i, i + 1)]


def test_normalisation(spark):
    df = spark.createDataFrame([(-0.7,), (-0.6,), (-0.5,), (-0.3,)], "r double")
    got = [r[0] for r in df.select(nm.normalise_if("r", -0.6, -0.4)).collect()]
    assert np.allclose(got, [1, 1, 0.5, 0])
    assert [r[0] for r in df.select(nm.normalise_if("r", -0.5, -0.5)).collect()] == [0.0] * 4
    assert [r[0] for r in df.select(nm.normalise_svm("r", 1.0, 1.0)).collect()] == [0.0] * 4
    assert np.allclose([r[0] for r in df.select(nm.normalise_ae("r", -0.7, -0.3)).collect()], [0, 0.25, 0.5, 1])
    p = nm.NormalizationParams(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    assert nm.NormalizationParams.from_df(p.to_df(spark)) == p
    arrays = spark.createDataFrame([([1.0, 2.0], [0.0, 4.0])], "x array<double>, y array<double>")
    assert arrays.select(nm.reconstruction_error("x", "y")).first()[0] == 2.5


def test_stacker_matches_newton(spark):
    rng = np.random.RandomState(2)
    y = (rng.random_sample(800) < 0.5).astype(float)
    x = np.clip(rng.normal(0.4, 0.2, (800, 3)) + np.outer(y, [0.3, 0.1, -0.1]), 0, 1)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*en.SCORE_COLUMNS, "label"]))
    got = en.fit_stacker(df)
    a, w = np.column_stack([x, np.ones(800)]), np.zeros(4)
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    assert np.allclose([*got.coefficients, got.intercept], w, atol=1e-3)
    back = en.EnsembleParams.from_df(got.to_df(spark))
    assert back.coefficients == got.coefficients and back.threshold == got.threshold


def test_evaluate_each(spark):
    _, _, df = scored(spark)
    r = mt.evaluate_each(df.withColumn("split", F.lit("val")).select("label", "split", "score"), ["score"], by=["split"]).first()
    one = mt.binary_metrics(df.withColumn("pred", (F.col("score") >= 0.5).cast("int"))).first()
    assert r["accuracy"] == one["accuracy"] and r["roc_auc"] == mt.roc_auc(df).first()[0]


def test_roc_curve_rounds_as_its_sql_does(spark, tmp_path):
    """5120 rows a class: 41/5120 = 0.0080078125 ends in half a unit of the ninth digit, where roundings part."""
    n = 5120
    i = np.arange(2 * n)
    rows = pd.DataFrame(
        {
            "l_orderkey": i, "l_linenumber": 1, "l_partkey": i, "l_suppkey": i, "l_quantity": 1.0, "l_extendedprice": 1000.0 + i,
            "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": np.where(i % 2 == 0, "R", "A"), "l_shipdate": pd.Timestamp("1996-01-01"),
        }
    )
    rows["l_shipdate"] = rows["l_shipdate"].astype("datetime64[us]")
    rows.to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    status, count, _, note = check_oracle.compare(spark, con, "roc_curve", str(tmp_path))
    assert (status, count) == ("ok", 2 * n + 1), note

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowguard.operators import prep as pp, selection as sl
from flowguard.operators.quantiles import exact_percentiles, hash_cutoffs


def test_labels(spark):
    df = spark.createDataFrame([(" Benign ",), ("BENIGN",), ("Syn\n",), (None,)], "Label string")
    rows = pp.binarise_label(pp.normalise_label(df)).collect()
    assert [(r["attack_type"], r["label"]) for r in rows] == [("Benign", 0), ("BENIGN", 0), ("Syn", 1), ("nan", 1)]
    assert pp.class_profile(pp.binarise_label(pp.normalise_label(df))).first() == (2, 2, 2)
    with pytest.raises(KeyError):
        pp.normalise_label(df, "missing")


def test_skewness_matches_pandas_and_ignores_infinite(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"a": rng.exponential(size=500), "b": rng.normal(size=500), "c": np.ones(500), "d.e": rng.normal(size=500)})
    pdf.loc[0, "a"] = 1e6
    pdf.loc[0, "d.e"] = np.inf
    pdf.loc[1, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    got = pp.column_skewness(df, list(pdf.columns))
    for c in ("a", "b", "c"):
        assert abs(got[c] - pdf[c].skew()) < 1e-8
    assert math.isnan(got["d.e"])
    assert pp.skewed_columns(df) == ["a"]
    assert pp.zero_variance_columns(df, list(pdf.columns)) == ["c"]


def test_signed_log_and_transform(spark):
    df = spark.createDataFrame([(100.0, -50.0, 0.0)], "a double, b double, c double")
    r = pp.signed_log1p(df, ["a", "b", "c"]).first()
    assert np.allclose(list(r), [math.log(101), -math.log(51), 0], atol=1e-12)
    three = spark.createDataFrame([(50.0, 12.0, 25.0, 1.0)], "z double, x double, y double, extra double")
    params = pp.ScalerParams([10, 20, 30], [2, 5, 10], ["x", "y", "z"])
    assert tuple(pp.transform_features(three, params).first()) == (1, 1, 2)
    logged = pp.ScalerParams([1.0], [2.0], ["x"], ["x", "unknown"])
    assert abs(pp.transform_features(three, logged).first()[0] - (math.log(13) - 1) / 2) < 1e-12
    zero = pp.ScalerParams([5.0], [0.0], ["x"])
    assert pp.transform_features(three, zero).first()[0] == 0.0
    with pytest.raises(ValueError):
        pp.transform_features(three.drop("y"), params)


def test_nonfinite_and_median(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (4.0,), (None,)], "v double")
    clean = pp.nonfinite_to_null(df, ["v"])
    assert pp.missing_count(clean, ["v"]).first()[0] == 4
    assert sorted(r[0] for r in pp.impute_median(clean, ["v"]).collect()) == [1.0, 2.5, 2.5, 2.5, 2.5, 4.0]


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_percentiles_by_narrowing(spark, accuracy):
    rng = np.random.RandomState(3)
    pdf = pd.DataFrame({"heavy": rng.standard_cauchy(3000) ** 3, "tied": rng.randint(0, 5, 3000).astype(float), "one": 7.0})
    df = spark.createDataFrame(pdf).repartition(5)
    want = {c: [0.0, 0.01, 0.5, 0.995, 1.0] for c in pdf}
    got = exact_percentiles(df, want, accuracy=accuracy)
    for c in pdf:
        assert np.allclose(got[c], np.percentile(pdf[c], [p * 100 for p in want[c]]), rtol=1e-12)


def test_exact_percentiles_of_extreme_values(spark):
    big = 1.7e308
    df = spark.createDataFrame([(-big,), (big,), (big,), (None,), (0.0,), (-0.0,), (1e-300,)], "v double")
    assert exact_percentiles(df, {"v": [0.0, 0.5, 1.0]}, accuracy=10) == {"v": [-big, 5e-301, big]}
    assert exact_percentiles(df.filter("v IS NULL"), {"v": [0.5]}) == {"v": [None]}
    assert exact_percentiles(df.filter("abs(v) > 1"), {"v": [0.25]})["v"][0] == 0.0


def test_hash_cutoffs(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    totals, cuts = hash_cutoffs(df, "h", "g", lambda g, n: [0, 1, n // 2, n], 32)
    pdf = df.toPandas()
    for g, n in totals.items():
        hs = sorted(pdf[pdf.g == g].h)
        assert n == len(hs)
        for k in (0, 1, n // 2, n):
            cut = cuts[g, k]
            assert cut.take is None and sum(bool(cut.prefix) and h[: len(cut.prefix)] <= cut.prefix for h in hs) == k


def test_hash_cutoffs_take_two_passes_over_the_rows(spark):
    """Counting stops after the pass over prefixes and one over the few keys around the cuts; cuts are as short as they can be."""
    df = spark.range(40000).select(F.md5(F.col("id").cast("string")).alias("h"), F.lit(0).alias("g"))
    passes = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda h: passes.add(1) or h, "string").asNondeterministic()
    _, cuts = hash_cutoffs(df.withColumn("h", seen("h")), "h", "g", lambda g, n: [n // 2, n // 3], 32)
    assert passes.value <= 2 * 40000
    hs = sorted(r.h for r in df.collect())
    for (_, k), cut in cuts.items():
        assert cut.take is None and len(cut.prefix) <= 8 and sum(h[: len(cut.prefix)] <= cut.prefix for h in hs) == k


def test_repeated_ids_are_cut_exactly(spark):
    rows = [(None, 1.0)] * 500 + [("a", float(i % 7)) for i in range(300)] + [("a", None)] * 200
    df = spark.createDataFrame(rows, "row_id string, x double").repartition(6)
    for n in (1, 250, 555, 999):
        part = pp.subsample(df, n)
        assert part.columns == df.columns and part.count() == n
    again = sorted(map(str, pp.subsample(df.repartition(3), 555).collect()))
    assert again == sorted(map(str, pp.subsample(df, 555).collect()))
    split = pp.one_class_split(df.withColumn("label", F.lit(0)))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}


def test_subsample_is_exact_and_partition_independent(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("row_id"))
    a = {r[0] for r in pp.subsample(df, 100).collect()}
    b = {r[0] for r in pp.subsample(df.repartition(7), 100).collect()}
    assert a == b and len(a) == 100
    assert pp.subsample(df, 5000).count() == 1000


@pytest.mark.parametrize("benign,attack", [(100, 51), (7, 3), (1001, 0)])
def test_split_sizes(spark, benign, attack):
    df = spark.range(benign + attack).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") >= benign).cast("int").alias("label"), F.when(F.col("id") < benign, "benign").otherwise("x").alias("attack_type")
    )
    got = {(r["label"], r["split"]): r["count"] for r in pp.one_class_split(df).groupBy("label", "split").count().collect()}
    rest = math.ceil(benign * 0.3)
    test = math.ceil(rest * 0.5)
    want = {(0, "train"): benign - rest, (0, "val"): rest - test, (0, "test"): test, (1, "val"): attack - math.ceil(attack / 2), (1, "test"): math.ceil(attack / 2)}
    assert got == {k: v for k, v in want.items() if v}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    p = pp.fit_scaler(df, ["a", "b"])
    assert (p.mean, p.scale) == ([2.0, 5.0], [1.0, 1.0])
    assert pp.ScalerParams.from_df(p.to_df(spark)) == p


def test_digamma(spark):
    row = spark.createDataFrame([(1,), (2,), (10,), (50_000,)], "n bigint").select(sl.digamma(F.col("n"))).collect()
    harmonic = [-np.euler_gamma + sum(1 / i for i in range(1, n)) for n in (1, 2, 10, 50_000)]
    assert np.allclose([r[0] for r in row], harmonic, atol=1e-9)


def brute_mi(x, y, k):
    x = x / x.std()
    psi = lambda n: -np.euler_gamma + sum(1 / i for i in range(1, int(n)))
    ks, nx, m = [], [], []
    for i in range(len(x)):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]
        if not len(same):
            continue
        kk = min(k, len(same))
        d = same[kk - 1]
        ks.append(kk), nx.append((y == y[i]).sum()), m.append((np.abs(x - x[i]) < d).sum())
    return max(0.0, psi(len(ks)) + np.mean([psi(v) for v in ks]) - np.mean([psi(v) for v in nx]) - np.mean([psi(v) for v in m]))


def test_mutual_information_against_brute_force(spark):
    rng = np.random.RandomState(5)
    y = (rng.random_sample(300) < 0.3).astype(int)
    pdf = pd.DataFrame({"row_id": [str(i) for i in range(300)], "label": y, "strong": rng.normal(size=300) + 3 * y, "weak": rng.normal(size=300) + 0.5 * y, "none": rng.normal(size=300)})
    got = {r["feature"]: r["mi"] for r in sl.mutual_information(spark.createDataFrame(pdf), ["strong", "weak", "none"]).collect()}
    for c in ("strong", "weak", "none"):
        assert abs(got[c] - brute_mi(pdf[c].to_numpy(), y, 5)) < 1e-6
    scores = spark.createDataFrame(list(got.items()), "feature string, mi double")
    kept = {r["feature"] for r in sl.select_by_mi(scores, 40).collect() if r["kept"]}
    assert kept == {f for f, v in got.items() if v > np.percentile(list(got.values()), 40)}


def test_listed_and_numeric_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 0)], ["a", "s", "b", "CWE Flag Count"])
    assert pp.numeric_only(pp.drop_listed(df)).columns == ["a", "b"]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_mutual_information_over_many_ranges(spark, parts):
    """A rare class and tied values: intervals that span ranges, neighbours beyond them; against plain counting."""
    rng = random.Random(6)
    rows = [(f"r{i}", 1 if i % 61 == 0 else 0, rng.gauss(0, 1) + (i % 61 == 0), float(rng.randrange(4)), None if i % 9 else 1.5 * i) for i in range(2400)]
    df = spark.createDataFrame(rows, "row_id string, label int, a double, b double, c double").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["feature"]: r["mi"] for r in sl.mutual_information(df, ["a", "b", "c"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {"a", "b", "c"}
    one = sl.mutual_information(df.coalesce(1), ["a", "b", "c"])
    want = {r["feature"]: r["mi"] for r in one.collect()}
    assert all(abs(got[f] - want[f]) < 1e-9 for f in got)
    v = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    near = np.abs(v[:, None] - v[None])
    d = np.array([np.sort(near[i][y == y[i]])[5] for i in range(len(v))])
    m = np.array([(near[i] < d[i]).sum() for i in range(len(v))])
    digamma = lambda n: sl._digammas(np.asarray(n, float))
    nx = np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    plain = digamma(len(v)) + digamma(5) - digamma(nx).mean() - digamma(m).mean()
    assert abs(got["a"] - max(0.0, float(plain))) < 1e-6


def test_ranges_are_sorted_by_value_without_numbering_keys(monkeypatch):
    import numpy as np
    import pandas as pd
    from flowguard.operators import selection as sl

    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"feature": rng.integers(0, 2, 500), "y": rng.integers(0, 2, 500), "v": rng.integers(-50, 50, 500), "nx": 9, "_slice": rng.integers(3, 5, 500)})
    want = {k: part.sort_values(["v", "y"], ignore_index=True) for k, part in rows.groupby(["feature", "_slice"])}

    def no_sort(*args, **kwargs):
        raise AssertionError("pandas' sort by several keys costs three times numpy's")

    monkeypatch.setattr(pd.DataFrame, "sort_values", no_sort)
    got = {(f, no): part for f, no, part in sl._ranges(iter([rows.iloc[:123], rows.iloc[123:]]))}
    assert list(got) == sorted(want) and all(got[k][["v", "y"]].equals(want[k][["v", "y"]]) for k in want)
    assert list(sl._ranges(iter([rows.iloc[:0]]))) == []

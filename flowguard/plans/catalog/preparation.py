"""Training preparation over the labelled flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.fixtures import duckdb_view, spark_view
from flowguard.operators import prep as pp, selection as sl
from flowguard.plans.registry import query

FEATURES = ["f_quantity", "f_price", "f_nullable", "f_skewed", "f_constant"]

LABELLED = (
    f"WITH raw AS ({duckdb_view('labelled')}), labelled AS (SELECT *, trim(coalesce(Label, 'nan')) AS attack_type, "
    "CASE WHEN lower(trim(coalesce(Label, 'nan'))) = 'benign' THEN 0 ELSE 1 END AS label_ FROM raw)"
)


def labelled(spark, sf):
    return pp.binarise_label(pp.normalise_label(spark_view(spark, sf, "labelled")))


@query("read_flows", f"WITH raw AS ({duckdb_view('labelled')}) SELECT count(*) AS n, count(DISTINCT row_id) AS ids, round(sum(f_price), 2) AS price FROM raw")
def read_flows(spark, sf):
    from flowguard.sources.flows import read_flows as scan

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    from flowguard import fixtures

    flows = scan(spark, sf, "lineitem.parquet")
    view = spark.sql(fixtures.VIEWS["labelled"], lineitem=flows)
    return view.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.round(F.sum("f_price"), 2).alias("price"))


@query("normalise_label", LABELLED + "SELECT row_id, attack_type FROM labelled")
def normalise_label(spark, sf):
    return labelled(spark, sf).select("row_id", "attack_type")


@query("binarise_label", LABELLED + "SELECT row_id, label_ AS label FROM labelled")
def binarise_label(spark, sf):
    return labelled(spark, sf).select("row_id", "label")


@query("class_profile", LABELLED + "SELECT count(*) FILTER (label_=0) AS benign, count(*) FILTER (label_=1) AS attack, count(DISTINCT attack_type) FILTER (label_=1) AS attack_types FROM labelled")
def class_profile(spark, sf):
    return pp.class_profile(labelled(spark, sf))


@query("drop_listed", LABELLED + "SELECT row_id, f_quantity, f_price FROM labelled")
def drop_listed(spark, sf):
    # Two listed constants are present, one is not; only the listed ones go.
    wide = labelled(spark, sf).withColumns({"CWE Flag Count": F.lit(0), "Fwd URG Flags": F.lit(0)})
    return pp.drop_listed(wide).drop("Label", "attack_type", "label", "f_nullable", "f_skewed", "f_constant")


@query("numeric_only", LABELLED + "SELECT label_ AS label, f_quantity, f_price, f_nullable, f_skewed, f_constant FROM labelled")
def numeric_only(spark, sf):
    return pp.numeric_only(labelled(spark, sf))


SKEW = "coalesce(skewness({0}), 0)"  # DuckDB's skewness is already bias-corrected


@query(
    "column_skewness",
    LABELLED
    + "SELECT feature, round(s, 6) AS skewness, abs(s) > 5 AS selected FROM (SELECT "
    + ", ".join(f"coalesce(nullif(skewness({c}), 'nan'::DOUBLE), 0) AS {c}" for c in FEATURES)
    + " FROM labelled) UNPIVOT (s FOR feature IN ("
    + ", ".join(FEATURES)
    + "))",
)
def column_skewness(spark, sf):
    one = labelled(spark, sf).agg(*[pp.skewness_of(F.col(c)).alias(c) for c in FEATURES])
    long = one.unpivot([], FEATURES, "feature", "s")
    return long.select("feature", F.round("s", 6).alias("skewness"), (F.abs("s") > pp.SKEW_THRESHOLD).alias("selected"))


@query("signed_log1p", LABELLED + "SELECT row_id, round(sign(f_skewed) * ln(1 + abs(f_skewed)), 9) AS f_skewed, round(ln(1 + f_price), 9) AS f_price FROM labelled")
def signed_log1p(spark, sf):
    out = pp.signed_log1p(labelled(spark, sf), ["f_skewed", "f_price"])
    return out.select("row_id", F.round("f_skewed", 9).alias("f_skewed"), F.round("f_price", 9).alias("f_price"))


@query("zero_variance", LABELLED + "SELECT row_id, f_quantity, f_price, f_nullable, f_skewed FROM labelled WHERE (SELECT var_samp(f_constant) FROM labelled) = 0")
def zero_variance(spark, sf):
    return pp.drop_zero_variance(labelled(spark, sf), FEATURES).drop("Label", "attack_type", "label")


BROKEN = LABELLED + ", broken AS (SELECT row_id, CASE WHEN f_quantity = 1 THEN 'inf'::DOUBLE WHEN f_quantity = 2 THEN 'nan'::DOUBLE WHEN f_quantity = 3 THEN '-inf'::DOUBLE ELSE f_price END AS v FROM labelled)"


def broken(spark, sf):
    x = F.col("f_quantity")
    v = (
        F.when(x == 1, F.lit(float("inf"))).when(x == 2, F.lit(float("nan"))).when(x == 3, F.lit(float("-inf"))).otherwise(F.col("f_price"))
    )
    return labelled(spark, sf).select("row_id", v.alias("v"))


@query("nonfinite_to_null", BROKEN + "SELECT row_id, CASE WHEN isfinite(v) THEN v END AS v FROM broken")
def nonfinite_to_null(spark, sf):
    return pp.nonfinite_to_null(broken(spark, sf), ["v"])


@query(
    "impute_median",
    LABELLED + "SELECT row_id, coalesce(f_nullable, (SELECT median(f_nullable) FROM labelled)) AS f_nullable, (SELECT count(*) FROM labelled WHERE f_nullable IS NULL) AS imputed FROM labelled",
)
def impute_median(spark, sf):
    df = labelled(spark, sf)
    n = pp.missing_count(df, ["f_nullable"]).first()[0]
    return pp.impute_median(df, ["f_nullable"]).select("row_id", "f_nullable", F.lit(n).cast("long").alias("imputed"))


@query("subsample", LABELLED + "SELECT row_id FROM labelled ORDER BY md5(concat('42|', row_id)) LIMIT 50000")
def subsample(spark, sf):
    return pp.subsample(labelled(spark, sf), 50_000, 42).select("row_id")


MI_FEATURES = ["f_quantity", "f_price", "f_skewed"]
PSI = "(ln({0}+6.0::DOUBLE) - 0.5/({0}+6.0::DOUBLE) - 1/(12*pow({0}+6.0::DOUBLE,2)) + 1/(120*pow({0}+6.0::DOUBLE,4)) - 1/(252*pow({0}+6.0::DOUBLE,6)) - 1.0/{0} - 1.0/({0}+1) - 1.0/({0}+2) - 1.0/({0}+3) - 1.0/({0}+4) - 1.0/({0}+5))"


def _psi(x: str) -> str:
    return PSI.format(f"CAST({x} AS DOUBLE)")


MI = (
    LABELLED
    + f""", s AS (SELECT *, md5(concat('42|', row_id)) AS h FROM labelled),
l AS (SELECT label_ AS y, h, feature, x FROM s UNPIVOT (x FOR feature IN ({", ".join(MI_FEATURES)}))),
st AS (SELECT feature, avg(x) AS mu, stddev_pop(x) AS sd, greatest(1, avg(abs(x)) / stddev_pop(x)) AS sc FROM l GROUP BY feature),
p AS (SELECT l.feature, y, h, CAST(round((x - mu) / sd * 1e15) AS BIGINT) + CAST(round((CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE - 0.5) * 3.4641016151377544::DOUBLE * 1e-10 * sc * 1e15) AS BIGINT) AS v
  FROM l JOIN st ON l.feature = st.feature),
n AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nx,
  list_sort(list_filter([v - lag(v,1) OVER w, v - lag(v,2) OVER w, v - lag(v,3) OVER w, v - lag(v,4) OVER w, v - lag(v,5) OVER w,
    lead(v,1) OVER w - v, lead(v,2) OVER w - v, lead(v,3) OVER w - v, lead(v,4) OVER w - v, lead(v,5) OVER w - v], lambda g: g IS NOT NULL))[5] AS dist
  FROM p WINDOW w AS (PARTITION BY feature, y ORDER BY v, h)),
m AS (SELECT *, greatest(dist - 1, 0) AS r FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m FROM m),
mi AS (SELECT feature, greatest(0, {_psi("count(*)")} + {_psi("5")} - avg({_psi("nx")}) - avg({_psi("m")})) AS mi FROM c GROUP BY feature)"""
)


@query("mutual_information", MI + " SELECT feature, round(mi, 4) AS mi FROM mi")
def mutual_information(spark, sf):
    return sl.mutual_information(labelled(spark, sf), MI_FEATURES).select("feature", F.round("mi", 4).alias("mi"))


@query("select_by_mi", MI + " SELECT feature, mi > (SELECT quantile_cont(mi, 0.1) FROM mi) AS kept FROM mi")
def select_by_mi(spark, sf):
    return sl.select_by_mi(sl.mutual_information(labelled(spark, sf), MI_FEATURES)).select("feature", "kept")




@query(
    "split_with_repeated_ids",
    LABELLED
    + """, g AS (SELECT label_, count(*) AS n FROM labelled GROUP BY ALL),
z AS (SELECT *, CAST(ceil(n * 0.3::DOUBLE) AS BIGINT) AS rem FROM g)
SELECT label_ AS label, split, c AS n FROM (
  SELECT label_, 'train' AS split, n - rem AS c FROM z WHERE label_ = 0
  UNION ALL SELECT label_, 'val', rem - CAST(ceil(rem * 0.5) AS BIGINT) FROM z WHERE label_ = 0
  UNION ALL SELECT label_, 'test', CAST(ceil(rem * 0.5) AS BIGINT) FROM z WHERE label_ = 0
  UNION ALL SELECT label_, 'val', n - CAST(ceil(n * 0.5) AS BIGINT) FROM z WHERE label_ = 1
  UNION ALL SELECT label_, 'test', CAST(ceil(n * 0.5) AS BIGINT) FROM z WHERE label_ = 1)""",
)
def split_with_repeated_ids(spark, sf):
    """Sizes are exact although two ids stand for all rows and rows repeat."""
    few = labelled(spark, sf).select((F.col("f_quantity") > 25).cast("string").alias("row_id"), "label", "attack_type")
    return pp.one_class_split(few).groupBy(F.col("label").cast("int").alias("label"), "split").agg(F.count(F.lit(1)).alias("n"))


SPLIT = (
    LABELLED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY label_ ORDER BY md5(concat('42|', row_id))) AS rn, count(*) OVER (PARTITION BY label_) AS n FROM labelled),
z AS (SELECT *, CAST(ceil(n * 0.3::DOUBLE) AS BIGINT) AS rem FROM r),
split AS (SELECT *, CASE WHEN label_ = 0 THEN CASE WHEN rn <= n - rem THEN 'train' WHEN rn <= n - CAST(ceil(rem * 0.5) AS BIGINT) THEN 'val' ELSE 'test' END
  ELSE CASE WHEN rn <= n - CAST(ceil(n * 0.5) AS BIGINT) THEN 'val' ELSE 'test' END END AS split FROM z)"""
)


def split(spark, sf):
    return pp.one_class_split(labelled(spark, sf), 42)


@query("one_class_split", SPLIT + "SELECT row_id, split, CASE WHEN label_ = 0 THEN 'Benign' ELSE attack_type END AS attack_type FROM split")
def one_class_split(spark, sf):
    return split(spark, sf).select("row_id", "split", "attack_type")


SCALE_COLS = ["f_quantity", "f_price", "f_skewed"]
SCALER = SPLIT + ", sc AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in SCALE_COLS) + " FROM split WHERE split = 'train')"


def scaler(spark, sf):
    return pp.fit_scaler(split(spark, sf).filter("split = 'train'"), SCALE_COLS)


@query("fit_scaler", SCALER + " UNION ALL ".join(f" SELECT '{c}' AS feature, round(m_{c}, 4) AS mean, round(s_{c}, 4) AS scale FROM sc" for c in SCALE_COLS))
def fit_scaler(spark, sf):
    p = scaler(spark, sf)
    rows = list(zip(p.feature_names, [round(x, 4) for x in p.mean], [round(x, 4) for x in p.scale]))
    return spark.createDataFrame(rows, "feature string, mean double, scale double")


@query("apply_scaler", SCALER + "SELECT row_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in SCALE_COLS) + " FROM split, sc")
def apply_scaler(spark, sf):
    rows = split(spark, sf)
    out = pp.apply_scaler(rows, pp.fit_scaler(rows.filter("split = 'train'"), SCALE_COLS))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in SCALE_COLS])


# Serving with stored constants: f_constant has scale 0 and maps to 0, f_skewed is log-transformed first.
STORED = pp.ScalerParams([25.0, 30000.0, 2.0, 5.0], [14.0, 20000.0, 3.0, 0.0], ["f_quantity", "f_price", "f_skewed", "f_constant"], ["f_skewed", "not_a_feature"])


@query(
    "transform_features",
    LABELLED + "SELECT row_id, round((f_quantity-25)/14, 9) AS f_quantity, round((f_price-30000)/20000, 9) AS f_price, round((sign(f_skewed)*ln(1+abs(f_skewed))-2)/3, 9) AS f_skewed, 0.0::DOUBLE AS f_constant FROM labelled",
)
def transform_features(spark, sf):
    out = pp.transform_features(labelled(spark, sf), STORED, ["row_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("f_quantity", "f_price", "f_skewed")})


@query("apply_scaler_serve", LABELLED + "SELECT row_id, (f_quantity-25)/14 AS f_quantity, 0.0::DOUBLE AS f_constant FROM labelled")
def apply_scaler_serve(spark, sf):
    p = pp.ScalerParams([25.0, 5.0], [14.0, 0.0], ["f_quantity", "f_constant"])
    return pp.apply_scaler(labelled(spark, sf), p, serve=True).select("row_id", "f_quantity", "f_constant")

"""Training preparation: labels, cleaning, transforms, sampling, splits, scaling."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowguard.functions.stats import col
from flowguard.operators.quantiles import Cut, exact_percentiles, hash_cutoffs

# Label and column conventions of the labelled flow tables.
LABEL_COLUMN = "Label"
BENIGN_LABEL = "Benign"
CONSTANT_COLUMNS = [
    "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
    "Fwd URG Flags",
    "Bwd URG Flags",
    "CWE Flag Count",
    "ECE Flag Count",
]

# Ratios and thresholds.
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.70, 0.15, 0.15
ATTACK_TEST_RATIO = 0.5
SKEW_THRESHOLD = 5.0
SAMPLE_ROWS = 50_000
SEED = 42
SCALE_EPSILON = 1e-10


def q(name: str) -> Column:
    """Column by exact name (names may hold dots, blanks and slashes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_label(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """``attack_type``: the label as trimmed text; a missing label becomes the text ``nan`` (counts as attack)."""
    if label not in df.columns:
        raise KeyError(f"label column {label!r} not found")
    return df.withColumn("attack_type", F.btrim(F.coalesce(q(label).cast("string"), F.lit("nan")), F.lit(" \t\r\n")))


def binarise_label(df: DataFrame) -> DataFrame:
    """``label``: 0 for benign (any case), 1 for everything else; takes the place of a raw ``Label`` column."""
    return df.withColumn("label", F.when(F.lower("attack_type") == BENIGN_LABEL.lower(), 0).otherwise(1))


def class_profile(df: DataFrame) -> DataFrame:
    """Benign rows, attack rows and distinct attack types."""
    attack = F.col("label") == 1
    return df.agg(
        F.count_if(~attack).alias("benign"),
        F.count_if(attack).alias("attack"),
        F.count_distinct(F.when(attack, F.col("attack_type"))).alias("attack_types"),
    )


def drop_listed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.drop(*[c for c in (CONSTANT_COLUMNS if columns is None else columns) if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Numeric columns (plus the named ones)."""
    kept = keep or []
    names = numeric_columns(df)
    return df.select(*[q(c) for c in df.columns if c in kept or c in names])


def _missing_as_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def skewness_of(c: Column) -> Column:
    """Bias-corrected sample skewness; constant -> 0, below three values -> null, infinite values -> NaN."""
    x = _missing_as_null(c)
    n = F.count(x).cast("double")
    g = F.coalesce(F.skewness(x), F.lit(0.0))
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def column_skewness(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    row = df.agg(*[skewness_of(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: row[i] for i, c in enumerate(cols)}


def skewed_columns(df: DataFrame, cols: list[str] | None = None, threshold: float = SKEW_THRESHOLD) -> list[str]:
    """Columns with abs(skewness) above the threshold, from one aggregate over all columns."""
    names = cols or numeric_columns(df)
    skew = column_skewness(df, names)
    return [c for c in names if skew[c] is not None and not math.isnan(skew[c]) and abs(skew[c]) > threshold]


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def signed_log1p(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: signed_log(q(c).cast("double")) for c in cols}) if cols else df


def zero_variance_columns(df: DataFrame, cols: list[str]) -> list[str]:
    row = df.agg(*[F.var_samp(_missing_as_null(q(c))).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[i] is not None and row[i] == 0.0]


def drop_zero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*zero_variance_columns(df, cols))


def finite(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nonfinite_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(q(c)) for c in cols})


def impute_median(df: DataFrame, cols: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Null -> exact column median (over the whole table unless ``medians`` is given)."""
    fitted = medians or column_medians(df, cols)
    return df.withColumns({c: F.coalesce(q(c), F.lit(fitted[c])) for c in cols if fitted[c] is not None})


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_percentiles(df, {c: [0.5] for c in cols}).items()}


def missing_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many values an imputation would fill."""
    total = sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0))
    return df.agg(total.alias("missing"))


def row_hash(seed: int, *id_columns: Column | str) -> Column:
    """Hex hash of the seed and the row id: the same order at any partitioning, portable across engines."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in id_columns]))


#: Hex digits of ``row_key``, and of the ``row_hash`` at its head.
KEY_DIGITS, HASH_DIGITS = 48, 32
COPIES_PER_TASK = 65_536


def row_key(df: DataFrame, seed: int, id_columns: list[str]) -> Column:
    """``row_hash`` followed by a hash of the whole row: only rows equal in every column share it, whatever ids repeat."""
    content = F.lower(F.lpad(F.hex(F.xxhash64(*[q(c) for c in df.columns])), 16, "0"))
    return F.concat(row_hash(seed, *id_columns), content)


def _numbered_ties(keyed: DataFrame, group: str, cuts: list[Cut]) -> DataFrame:
    """``_copy``: running number of the rows that share a key which a cut divides; 0 for all other rows.

    Such rows are equal in every column, so they are counted and written out again with numbers.
    """
    keys = sorted({c.prefix for c in cuts if c.take is not None})
    if not keys:
        return keyed.withColumn("_copy", F.lit(0).cast("long"))
    at_cut = F.col("_k").isin(keys)
    names = keyed.columns
    counted = keyed.filter(at_cut).groupBy(*[q(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    # more than one row per key only if two rows collide in all bits of the key
    order = Window.partitionBy(group, "_k").orderBy(F.xxhash64(F.lit(1), *[q(c) for c in names])).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    lots = before.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES_PER_TASK).cast("long")))).repartition("_k", "_lot")
    first = F.col("_lot") * COPIES_PER_TASK + 1
    copies = F.explode(F.sequence(first, F.least(first + COPIES_PER_TASK - 1, F.col("_n"))))
    tied = lots.withColumn("_i", copies).select(*[q(c) for c in names], (F.col("_before") + F.col("_i")).alias("_copy"))
    return keyed.filter(~at_cut).withColumn("_copy", F.lit(0).cast("long")).unionByName(tied)


def _inside(cut: Cut) -> Column:
    if not cut.prefix:
        return F.lit(False)
    if cut.take is None:
        return F.substring("_h" if len(cut.prefix) <= HASH_DIGITS else "_k", 1, len(cut.prefix)) <= cut.prefix
    return F.struct("_k", "_copy") <= F.struct(F.lit(cut.prefix).alias("_k"), F.lit(cut.take).cast("long").alias("_copy"))


def subsample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = SEED, id_columns: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are fewer): those with the smallest seeded keys (a filter, no sort)."""
    ids = id_columns or ["row_id"]
    keyed = df.withColumns({"_k": row_key(df, seed, ids), "_h": row_hash(seed, *ids), "_g": F.lit(0)})
    _, cuts = hash_cutoffs(keyed, "_k", "_g", lambda g, total: [n] if total > n else [], KEY_DIGITS, "_h", HASH_DIGITS)
    if not cuts:
        return df
    cut = next(iter(cuts.values()))
    return _numbered_ties(keyed, "_g", [cut]).filter(_inside(cut)).drop("_k", "_h", "_g", "_copy")


def split_sizes(n: int, test_ratio: float) -> tuple[int, int]:
    """(kept, held out); the held-out side is rounded up."""
    held = math.ceil(n * test_ratio)
    return n - held, held


def one_class_split(df: DataFrame, seed: int = SEED, id_columns: list[str] | None = None) -> DataFrame:
    """``split`` column: benign 70/15/15 train/val/test, attacks 50/50 val/test, so train is benign only.

    Rows are ranked by seeded key inside their class; only the three cut keys are computed, and the
    assignment itself is a filter-like projection without shuffle. Sizes are exact, also with repeated ids.
    """
    ids = id_columns or ["row_id"]
    remainder = (VAL_RATIO + TEST_RATIO) / (TRAIN_RATIO + VAL_RATIO + TEST_RATIO)
    test_of_remainder = TEST_RATIO / (VAL_RATIO + TEST_RATIO)

    def ranks(label: int, n: int) -> list[int]:
        if label == 0:
            train, rest = split_sizes(n, remainder)
            val, _ = split_sizes(rest, test_of_remainder)
            return [train, train + val]
        return [split_sizes(n, ATTACK_TEST_RATIO)[0]]

    keyed = df.withColumns({"_k": row_key(df, seed, ids), "_h": row_hash(seed, *ids)})
    totals, cuts = hash_cutoffs(keyed, "_k", "label", ranks, KEY_DIGITS, "_h", HASH_DIGITS)
    benign, attack = F.col("label") == 0, F.col("label") == 1
    split = F.lit("test")
    if 1 in totals:
        split = F.when(attack & _inside(cuts[1, ranks(1, totals[1])[0]]), "val").otherwise(split)
    if 0 in totals:
        train, val = (_inside(cuts[0, k]) for k in ranks(0, totals[0]))
        split = F.when(benign & train, "train").when(benign & val, "val").otherwise(split)
    out = _numbered_ties(keyed, "label", list(cuts.values())).withColumn("split", split).drop("_k", "_h", "_copy")
    if "attack_type" in df.columns:
        out = out.withColumn("attack_type", F.when(benign, F.lit(BENIGN_LABEL)).otherwise(F.col("attack_type")))
    return out


@dataclass
class ScalerParams:
    """Scaling constants with the feature order and the transforms applied before scaling."""

    mean: list[float]
    scale: list[float]
    feature_names: list[str]
    log_transformed_columns: list[str] = field(default_factory=list)
    dropped_mi_columns: list[str] = field(default_factory=list)

    @property
    def n_features(self) -> int:
        return len(self.feature_names)

    SCHEMA = (
        "mean array<double>, scale array<double>, feature_names array<string>, n_features bigint, "
        "log_transformed_columns array<string>, dropped_mi_columns array<string>"
    )

    def to_df(self, spark) -> DataFrame:
        row = (
            self.mean, self.scale, self.feature_names, self.n_features,
            self.log_transformed_columns, self.dropped_mi_columns,
        )
        return spark.createDataFrame([row], self.SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame) -> "ScalerParams":
        r = df.first()
        if not (len(r["mean"]) == len(r["scale"]) == len(r["feature_names"]) == r["n_features"]):
            raise ValueError("scaler arrays and n_features disagree")
        return cls(
            list(r["mean"]), list(r["scale"]), list(r["feature_names"]),
            list(r["log_transformed_columns"]), list(r["dropped_mi_columns"]),
        )


def fit_scaler(train: DataFrame, cols: list[str], log_cols: list[str] | None = None, dropped: list[str] | None = None) -> ScalerParams:
    """Mean and population standard deviation per column (zero -> 1), one aggregate."""
    row = train.agg(
        *[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    mean = [row[f"m{i}"] for i in range(len(cols))]
    scale = [row[f"s{i}"] or 1.0 for i in range(len(cols))]
    return ScalerParams(mean, scale, list(cols), list(log_cols or []), list(dropped or []))


def scaled(params: ScalerParams, i: int, value: Column, serve: bool) -> Column:
    mean, scale = params.mean[i], params.scale[i]
    if serve and not abs(scale) > SCALE_EPSILON:
        return F.lit(0.0)
    return (value - F.lit(mean)) / F.lit(scale)


def apply_scaler(df: DataFrame, params: ScalerParams, serve: bool = False) -> DataFrame:
    """(x - mean) / scale with literal constants; ``serve`` maps a vanishing scale to 0.0."""
    return df.withColumns({c: scaled(params, i, q(c).cast("double"), serve) for i, c in enumerate(params.feature_names)})


def transform_features(df: DataFrame, params: ScalerParams, keep: list[str] | None = None, serve: bool = True) -> DataFrame:
    """Log-transform then scale, in the stored feature order; a missing feature column is an error."""
    missing = [c for c in params.feature_names if c not in df.columns]
    if missing:
        raise ValueError(f"expected {params.n_features} features, missing: {missing}")
    logged = set(params.log_transformed_columns)
    out = []
    for i, c in enumerate(params.feature_names):
        x = q(c).cast("double")
        out.append(scaled(params, i, signed_log(x) if c in logged else x, serve).alias(c))
    return df.select(*[q(c) for c in (keep or [])], *out)

"""Running-statistics blocks and zero-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: str, den: str) -> str:
    """SQL text of num / den, 0.0 where the divisor is not positive."""
    return f"if({den} > 0, CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE), 0D)"


def stats_block(prefix: str, value: Column | str, when: Column | None = None) -> list[Column]:
    """count, sum, min, max, mean, sample variance and std; empty -> 0, one value -> variance 0."""
    v = col(value).cast("double")
    if when is not None:
        v = F.when(when, v)
    zero = F.lit(0.0)
    return [
        F.count(v).alias(f"{prefix}_count"),
        F.coalesce(F.sum(v), zero).alias(f"{prefix}_sum"),
        F.coalesce(F.min(v), zero).alias(f"{prefix}_min"),
        F.coalesce(F.max(v), zero).alias(f"{prefix}_max"),
        F.coalesce(F.avg(v), zero).alias(f"{prefix}_mean"),
        F.coalesce(F.var_samp(v), zero).alias(f"{prefix}_var"),
        F.coalesce(F.stddev_samp(v), zero).alias(f"{prefix}_std"),
    ]


def moments_variance(n: str, total: str, squares: str) -> str:
    """SQL text of the sample variance from exact integer moments, 0 below two values.

    (n * Sum x^2 - (Sum x)^2) / (n * (n - 1)) with a DECIMAL numerator: the cancelling difference is
    exact, so the result is the same double whatever the order in which partial sums were merged.
    """
    spread = (
        f"CAST(CAST({n} AS DECIMAL(12,0)) * CAST({squares} AS DECIMAL(28,0)) AS DECIMAL(38,0))"
        f" - CAST(CAST({total} AS DECIMAL(19,0)) * CAST({total} AS DECIMAL(19,0)) AS DECIMAL(38,0))"
    )
    return f"if({n} > 1, CAST({spread} AS DOUBLE) / (CAST({n} AS DOUBLE) * (CAST({n} AS DOUBLE) - 1)), 0D)"

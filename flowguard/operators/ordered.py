"""Ordered computations that never put a whole key, or the whole table, into one task.

Rows are cut into slices of their ordering value. A slice is sorted by one task; across slices only
one summary row per slice is ordered, and the carried value is joined back on (keys, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.session import materialise

FANOUT = 4096


def time_slice(ts_us: str, seconds: float) -> Column:
    return F.floor(F.col(ts_us) / F.lit(int(seconds * 1_000_000))).cast("long")


def prefix_offsets(cells: DataFrame, keys: list[str], slice_col: str, values: list[str]) -> DataFrame:
    """Exclusive running sums of per-slice values, in two levels (groups of slices, then slices in a group)."""
    grouped = cells.withColumn("_group", F.floor(F.col(slice_col) / FANOUT).cast("long"))
    inner = Window.partitionBy(*keys, "_group").orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    outer_keys = keys or [F.lit(0)]
    outer = Window.partitionBy(*outer_keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    group_totals = grouped.groupBy(*keys, "_group").agg(*[F.sum(v).alias(f"_g_{v}") for v in values])
    group_offsets = group_totals.select(
        *keys, "_group", *[F.coalesce(F.sum(f"_g_{v}").over(outer), zero).alias(f"_o_{v}") for v in values]
    )
    local = grouped.select(
        *keys, slice_col, "_group", *[F.coalesce(F.sum(v).over(inner), zero).alias(f"_i_{v}") for v in values]
    )
    return local.join(group_offsets, [*keys, "_group"]).select(
        *keys, slice_col, *[(F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"{v}_before") for v in values]
    )


def _sliced(df: DataFrame, keys: list[str], slice_value: Column) -> DataFrame:
    # The explicit exchange is shared by the summary branch and the row branch, so the input is computed once.
    return df.withColumn("_slice", slice_value).repartition(*keys, "_slice")


def number_rows(df: DataFrame, keys: list[str], slice_value: Column, order_by: list[str], out: str = "row_no") -> DataFrame:
    """1-based row number per key (or over the table when ``keys`` is empty)."""
    sliced = _sliced(df, keys, slice_value)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_offsets(counts, keys, "_slice", ["_n"])
    w = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    numbered = sliced.withColumn("_local", F.row_number().over(w).cast("long")).join(offsets, [*keys, "_slice"])
    return numbered.withColumn(out, F.col("_local") + F.col("_n_before")).drop("_slice", "_local", "_n_before")


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    slice_value: Column,
    order_by: list[str],
    values: list[str],
    previous: str | None = None,
    following: str | None = None,
) -> DataFrame:
    """struct columns with ``order_by`` and ``values`` of the previous and/or next row of the key."""
    sliced = _sliced(df, keys, slice_value)
    row = F.struct(*order_by, *[v for v in values if v not in order_by])
    sides = [(previous, F.max, F.lag, "_last"), (following, F.min, F.lead, "_first")]
    sides = [s for s in sides if s[0]]
    edges = sliced.groupBy(*keys, "_slice").agg(*[pick(row).alias(edge) for _, pick, _, edge in sides])
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = edges.select(*keys, "_slice", *[step(edge).over(across).alias(f"{edge}_carried") for _, _, step, edge in sides])
    w = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    near = sliced.withColumns({f"{edge}_near": step(row).over(w) for _, _, step, edge in sides})
    joined = near.join(carried, [*keys, "_slice"])
    return joined.select(
        *df.columns, *[F.coalesce(f"{edge}_near", f"{edge}_carried").alias(out) for out, _, _, edge in sides]
    )


def last_marked(df: DataFrame, keys: list[str], slice_value: Column, time: str, mark: Column, out: str) -> DataFrame:
    """Time of the key's last row, up to and including this row's time, for which ``mark`` holds."""
    sliced = _sliced(df.withColumn("_at", F.when(mark, F.col(time))), keys, slice_value)
    edges = sliced.groupBy(*keys, "_slice").agg(F.max("_at").alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, "_slice", F.max("_edge").over(across).alias("_carried"))
    w = Window.partitionBy(*keys, "_slice").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sliced.withColumn("_near", F.max("_at").over(w)).join(carried, [*keys, "_slice"])
    return joined.select(*df.columns, F.coalesce("_near", "_carried").alias(out))


def ranged(df: DataFrame, order_by: list[str], out: str = "_slice") -> DataFrame:
    """Rows dealt to ranges of ``order_by`` of similar size, ``out`` numbers the ranges in order.

    Spark samples the range bounds, so a key with very many rows spans several ranges. The result is written
    once: all readers see the same ranges.
    """
    return materialise(df.repartitionByRange(*order_by).withColumn(out, F.spark_partition_id().cast("long")))


def number_ranged(df: DataFrame, keys: list[str], order_by: list[str], out: str) -> DataFrame:
    """0-based row number per key of rows that ``ranged`` dealt by (keys, order_by)."""
    counts = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    local = df.withColumn("_local", F.row_number().over(w).cast("long") - 1)
    placed = local.join(prefix_offsets(counts, keys, "_slice", ["_n"]), [*keys, "_slice"])
    return placed.withColumn(out, F.col("_local") + F.col("_n_before")).drop("_local", "_n_before", "_slice")


def blocks_with_context(df: DataFrame, row_no: str, block_rows: int, before: int) -> DataFrame:
    """Fixed-size blocks of numbered rows; the last ``before`` rows of a block are repeated as context of the next."""
    if before >= block_rows:
        raise ValueError("context must be shorter than a block")
    at = F.col(row_no) - 1
    block = F.floor(at / block_rows).cast("long")
    own = F.struct(block.alias("block"), F.lit(False).alias("context"))
    copy = F.struct((block + 1).alias("block"), F.lit(True).alias("context"))
    tail = F.pmod(at, F.lit(block_rows)) >= block_rows - before
    placed = df.withColumn("_place", F.explode(F.when(tail, F.array(own, copy)).otherwise(F.array(own))))
    return placed.withColumns({"_block": F.col("_place.block"), "_context": F.col("_place.context")}).drop("_place")


def rolling(
    df: DataFrame, keys: list[str], slice_value: Column, order_by: list[str], size: int, columns: dict, block_rows: int = 65_536
) -> DataFrame:
    """Columns over the last ``size`` rows of each key; ``columns`` maps a name to ``window -> Column``."""
    numbered = number_rows(df, keys, slice_value, order_by, "_row")
    placed = blocks_with_context(numbered, "_row", max(block_rows, size + 1), size - 1)
    w = Window.partitionBy(*keys, "_block").orderBy("_row").rowsBetween(-(size - 1), 0)
    out = placed.withColumns({name: make(w) for name, make in columns.items()})
    return out.filter(~F.col("_context")).drop("_row", "_block", "_context")


def sums_at(changes: DataFrame, steps: list[str], moments: DataFrame, slice_s: float = 1.0) -> DataFrame:
    """Sums of ``steps`` over all ``changes`` (at_us, steps) up to and including each distinct ``moments.at_us``.

    Changes are summed per time, times inside a slice by a running sum, slices by prefix sums.
    """
    zero = [F.lit(0).cast("long").alias(s) for s in steps]
    told = changes.select(F.col("at_us").cast("long").alias("at_us"), *[F.col(s).cast("long").alias(s) for s in steps], F.lit(False).alias("_asked"))
    asked = moments.select(F.col("at_us").cast("long").alias("at_us"), *zero, F.lit(True).alias("_asked"))
    events = told.unionByName(asked).groupBy("at_us").agg(*[F.sum(s).alias(s) for s in steps], F.max("_asked").alias("_asked"))
    sliced = events.withColumn("_slice", time_slice("at_us", slice_s)).repartition("_slice")
    totals = sliced.groupBy("_slice").agg(*[F.sum(s).alias(s) for s in steps])
    upto = Window.partitionBy("_slice").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0)
    read = sliced.withColumns({f"_to_{s}": F.sum(s).over(upto) for s in steps}).filter("_asked")
    return read.join(prefix_offsets(totals, [], "_slice", steps), "_slice").select("at_us", *[(F.col(f"_to_{s}") + F.col(f"{s}_before")).alias(s) for s in steps])


def latest(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The last row of each key (combined map-side, no sort of the key)."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order_by, F.struct(*rest).alias("_rest"))).alias("_top"))
    return picked.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in order_by], "_top._rest.*")

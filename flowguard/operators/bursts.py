"""Greedy spacing: from each accepted row the next one at least ``gap`` later is accepted, and so on.

The rule is a chain, but what a time slice does to it is a small function: where the chain enters (the first row at least
``gap`` after the last accepted one, which is among the slice's first ``gap`` of time or right after them) decides where it
leaves. Slices are turned into such functions by separate tasks, functions are composed in groups, groups in order, and the
entry found for each slice goes back to it. No task walks a whole burst.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: "Nothing accepted yet", and "this function leaves the last accepted time as it is".
NEVER, SAME = -(1 << 62), -(1 << 61)
SLICE_US = 1_000_000
GROUP_SLICES = 4096


def slice_function(times: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits): the last accepted time after a slice for each time at which the chain may enter it."""
    t = np.unique(times)
    jump = np.searchsorted(t, t + gap)
    at = np.where(jump < len(t), jump, np.arange(len(t)))
    while True:  # pointer doubling, as often as the logarithm of the longest chain in the slice
        further = at[at]
        if (further == at).all():
            break
        at = further
    entries = int(np.searchsorted(t, start + gap)) + 1
    return t[:entries], t[at][:entries]


def applied(last: np.ndarray, entries: np.ndarray, exits: np.ndarray, missed: int, gap: int) -> np.ndarray:
    """The function at each of ``last``; ``missed`` is the exit of a chain that skips the first slice."""
    at = np.searchsorted(entries, np.maximum(last, NEVER) + gap)
    inside = at < len(entries)
    return np.where(inside, exits[np.minimum(at, len(exits) - 1)], last if missed == SAME else missed)


def composed(functions: list[tuple[np.ndarray, np.ndarray, int]], gap: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One function for consecutive ones."""
    entries, exits, missed = functions[0]
    for nxt in functions[1:]:
        exits = applied(exits, *nxt, gap)
        # who skips the first slice enters the next one at its first row
        missed = int(nxt[1][0]) if missed == SAME else int(applied(np.array([missed]), *nxt, gap)[0])
    return entries, exits, missed


def _listed(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    return [(np.asarray(e, np.int64), np.asarray(x, np.int64), int(m)) for e, x, m in zip(frame["entries"], frame["exits"], frame["missed"], strict=True)]


def accepted_rows(rows: DataFrame, keys: list[str], order_by: list[str], gap: int, slice_us: int = SLICE_US) -> DataFrame:
    """The rows of each key that greedy spacing accepts, in the order of ``order_by`` (a time, then ties)."""
    time, width, columns, schema = order_by[0], max(slice_us, gap), rows.columns, rows.schema
    if gap <= 0:
        return rows
    sliced = rows.withColumn("_slice", F.floor(F.col(time) / width).cast("long"))
    named = [f for f in sliced.schema if f.name in keys]
    place = StructType([*named, StructField("_slice", LongType())])
    body = StructType.fromDDL("entries array<bigint>, exits array<bigint>, missed bigint")
    placed, function = place.fieldNames(), body.fieldNames()
    cells = StructType([*place, *body])
    group = F.floor(F.col("_slice") / GROUP_SLICES).cast("long")

    def to_function(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        entries, exits = slice_function(part[time].to_numpy(np.int64), int(first["_slice"]) * width, gap)
        return pd.DataFrame([(*(first[k] for k in placed), entries, exits, SAME)], columns=[*placed, *function])

    def to_group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_slice", ignore_index=True)
        first = part.iloc[0]
        return pd.DataFrame([(*(first[k] for k in keys), int(first["_group"]), *composed(_listed(part), gap))], columns=[*keys, "_group", *function])

    def entered(part: pd.DataFrame, by: str) -> pd.DataFrame:
        """``last`` before each function, from ``last`` before the first (NEVER if the column is not there)."""
        part = part.sort_values(by, ignore_index=True)
        last, before = int(part["last"].iloc[0]) if "last" in part else NEVER, []
        for f in _listed(part):
            before.append(last)
            last = int(applied(np.array([last]), *f, gap)[0])
        return part[[*keys, by]].assign(last=before)

    def mark(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order_by, ignore_index=True)
        t = part[time].to_numpy(np.int64)
        taken, at = [], int(np.searchsorted(t, part["last"].iloc[0] + gap))
        while at < len(t):
            taken.append(at)
            at = int(np.searchsorted(t, t[at] + gap))
        return part.iloc[taken][columns]

    functions = sliced.select(*keys, "_slice", time).groupBy(*keys, "_slice").applyInPandas(to_function, cells).withColumn("_group", group)
    groups = StructType([*named, StructField("_group", LongType()), *body])
    of_groups = functions.groupBy(*keys, "_group").applyInPandas(to_group, groups)
    group_last = StructType([*named, StructField("_group", LongType()), StructField("last", LongType())])
    slice_last = StructType([*place, StructField("last", LongType())])
    before_groups = of_groups.groupBy(*keys).applyInPandas(lambda part: entered(part, "_group"), group_last)
    with_last = functions.join(before_groups, [*keys, "_group"])
    before_slices = with_last.groupBy(*keys, "_group").applyInPandas(lambda part: entered(part, "_slice"), slice_last)
    return sliced.join(before_slices, [*keys, "_slice"]).groupBy(*keys, "_slice").applyInPandas(mark, schema)

"""Exact order statistics without collecting a column into one task.

Percentiles: a rank is bracketed by values of a quantile sketch, then rows are counted exactly against those
values. A round finds the value or leaves an open interval with at most about 6 / ACCURACY of the rows, so
ten thousand million rows take three rounds. No arithmetic is done on values, so any finite double will do.

Hash cuts: prefix counts, three hex digits more per pass, and all digits at once as soon as few rows are left
around a cut. A pass ends the search when the cut falls on the edge of a prefix; the number of passes is bounded
by the key's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000
PREFIX_DIGITS = 3
#: With at most so many rows around each open cut, the next pass counts whole keys.
LAST_ROWS = 65_536


def exact_percentiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linear-interpolated percentiles of non-null values; NaN and infinities must be null already."""
    cols = list(wanted)
    if not cols:
        return {}
    xs = [F.col(f"`{c}`").cast("double") for c in cols]
    sizes = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)]).first()
    ranks = [sorted({r for p in wanted[c] for r in (math.floor(p * (sizes[i] - 1)), math.ceil(p * (sizes[i] - 1)))}) if sizes[i] else [] for i, c in enumerate(cols)]
    values = _order_statistics(df, xs, list(sizes), ranks, accuracy)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        row: list[float | None] = []
        for p in wanted[c]:
            at = p * (sizes[i] - 1)
            row.append(_between(values[i, math.floor(at)], values[i, math.ceil(at)], at - math.floor(at)) if sizes[i] else None)
        out[c] = row
    return out


def _between(lo: float, hi: float, share: float) -> float:
    value = lo + (hi - lo) * share
    return value if math.isfinite(value) else lo * (1 - share) + hi * share


def _order_statistics(df: DataFrame, xs: list, sizes: list[int], ranks: list[list[int]], accuracy: int) -> dict[tuple[int, int], float]:
    values: dict[tuple[int, int], float] = {}
    # rank -> open interval (low, high) that holds it, rows before it, rows inside
    open_ = {(i, k): (None, None, 0, sizes[i]) for i, ks in enumerate(ranks) for k in ks}
    while open_:
        probes = _probes(df, xs, open_, accuracy)
        marks = []
        for i, vs in probes.items():
            # 2 j: between probes j - 1 and j; 2 j + 1: equal to probe j
            place = sum(((xs[i] > F.lit(v)).cast("int") + (xs[i] >= F.lit(v)).cast("int") for v in vs), F.lit(0))
            marks.append(F.when(xs[i].isNotNull(), F.struct(F.lit(i).alias("i"), place.alias("place"))))
        rows = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.i", "m.place").count().collect()
        counted: dict[int, dict[int, int]] = {}
        for r in rows:
            counted.setdefault(r["i"], {})[r["place"]] = r["count"]
        for i, k in list(open_):
            below, vs = 0, probes[i]
            for place in range(2 * len(vs) + 1):
                n = counted[i].get(place, 0)
                if k < below + n:
                    break
                below += n
            if place % 2:
                values[i, k] = vs[place // 2]
                del open_[i, k]
            else:
                j = place // 2
                open_[i, k] = (vs[j - 1] if j else None, vs[j] if j < len(vs) else None, below, n)
    return values


def _probes(df: DataFrame, xs: list, open_: dict, accuracy: int) -> dict[int, list[float]]:
    """Per column the sorted values to count against: for each rank three from the sketch of its interval, and the interval's ends."""
    intervals: dict[tuple, list[float]] = {}
    for (i, k), (low, high, below, n) in open_.items():
        at = (k - below + 0.5) / n
        near = 2.0 / accuracy
        intervals.setdefault((i, low, high), []).extend(min(1.0, max(0.0, p)) for p in (at - near, at, at + near))
    sketches = []
    for m, ((i, low, high), shares) in enumerate(intervals.items()):
        inside = xs[i].isNotNull()
        inside = inside & (xs[i] > F.lit(low)) if low is not None else inside
        inside = inside & (xs[i] < F.lit(high)) if high is not None else inside
        sketches.append(F.percentile_approx(F.when(inside, xs[i]), shares, accuracy).alias(f"s{m}"))
    found = df.agg(*sketches).first()
    out: dict[int, set[float]] = {}
    for values, (i, low, high) in zip(found, intervals, strict=True):
        out.setdefault(i, set()).update(v for v in (*values, low, high) if v is not None)
    return {i: sorted(vs) for i, vs in out.items()}


@dataclass(frozen=True)
class Cut:
    """Rows whose key starts below or with ``prefix``; with ``take``, of the rows equal to it only so many."""

    prefix: str
    take: int | None = None


def _shortest(keys: list[str], key: str, width: int) -> str:
    """The shortest prefix of ``key``, of ``width`` digits at least, that no larger one of ``keys`` starts with."""
    following = min((k for k in keys if k > key), default=None)
    if following is not None:
        width = max(width, 1 + next(i for i, (a, b) in enumerate(zip(key, following, strict=True)) if a != b))
    return key[:width]


def hash_cutoffs(df: DataFrame, key_col: str, group_col: str, wanted, digits: int, head_col: str | None = None, head_digits: int = 0) -> tuple[dict, dict[tuple, Cut]]:
    """Cuts after the k smallest hex keys (of ``digits`` digits) per group: ({group: rows}, {(group, k): Cut}).

    ``wanted`` maps a row count to the counts needed: ``wanted(group, n) -> list[k]`` (0 gives the empty prefix).
    ``head_col`` holds the first ``head_digits`` digits of the key, if these cost less than the whole key.
    """
    width = min(PREFIX_DIGITS, digits)

    def first(n: int) -> Column:
        return F.substring(head_col if head_col and n <= head_digits else key_col, 1, n)

    def counts(rows: DataFrame) -> list:
        return rows.groupBy(F.col(group_col).alias("g"), first(width).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()

    rows = counts(df)
    totals: dict = {}
    for r in rows:
        totals[r["g"]] = totals.get(r["g"], 0) + r["n"]
    cuts: dict[tuple, Cut] = {(g, k): Cut("") for g, n in totals.items() for k in wanted(g, n) if k <= 0}
    open_ = {(g, k): ("", 0) for g, n in totals.items() for k in wanted(g, n) if k > 0}
    while open_:
        around = []
        for (g, k), (start, below) in list(open_.items()):
            near = sorted((r for r in rows if r["g"] == g and r["p"].startswith(start)), key=lambda r: r["p"])
            for r in near:
                if k <= below + r["n"]:
                    break
                below += r["n"]
            if k == below + r["n"]:
                cuts[g, k] = Cut(_shortest([o["p"] for o in near], r["p"], max(1, len(start))))
                del open_[g, k]
            elif width == digits:
                cuts[g, k] = Cut(r["p"], k - below)
                del open_[g, k]
            else:
                open_[g, k] = (r["p"], below)
                around.append(r["n"])
        if open_:
            width = digits if max(around) <= LAST_ROWS else min(width + PREFIX_DIGITS, digits)
            # one mention of the key: a filter is pushed below the projection that makes it, and would work it out for each
            places = {f"{g}:{start}" for (g, _), (start, _) in open_.items()}
            at = F.concat(F.coalesce(F.col(group_col).cast("string"), F.lit("None")), F.lit(":"), first(len(next(iter(open_.values()))[0])))
            rows = counts(df.filter(at.isin(sorted(places))))
    return totals, cuts

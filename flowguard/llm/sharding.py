"""Shards of near equal bytes by a minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are ordered by their smallest doc_id and never split. The smallest feasible shard
capacity is found by binary search with a greedy check over block sums. Blocks that may hold a cut are
split again, level by level, until those blocks are single groups; each level is one aggregation and
brings at most a few thousand block sums to the driver, whatever the number of groups. Among the cuts within
that capacity the most even ones (least sum of squares) are taken, so a large group leaves no shard empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.llm.common import stage
from flowguard.operators.ordered import prefix_offsets

FIRST_BLOCKS, NEXT_BLOCKS, TOP_GROUPS, MOST_RANGES = 4096, 1024, 1024, 48
SLOT_ROWS = 1024
EVEN_STEPS = 1024  # the even cuts are chosen among about so many places of equal bytes


@dataclass
class Blocks:
    """Sums over disjoint ranges of the ordering value, in order. A block with low == high is atomic."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    @property
    def atomic(self) -> np.ndarray:
        return self.low == self.high

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def _reach(ends: np.ndarray, from_size: int, capacity: int) -> int:
    """Number of whole blocks that end at or before ``from_size + capacity``."""
    return int(np.searchsorted(ends, from_size + capacity, side="right"))


def whole_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (block counts) with blocks kept whole, or None if ``capacity`` does not suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        at = _reach(ends, int(ends[at - 1]) if at else 0, capacity)
        cuts.append(at)
    return cuts if at == len(ends) else None


def even_cuts(ends: np.ndarray, cuts: list[int], capacity: int) -> list[int]:
    """The cuts with the least sum of squared sizes, all within ``capacity``; ``cuts`` are some that fit."""
    total, shards = int(ends[-1]), len(cuts)
    edges = np.concatenate([[0], ends])
    marks = np.searchsorted(ends, total * np.arange(EVEN_STEPS + 1, dtype=float) / EVEN_STEPS)
    places = np.unique(np.concatenate([[0, len(ends)], cuts, marks, marks + 1]).clip(0, len(ends)))
    at = edges[places]
    size = at[None, :] - at[:, None]  # from row to column
    cost = np.where((size >= 0) & (size <= capacity), size.astype(float) ** 2, np.inf)
    best, chosen = cost[0], []
    for _ in range(shards - 1):
        sums = best[:, None] + cost
        chosen.append(sums.argmin(axis=0))
        best = sums.min(axis=0)
    end, out = len(places) - 1, [len(ends)]
    for before in reversed(chosen):
        end = int(before[end])
        out.append(int(places[end]))
    return out[::-1]


def _could_fit(blocks: Blocks, capacity: int, shards: int) -> bool:
    """Greedy check where blocks of several groups may be cut anywhere: False proves ``capacity`` too small."""
    ends, atomic, at = blocks.ends, blocks.atomic, 0
    for _ in range(shards):
        reach = at + capacity
        k = int(np.searchsorted(ends, reach, side="right"))
        if k == len(ends):
            return True
        at = (int(ends[k - 1]) if k else 0) if atomic[k] else reach
    return False


def _smallest(low: int, high: int, holds) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _open_blocks(blocks: Blocks, low: int, high: int, shards: int) -> np.ndarray:
    """Non-atomic blocks in which a cut may lie for some capacity from ``low`` to ``high``."""
    ends = blocks.ends
    starts, total = ends - blocks.size, int(ends[-1])
    first = last = 0
    wanted = np.zeros(len(ends), dtype=bool)
    for _ in range(shards):
        k = int(np.searchsorted(ends, first + low, side="right"))
        first = total if k == len(ends) else max(first, int(starts[k]))
        last = min(total, last + high)
        wanted |= (ends > first) & (starts <= last)
    return wanted & ~blocks.atomic


def _sums(groups: DataFrame, ranges: list[tuple[int, int, int]]) -> Blocks:
    """Sums of the groups inside ``ranges`` (low, high, parts), each range cut into up to ``parts`` equal widths.

    The largest groups become blocks of their own, so that what is left in a block is small.
    """
    block, inside = F.lit(None).cast("string"), F.lit(False)
    for n, (low, high, parts) in enumerate(ranges):
        width = max(1, -(-(high - low + 1) // parts))
        here = F.col("place").between(low, high)
        offset = F.floor((F.col("place").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)"))
        block = F.when(here, F.concat(F.lit(f"{n}:"), offset.cast("string"))).otherwise(block)
        inside = inside | here
    placed = groups.filter(inside).select("place", "bytes", block.alias("block"))
    top = [tuple(r) for r in placed.orderBy(F.desc("bytes"), "place").limit(TOP_GROUPS).collect()]
    by_block: dict[str, list[int]] = {}
    for place, _, name in top:
        by_block.setdefault(name, []).append(place)
    splits = placed.sparkSession.createDataFrame(list(by_block.items()), "block string, places array<long>")
    rest = (
        placed.join(F.broadcast(splits), "block", "left")
        .filter("places IS NULL OR NOT array_contains(places, place)")
        .groupBy("block", F.coalesce(F.size(F.filter("places", lambda p: p < F.col("place"))), F.lit(0)).alias("after"))
        .agg(F.min("place").alias("low"), F.max("place").alias("high"), F.sum("bytes").alias("size"))
        .collect()
    )
    rows = sorted([(r["low"], r["high"], int(r["size"])) for r in rest] + [(place, place, size) for place, size, _ in top])
    return Blocks(*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3)))


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity for ``shards`` contiguous parts of groups (place, bytes), and the last place of each part but the last.

    ``place`` is a long that orders the groups, each place once. A level makes the widest open block at least four times
    narrower, so at most 32 levels resolve any long; a few suffice in practice.
    """
    edge = groups.agg(F.min("place"), F.max("place")).first()
    if edge[0] is None:
        return 0, []
    blocks = _sums(groups, [(edge[0], edge[1], FIRST_BLOCKS)])
    while True:
        ends = blocks.ends
        total = int(ends[-1])
        least = max(-(-total // shards), int(blocks.size[blocks.atomic].max(initial=0)))
        low = _smallest(least, total, lambda c: _could_fit(blocks, c, shards))
        high = _smallest(low, total, lambda c: whole_cuts(ends, c, shards) is not None)
        again = _open_blocks(blocks, low, high, shards)
        if not again.any():  # blocks too coarse for even cuts are split too
            again = (blocks.size > -(-total // EVEN_STEPS)) & ~blocks.atomic
        if not again.any():
            cuts = even_cuts(ends, whole_cuts(ends, high, shards), high)
            return high, [int(blocks.high[c - 1]) if c else int(edge[0]) - 1 for c in cuts[:-1]]
        joined: list[list[int]] = []
        for k in np.flatnonzero(again):
            if k and again[k - 1]:
                joined[-1][1:] = [int(blocks.high[k]), joined[-1][2] + 1]
            else:
                joined.append([int(blocks.low[k]), int(blocks.high[k]), 1])
        finer = _sums(groups, _nearest(joined))
        gone = np.zeros(len(again), dtype=bool)
        for a, b, _ in _nearest(joined):
            gone |= (blocks.low >= a) & (blocks.high <= b)
        merged = [np.concatenate([getattr(blocks, f)[~gone], getattr(finer, f)]) for f in ("low", "high", "size")]
        order = np.argsort(merged[0], kind="stable")
        blocks = Blocks(*(m[order] for m in merged))


def _nearest(ranges: list[list[int]]) -> list[tuple[int, int, int]]:
    """At most MOST_RANGES ranges, by closing the narrowest gaps; parts are four times the blocks inside."""
    ranges = [list(r) for r in ranges]
    while len(ranges) > MOST_RANGES:
        k = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
        ranges[k : k + 2] = [[ranges[k][0], ranges[k + 1][1], ranges[k][2] + ranges[k + 1][2] + 1]]
    return [(a, b, 4 * max(n, NEXT_BLOCKS // len(ranges))) for a, b, n in ranges]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1 (null text counts as empty). Equal texts stay together, so a shard is
    larger than the average only where one group is. slot numbers the rows of a shard from 0 in a
    hash-random order; rows equal in doc_id, size and text are interchangeable. A null doc_id orders first.
    An empty table gives an empty result.
    """
    rows = stage(_rows(docs), "shard-rows")
    groups = stage(
        rows.groupBy("group").agg(
            F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("place"), F.sum("size").alias("bytes")
        ),
        "shard-groups",
    )
    places = stage(groups.groupBy("place").agg(F.sum("bytes").alias("bytes")), "shard-places")
    _, cuts = minimax_cuts(places, shards)
    number: Column = F.lit(0)
    for cut in cuts:
        number = number + (F.col("place") > cut).cast("int")
    buckets = -(-max(1, rows.count()) // (shards * SLOT_ROWS))
    placed = (
        rows.join(stage(groups.select("group", number.alias("shard")), "shard-of-group"), "group")
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
        .repartition("shard", "bucket")
    )
    before = prefix_offsets(placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), ["shard"], "bucket", ["n"])
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "group")
    return (
        placed.withColumn("inner", F.row_number().over(order) - 1)
        .join(before, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("n_before") + F.col("inner")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

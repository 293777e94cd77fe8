"""Near-duplicate groups by one-permutation hashing with optimal densification.

Documents with equal shingle sets are one node. A node's signature takes one permutation of its shingle
hashes, cut into bins; empty bins borrow from others by a fixed random walk per bin (optimal
densification). Bands of the signature are buckets. Buckets yield star-shaped candidate edges only: from
one hub to the other members, first with the node that meets most others as hub, then with hubs that differ by bucket,
and only to members of other components. What is still apart in a bucket after that is compared across components,
so that no link is lost. A pair is compared only if a bitmap of each set does not rule it out: elements whose bit the
other set lacks cannot be common, so the bound never rejects a link. Every edge is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import give_back, sized, stage

BANDS, ROWS = 40, 6  # a pair of similarity 0.8 misses all buckets with probability 5e-6
BINS = BANDS * ROWS
STAR_ROUNDS = 3
HELD_WORDS = 150_000  # word hashes that a task keeps
MAP_WORDS = 16  # 64-bit words of a set's bitmap
_ATTEMPTS = 4096
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words = words

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > HELD_WORDS:
                    self.clear()
                self[word] = value = xxhash.xxh3_64_intdigest(word)
                return value

        self.hashes = Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and the six separators only
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                out = _mixed(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def _walks() -> np.ndarray:
    """For every attempt and bin the bin to borrow from."""
    with np.errstate(over="ignore"):
        cell = np.arange(_ATTEMPTS * BINS, dtype=np.uint64) + _U(0x5851F42D4C957F2D)
        return (_mixed(_mixed(cell)) % _U(BINS)).astype(np.int64).reshape(_ATTEMPTS, BINS)


def signatures(sets: list[np.ndarray], walks: np.ndarray) -> np.ndarray:
    """One row of BINS values per non-empty set."""
    values = np.zeros((len(sets), BINS), dtype=np.uint64)
    filled = np.zeros((len(sets), BINS), dtype=bool)
    for i, h in enumerate(sets):
        bins = ((h >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
        values[i, bins[first]] = h[first]
        filled[i, bins[first]] = True
    row, column = np.nonzero(~filled)
    for attempt in range(_ATTEMPTS):
        if not len(row):
            break
        source = walks[attempt, column]
        good = filled[row, source]
        values[row[good], column[good]] = values[row[good], source[good]]
        row, column = row[~good], column[~good]
    for r, c in zip(row, column, strict=True):  # practically never
        values[r, c] = values[r, np.flatnonzero(filled[r])[0]]
    return values


def bucket_ids(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS)).copy()
        banded = values.reshape(len(values), BANDS, ROWS)
        for k in range(ROWS):
            out = _mixed(out * _U(0x9E3779B97F4A7C15) + banded[:, :, k])
    return out.view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle, in MAP_WORDS words; equal shingles of two sets have equal bits."""
    bits = np.zeros(MAP_WORDS * 64, dtype=np.uint8)
    bits[(shingles & _U(MAP_WORDS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_link(percent: int) -> Column:
    """Whether sets a and b of n_a and n_b shingles, bitmaps map_a and map_b, can be similar enough; never false for a link.

    Each bit that only one set has stands for at least one shingle that the other lacks.
    """
    common = sum((F.bit_count(F.col(f"a{i}").bitwiseAND(F.col(f"b{i}"))) for i in range(MAP_WORDS)), F.lit(0))
    most = F.least(F.col("n_a") - F.col("ones_a"), F.col("n_b") - F.col("ones_b")) + common
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


#: What a side of a comparison has besides its bucket and bitmap: column, name before the side's letter.
_SIDE = (("node", ""), ("n_node", "n"), ("label", "label"), ("ones", "ones"))

SIGNED = "doc_id long, text_key long, n_shingles long, node long, buckets array<long>, map array<long>"


def _signed(words: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, walks = Shingler(words), _walks()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [shingle(t.as_py()) for t in part.column("text")]
                some = [s for s in sets if len(s)]
                ids = bucket_ids(signatures(some, walks)) if some else np.empty((0, BANDS), dtype=np.int64)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                maps = np.concatenate([bitmap(s) for s in some]) if some else np.empty(0, dtype=np.int64)
                map_ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, MAP_WORDS, 0))]).astype(np.int32)
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(sizes),
                        pa.array(nodes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.ravel())),
                        pa.ListArray.from_arrays(pa.array(map_ends), pa.array(maps)),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "buckets", "map"],
                )
        del shingle
        give_back()

    return sign


def _full_sets(words: int):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = pa.array([shingle(t.as_py()).tobytes() for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), found], ["node", "shingles"])
        del shingle
        give_back()

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))  # without a copy of the sets
        give_back()

    return confirm


def components(edges: DataFrame) -> DataFrame:
    """Labels (node, label: smallest node reachable) of the nodes of ``edges`` (a, b), by rounds of smallest labels and jumps.

    A round is three joins on staged tables, so a hub with very many edges can be split; nothing is collected.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-both")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lowered = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "m").alias("low"))
        onward = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = stage(
            lowered.join(onward, lowered["low"] == onward["at"]).select("node", F.least("low", "further").alias("label"), (F.least("low", "further") != F.col("label")).alias("moved")),
            "near-labels",
        )
        labels = moved.select("node", "label")
        if not moved.filter("moved").limit(1).count():
            return labels


def near_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key (tells texts under one doc_id apart).

    Words are lower-cased in A-Z and split at space and tab to carriage return; a text with fewer words than a
    shingle is one shingle, a text without words (or null) has none and is linked with nothing. Texts are linked
    if 100 * intersection >= percent * union. component_id is the smallest doc_id of the component, kept
    marks that document; rows with that doc_id repeated are all marked, a null doc_id only if there is no other.
    """
    signed = stage(
        _own(docs).mapInArrow(_signed(shingle_words), SIGNED),
        "near-signed",
    )
    full = signed.filter("node IS NOT NULL")
    nodes = stage(
        full.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"), F.first("map").alias("map")
        ),
        "near-nodes",
    )
    buckets = nodes.select(F.explode("buckets").alias("bucket"), "node", "n")
    shared = stage(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-shared")
    met = stage(buckets.join(shared, "bucket"), "near-buckets")
    in_play = stage(met.groupBy("node").agg(F.sum("members").alias("weight")), "near-candidates")
    sets = _candidate_sets(docs, nodes, in_play, shingle_words)
    wanted = stage(met.join(in_play, "node").select("bucket", "node", F.col("n").alias("n_node"), "weight"), "near-wanted")
    similar = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b"))
        return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirm(percent), "a long, b long"), "near-edges")

    def ordered(pairs: DataFrame) -> DataFrame:
        return stage(pairs.filter(similar).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    hubs = wanted.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("a"), F.col("n_node").alias("n_a")), F.struct("weight", "node")).alias("hub"))
    hubs = stage(hubs.select("bucket", "hub.*"), "near-hubs")
    star = hubs.join(wanted, "bucket").filter("a != node").select("a", "n_a", F.col("node").alias("b"), F.col("n_node").alias("n_b"))
    tried = ordered(star)
    edges = confirmed(tried)
    for turn in range(1, STAR_ROUNDS + 1):
        labels = components(edges)
        marked = wanted.join(labels, "node", "left").select("bucket", "node", "n_node", F.coalesce("label", "node").alias("label"))
        split = stage(marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket"), "near-split")
        maps = nodes.select("node", F.aggregate("map", F.lit(0), lambda n, word: n + F.bit_count(word)).alias("ones"), "map")
        apart = stage(marked.join(split, "bucket").join(maps, "node"), "near-apart")
        if not apart.limit(1).count():
            break
        left, right = (apart.select("bucket", *[F.col(c).alias(f"{new}_{s}" if new else s) for c, new in _SIDE], *[F.col("map")[i].alias(f"{s}{i}") for i in range(MAP_WORDS)]) for s in "ab")
        if turn < STAR_ROUNDS:
            pick = F.xxhash64("a", "bucket", F.lit(turn))
            # a quarter of the buckets at a time: what one quarter joins, the next need not compare
            left = left.filter(F.pmod("bucket", F.lit(4)) == turn)
            left = stage(left.groupBy("bucket").agg(F.min_by(F.struct(*left.drop("bucket").columns), pick).alias("hub")).select("bucket", "hub.*"), "near-hubs")
            once = F.lit(True)
        else:
            # what stars left apart: members of all components but the largest label's, against the others
            held = apart.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("held"))
            most = stage(held.groupBy("bucket").agg(F.max_by("label", F.struct("held", "label")).alias("most")), "near-most")
            left = stage(left.join(most, "bucket").filter("label_a != most"), "near-rest")
            once = F.expr("label_b = most OR a < b")  # of two outside the largest, one order is enough
        crossing = left.join(right, "bucket").filter("label_a != label_b").filter(similar).filter(once).filter(may_link(percent))
        fresh = stage(ordered(crossing).join(tried, ["a", "b"], "left_anti"), "near-fresh")
        edges = stage(edges.union(confirmed(fresh)), "near-edges")
        tried = tried.union(fresh)
    labels = components(edges)
    placed = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = stage(placed.join(stage(smallest, "near-smallest"), "label").select("node", "component_id"), "near-of-node")
    linked = full.select("doc_id", "n_shingles", "node", "text_key").join(of_node, "node").select("doc_id", "n_shingles", "component_id", "text_key")
    alone = signed.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    placed = linked.unionByName(alone)
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def _own(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _candidate_sets(docs: DataFrame, nodes: DataFrame, in_play: DataFrame, words: int) -> DataFrame:
    """Full shingle sets (node, shingles) of the nodes that share a bucket, from one text each.

    A node's smallest text hash names that text; exact copies of it meet again in the grouping, map-side first.
    """
    reps = stage(nodes.join(in_play, "node").select(F.col("node"), F.col("text_key").alias("rep")), "near-reps")
    joined = _own(docs).join(sized(reps, reps.count(), 24), F.col("text_key") == F.col("rep")).select("node", "text")
    one = joined.groupBy("node").agg(F.first("text").alias("text"))
    return stage(one.mapInArrow(_full_sets(words), "node long, shingles binary"), "near-sets")

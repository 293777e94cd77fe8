"""Benchmark decontamination by CGK embeddings of anchored pieces, with exact edit verification.

The CGK walk reads a word sequence from a start: at every step it emits the current word and a random bit of
(step, word) decides whether it moves on. An item is cut into one piece more than the edits it is allowed, so every
passage within its limit holds some piece unchanged, wherever the edits lie. Pieces anchor the walks: a piece's samples
are the steps that its walk spends inside it, so an unchanged piece gives equal samples for sure and no passage is
missed. A walk starts at every word of a text and ends at the first step whose samples no piece shares. Candidates are
verified by exact word edit distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import give_back

RATE = 0.1  # word edits allowed per word of an item, rounded down
STEPS = 16  # a piece is sampled at so many steps at most
MULTIPLIER = 0x5851F42D4C957F2D
BLOCK_CHARS = 8_000_000
CHUNK_WORDS = 400_000
CACHED_WORDS = 100_000  # digests kept by a task
_U = np.uint64
_WORD = re.compile(r"\w+")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        return value


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def moves(words: np.ndarray, step: int) -> np.ndarray:
    """The random bit of every (step, word)."""
    return ((words * _U(MULTIPLIER)) >> _U(40 + step)).astype(np.int64) & 1


def pieces(size: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of ``size`` words: one more than ``limit`` edits can touch, lengths near equal."""
    count = min(size, limit + 1)
    edges = [size * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _folded(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (key + words) * _U(0x9E3779B97F4A7C15) ^ ((key + words) >> _U(29))


def embed(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks from ``starts`` over pieces of ``lengths`` words: keys after every step (STEPS x starts), and the steps inside the piece.

    ``words`` must reach STEPS words past every start.
    """
    at, steps = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    key, keys = np.zeros(len(starts), dtype=np.uint64), []
    with np.errstate(over="ignore"):
        for step in range(STEPS):
            here = words[at]
            steps += at < starts + lengths
            key = _folded(key, here)
            keys.append(key)
            at = at + moves(here, step)
    return np.array(keys), steps


def best_end(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to a stretch of ``text``, and where the first such stretch ends (bit-parallel)."""
    n = len(pattern)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        places[w] |= 1 << i
    plus, minus, distance = mask, 0, n
    best = (n, 0)
    for j, w in enumerate(text):
        equal = places.get(w, 0)
        x = equal | minus
        diagonal = (((x & plus) + plus) ^ plus) | x
        up = minus | ~(diagonal | plus) & mask
        down = plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = (down | ~(diagonal | up)) & mask, up & diagonal
        if distance < best[0]:
            best = (distance, j + 1)
    return best


class Items:
    """The embedded items of one block."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        hashes = WordHashes()
        self.items = [(i, [hashes[w] for w in words_of(t)]) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.limits = [int(rate * len(w)) for _, w in self.items]
        #: Per step: which heads of keys some piece goes on with, the sorted keys of the pieces that end there, and their (item, start).
        self.steps: list[tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]] = []
        cut = [(k, a, n) for k, (_, w) in enumerate(self.items) for a, n in pieces(len(w), self.limits[k])]
        if not cut:
            return
        pad = np.zeros(STEPS, dtype=np.uint64)
        words = np.concatenate([np.array(x, dtype=np.uint64) for _, w in self.items for x in (w, pad)])
        firsts = np.cumsum([0, *(len(w) + STEPS for _, w in self.items)])
        owner, start, length = (np.array(c, dtype=np.int64) for c in zip(*cut, strict=True))
        keys, steps = embed(words, firsts[owner] + start, length)
        bits = min(20, max(16, len(cut).bit_length() + 3))
        self.shift = _U(64 - bits)
        for step in range(int(steps.max())):
            table = np.zeros(1 << bits, dtype=bool)
            table[(keys[step][steps > step] >> self.shift).astype(np.int64)] = True
            of: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for j in np.flatnonzero(steps == step + 1):
                of[int(keys[step][j])].append((int(owner[j]), int(start[j])))
            self.steps.append((table, np.array(sorted(of), dtype=np.uint64), dict(of)))

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position in ``starts``, item, start of the piece in the item) whose samples agree. ``words`` must reach STEPS zeros past every text."""
        at, live, key = starts, np.arange(len(starts)), np.zeros(len(starts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for step, (table, known, of) in enumerate(self.steps):
                here = words[at]
                key = _folded(key, here)
                good = np.flatnonzero(table[(key >> self.shift).astype(np.int64)])
                at, live, key, here = at[good], live[good], key[good], here[good]
                if not len(live):
                    return
                if len(known):
                    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    for k in np.flatnonzero(known[place] == key):
                        for item, start in of[int(key[k])]:
                            yield int(live[k]), item, start
                at = at + moves(here, step)

    def verify(self, words: list[int], start: int, item: int, least: int = 0) -> tuple[int, int, int] | None:
        """(distance, first word, end word) of the item near ``start`` and from word ``least`` on, if within its limit."""
        pattern, limit = self.items[item][1], self.limits[item]
        low = max(least, start - limit - 2)
        near = words[low : max(0, start + len(pattern) + limit + 2)]
        distance, end = best_end(pattern, near)
        if distance > limit or not end:
            return None
        _, back = best_end(pattern[::-1], near[:end][::-1])
        return distance, low + end - back, low + end


FOUND = "doc_id long, item_id long, start int, end int, distance int, item_words int"


def _search(items: list[tuple[int | None, str]], rate: float):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hashes = Items(items, rate), WordHashes()
        gap = STEPS

        def run(docs: list[tuple[int | None, str, np.ndarray]]) -> list[tuple]:
            pad = np.zeros(gap, dtype=np.uint64)
            words = np.concatenate([x for _, _, w in docs for x in (w, pad)])
            firsts = np.cumsum([0, *(len(w) + gap for _, _, w in docs)])
            starts = np.flatnonzero(words)
            hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for k, item, piece in block.candidates(words, starts):
                doc = int(np.searchsorted(firsts, starts[k], side="right")) - 1
                hits[doc, item].append((int(starts[k] - firsts[doc]), piece))
            rows = []
            for (doc, item), at in sorted(hits.items()):
                doc_id, text, w = docs[doc]
                own, spans, done = w.tolist(), None, 0
                for anchor, piece in sorted(at):
                    # a passage found earlier may end before this anchor, which then stands for another one
                    while done <= anchor and (match := block.verify(own, anchor - piece, item, done)):
                        distance, first, done = match
                        spans = spans or [m.span() for m in _WORD.finditer(text.lower())]
                        rows.append((doc_id, block.items[item][0], spans[first][0], spans[done - 1][1], distance, len(block.items[item][1])))
            return rows

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = [c.split()[0] for c in FOUND.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        held: list[tuple[int | None, str, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                words = words_of(text)
                if words:
                    held.append((doc_id, text, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
                    size += len(words)
                if size >= CHUNK_WORDS:
                    if rows := run(held):
                        yield batch_of(rows)
                    held, size = [], 0
        if held and (rows := run(held)):
            yield batch_of(rows)
        held.clear()
        hashes.clear()
        block = None  # freed before the rest is handed back
        give_back()

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Passages of benchmark items in documents: doc_id, item_id, start, end, distance, item_words.

    A passage is a stretch of words within ``rate`` word edits per item word (rounded down; items under ten words must be
    exact) after lower-casing and dropping everything but letters, digits and underscores. start and end are code
    points of the lower-cased text. Items or texts that are null or without words match nothing. The benchmark is read in blocks of
    bounded size, each against all documents; several far-apart passages of one item give several rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if rows:
            out = out.union(own.mapInArrow(_search([(r["item_id"], r["text"]) for r in rows], rate), FOUND))
    return out

"""Substring deduplication by content-defined chunking with a gear rolling hash.

A byte position is a boundary if the gear hash of the 16 bytes before it falls below a bound, so
boundaries depend on content alone and an insertion moves them only nearby. From every boundary a
variable chunk runs to the first boundary at least ``least`` bytes on. Chunks are deduplicated by digest:
one that occurs in two documents is repeated, and repeated chunks that touch form passages. A passage is
split where the first holder of its bytes changes, so that no holder loses what an earlier one does not have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import stage, text_key

SPACING = 22  # bytes between boundaries, on average
LEAST_CHUNK = 80
LEAST_PASSAGE = 120  # bytes; a passage loses about two spacings at its ends
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=77) & 0xFFFF for b in range(256)], dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after every byte, h = 2 h + G[byte] modulo 2**16, built by doubling the window."""
    h, width = _GEAR[data], 1
    while width < 16:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def chunks(data: bytes, spacing: int = SPACING, least: int = LEAST_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the variable chunks of ``data``; the text's own start and end are boundaries too."""
    if not data:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    seen = np.frombuffer(data, dtype=np.uint8)
    inner = np.flatnonzero(gear(seen)[:-1] < np.uint16(2**16 // spacing)) + 1
    inner = inner[seen[inner] & 0xC0 != 0x80]  # never inside a character
    edges = np.unique(np.concatenate([[0], inner, [len(data)]]))
    ends = np.searchsorted(edges, edges + least)
    good = ends < len(edges)
    return edges[good], edges[ends[good]]


CHUNK = "doc_id long, text_key long, digest_high long, digest_low long, start int, end int"


def _chunk_rows(spacing: int, least: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                digest, digests, starts, ends = xxhash.xxh3_128_digest, [], [], []
                for text in part.column("text"):
                    data = (text.as_py() or "").encode()
                    first, last = chunks(data, spacing, least)
                    digests += [digest(data[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    starts.append(first)
                    ends.append(last)
                halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
                row = pa.array(np.repeat(np.arange(len(starts)), [len(s) for s in starts]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(row),
                        part.column("text_key").take(row),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array(np.concatenate(starts).astype(np.int32)),
                        pa.array(np.concatenate(ends).astype(np.int32)),
                    ],
                    ["doc_id", "text_key", "digest_high", "digest_low", "start", "end"],
                )

    return rows


PASSAGE = "doc_id long, text_key long, start int, end int, first_doc_id long"


def _parts(least_passage: int):
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("hits")
            chunk = listed.flatten()
            if not len(chunk):
                continue
            starts, ends, firsts = (chunk.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            sizes = np.diff(listed.offsets.to_numpy())
            # the documents are laid end to end with gaps; chunks are in order, and their ends ascend with their starts
            last = np.cumsum(sizes) - 1
            base = np.concatenate([[0], np.cumsum(ends[last] + 1)])[:-1]
            starts, ends = starts + np.repeat(base, sizes), ends + np.repeat(base, sizes)
            edges = np.unique(np.concatenate([starts, ends]))
            low, high = np.searchsorted(ends, edges[:-1], side="right"), np.searchsorted(starts, edges[:-1], side="right")
            cells = np.flatnonzero(high > low)
            pairs = np.column_stack([low[cells], high[cells]]).ravel()
            first = np.minimum.reduceat(np.append(firsts, 0), pairs)[::2]
            opens = np.diff(cells, prepend=-2) > 1
            run = np.cumsum(opens) - 1
            run_bytes = np.bincount(run, weights=edges[cells + 1] - edges[cells])
            heads = np.flatnonzero(opens | (np.diff(first, prepend=first[0]) != 0))
            tails = np.append(heads[1:], len(cells)) - 1
            good = run_bytes[run[heads]] >= least_passage
            heads, tails = heads[good], tails[good]
            doc = np.searchsorted(base, edges[cells[heads]], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    batch.column("text_key").take(pa.array(doc)),
                    pa.array((edges[cells[heads]] - base[doc]).astype(np.int32)),
                    pa.array((edges[cells[tails] + 1] - base[doc]).astype(np.int32)),
                    pa.array(first[heads]),
                ],
                ["doc_id", "text_key", "start", "end", "first_doc_id"],
            )

    return parts


def repeated_passages(docs: DataFrame, spacing: int = SPACING, least_chunk: int = LEAST_CHUNK, least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """Passages that documents share: doc_id, start, end (UTF-8 byte offsets), n_bytes, first_doc_id, removed, text_key.

    Repeated chunks that touch count from ``least_passage`` bytes on. A byte's first document is the smallest doc_id that
    holds a chunk over it, and a run of chunks is split where that changes, so a part may be shorter than
    ``least_passage``. The first document keeps the part, removed marks the later ones. Repeats
    inside one document alone do not count, nor do rows without doc_id. Null and empty texts have no chunks.
    Different texts under one doc_id are told apart by ``text_key``; rows equal in both give one set of passages.
    """
    text = F.col("text").cast("string")
    own = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    digest = ["digest_high", "digest_low"]
    rows = own.mapInArrow(_chunk_rows(spacing, least_chunk), CHUNK)
    spread = rows.groupBy(*digest).agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    shared = stage(spread.filter("first_doc_id < last_doc_id").select(*digest, "first_doc_id"), "chunk-shared")
    hits = stage(rows.join(shared, digest).select("doc_id", "text_key", "start", "end", "first_doc_id"), "chunk-hits")
    chunk = F.struct("start", "end", "first_doc_id")
    by_doc = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(chunk)).alias("hits"))
    passages = by_doc.mapInArrow(_parts(least_passage), PASSAGE)
    return passages.withColumn("n_bytes", F.col("end") - F.col("start")).select(
        "doc_id", "start", "end", "n_bytes", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("removed"), "text_key"
    )


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, text) with the removed passages cut out of the texts; documents without any are left alone."""
    cuts = passages.filter("removed").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    return own.join(cuts, ["doc_id", "text_key"], "left").mapInArrow(_cut, "doc_id long, text string")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            if text is not None and spans:
                data, at, kept = text.encode(), 0, []
                for s in spans:
                    kept.append(data[at : s["start"]])
                    at = s["end"]
                text = b"".join([*kept, data[at:]]).decode("utf-8", "ignore")
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

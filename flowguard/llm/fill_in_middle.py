"""Fill-in-middle transformation: texts cut in three and put in another order, restorable from output and form.

A text is its UTF-8 bytes, in blocks of fixed size. A Fenwick tree over the blocks holds how many units and how many
code points start in each. A cut after k units descends the tree by binary lifting to the block where unit k starts and
is then located among that block's bytes alone; the same descent gives the code points before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 4096  # bytes
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # percent: texts drawn from here on stay as they are
SPM_BELOW = 20  # percent: of the others, so many start with the suffix
_BATCH_ROWS, _BATCH_BYTES = 256, 32 * 1024 * 1024  # an output batch ends at either
_SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def characters(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each code point (a text's first byte always is one)."""
    starts = (data & 0xC0) != 0x80
    starts[:1] = True
    return starts


def words(data: np.ndarray) -> np.ndarray:
    """Marks where a word begins; white space belongs to the word before it, at the start to the first."""
    gap = _SEPARATOR[data]
    starts = ~gap
    starts[1:] &= gap[:-1]
    first = int(np.argmax(starts)) if starts.any() else 0
    starts[first : first + 1] = False
    starts[:1] = True
    return starts


def lines(data: np.ndarray) -> np.ndarray:
    """Marks where a line begins."""
    starts = np.zeros(len(data), dtype=bool)
    starts[1:] = data[:-1] == 0x0A
    starts[:1] = True
    return starts


UNITS = {"character": characters, "word": words, "line": lines}


class BlockTree:
    """Fenwick tree over a text's blocks, with units and code points of each."""

    def __init__(self, data: bytes, unit: str = "character", block: int = BLOCK):
        seen = np.frombuffer(data, dtype=np.uint8)
        self.block, self.size = block, len(data)
        self.unit_starts = UNITS[unit](seen)
        self.char_starts = self.unit_starts if unit == "character" else characters(seen)
        edges = np.arange(0, len(data), block)
        blocks = len(edges)
        sums = np.zeros((blocks + 1, 2), dtype=np.int64)
        if blocks:
            sums[1:, 0] = np.cumsum(np.add.reduceat(self.unit_starts, edges, dtype=np.int64))
            sums[1:, 1] = np.cumsum(np.add.reduceat(self.char_starts, edges, dtype=np.int64))
        node = np.arange(blocks + 1)
        self.tree = (sums - sums[node - (node & -node)]).tolist()
        self.units, self.chars = sums[-1].tolist()

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code points before it) of the place after ``units`` units."""
        if units >= self.units:
            return self.size, self.chars
        at = units_before = chars_before = 0
        step = 1 << max(len(self.tree) - 1, 1).bit_length()
        while step:
            next_at = at + step
            if next_at < len(self.tree) and units_before + self.tree[next_at][0] <= units:
                at = next_at
                units_before += self.tree[at][0]
                chars_before += self.tree[at][1]
            step >>= 1
        low = at * self.block
        byte = low + int(np.flatnonzero(self.unit_starts[low : low + self.block])[units - units_before])
        return byte, chars_before + int(np.count_nonzero(self.char_starts[low:byte]))


OUTPUT = "doc_id long, n_units long, n_chars long, form string, prefix_chars long, middle_chars long, output binary"


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in OUTPUT.split(", ")])


def _rearrange(unit: str, block: int, plain_from: int, spm_below: int, marks: tuple[str, str, str]):
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)

    def one(data: bytes, h1: int, h2: int, h3: int, h4: int):
        tree = BlockTree(data, unit, block)
        if not data or h3 % 100 >= plain_from or any(m in data for m in (prefix_mark, suffix_mark, middle_mark)):
            return tree.units, tree.chars, "plain", None, None, data
        low, high = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
        (a, a_chars), (b, b_chars) = tree.cut(low), tree.cut(high)
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        if h4 % 100 < spm_below:
            form, parts = "spm", (suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)
        else:
            form, parts = "psm", (prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)
        return tree.units, tree.chars, form, a_chars, b_chars - a_chars, b"".join(parts)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            drawn = zip(*(batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)), strict=True)
            for doc_id, text, h in zip(batch.column("doc_id"), batch.column("text"), drawn, strict=True):
                made.append((doc_id.as_py(), *one(text.as_py(), *h)))
                held += len(made[-1][-1])
                if len(made) == _BATCH_ROWS or held >= _BATCH_BYTES:
                    yield _batch(made)
                    made, held = [], 0
            if made:
                yield _batch(made)

    return rows


def fill_in_middle(
    docs: DataFrame,
    unit: str = "character",
    block: int = BLOCK,
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """(doc_id, n_units, n_chars, form, prefix_chars, middle_chars, output) of each row of ``docs``.

    A text's draws come from the sha256 of ``seed:doc_id``, so reruns agree at any partitioning; a null doc_id draws as the
    empty text, and rows that share a doc_id draw alike. Null texts count as empty. Empty texts, texts that hold a mark
    and a share of the others stay as they are (form plain, no cuts). Units are characters (code points), words or lines.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(key, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    made = own.select("doc_id", "text", *drawn).mapInArrow(_rearrange(unit, block, plain_from, spm_below, marks), OUTPUT)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of: marks occur once each, since texts that hold one stay plain."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), 4)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    ordered = F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first))
    return F.when(form == "plain", output).otherwise(ordered)


def middle_digests(made: DataFrame) -> DataFrame:
    """The query's columns: sizes, form and digests of the output and of the text restored from it."""
    return made.select(
        "doc_id",
        F.col("n_chars").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: Counterpart of the query.
MIDDLE_SQL = f"""
WITH drawn AS (
  SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cuts AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS p, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS q,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS plain_draw, CAST('0x' || h[25:32] AS BIGINT) % 100 AS order_draw FROM drawn),
parts AS (
  SELECT doc_id, t, n, least(p, q) AS a, greatest(p, q) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR plain_draw >= {PLAIN_FROM} THEN 'plain'
              WHEN order_draw < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form,
         substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

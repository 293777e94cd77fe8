"""Toxicity scores from two class-conditional Kneser-Ney models over the letters of words.

Each class (toxic, ordinary) has its own counts of letters after up to four letters of the same word.
Where a class has not seen an expression, both fall back to the same Kneser-Ney continuation model of
the pooled counts, so rare expressions say nothing by themselves. Because the shared part cancels, a
word's log-likelihood ratio needs one value per seen n-gram and one per history. A text is scored by two
length-normalised figures: the largest ratio over windows of words, so that a passage in a long text
counts, and the share of words whose ratio is high. A logistic curve fitted on other labelled rows joins them.
Counts cover all labelled training rows, n-grams seen once included; windows cover whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from flowguard.llm.common import give_back, sized, stage, text_key

ORDER = 5
DISCOUNT = 0.75
WINDOW_WORDS = 4
HIGH_RATIO = 3.0
PIECE = 48  # a longer word is read in pieces of so many letters
HELD_WORDS = 200_000
#: Words looked up at a time.
CHUNK_WORDS = 50_000
#: Bits of a letter in a packed n-gram; 0 stands for no letter.
LETTER_BITS = 21
#: Tasks hold about so many entries of the model at a time; a larger model takes more passes over the texts, and drops nothing.
SLICE_ENTRIES = 1_000_000
#: Grid on which the curve is fitted: cells of both figures, so its size does not grow with the rows.
PEAK_STEP, PEAK_CELLS, SHARE_STEP = 0.1, 200, 0.01


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, without punctuation at the ends; words of punctuation alone are left out."""
    if not text:
        return []
    return [w for w in (x.strip(".,;:!?\"'()[]{}<>*_-") for x in text.lower().split()) if w]


def _ngrams(word: str) -> Iterator[str]:
    """Every letter (and the end mark) with its longest history of up to ORDER - 1 letters, start mark included."""
    marked = f"\x02{word}\x03"
    for i in range(1, len(marked)):
        yield marked[max(0, i - ORDER + 1) : i + 1]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list(set(counts[0]) | set(counts[1]))
        out = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(out, ["word", "toxic", "ordinary"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counter = counts[bool(toxic)]
            for word in words_of(text.as_py()):
                counter[word] += 1
            if len(counts[0]) + len(counts[1]) > HELD_WORDS:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()
    give_back()


def _count_ngrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def flush() -> pa.RecordBatch:
        out = [pa.array(list(counts), pa.string()), *(pa.array([v[i] for v in counts.values()], pa.int64()) for i in (0, 1))]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["gram", "toxic", "ordinary"])

    for batch in batches:
        for word, toxic, ordinary in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "ordinary")), strict=True):
            for piece in _pieces(word):
                for gram in _ngrams(piece):
                    held = counts[gram]
                    held[0] += toxic
                    held[1] += ordinary
        if len(counts) > HELD_WORDS:
            yield flush()
    if counts:
        yield flush()
    give_back()


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """Counts per n-gram and class of labelled texts (text, toxic): gram, toxic, ordinary."""
    schema = "{} string, toxic long, ordinary long"
    both = [F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")]
    words = labelled.select("text", "toxic").mapInArrow(_count_words, schema.format("word")).groupBy("word").agg(*both)
    return words.mapInArrow(_count_ngrams, schema.format("gram")).groupBy("gram").agg(*both)


@dataclass
class Ratios:
    """Log-likelihood ratios (toxic over ordinary): of seen n-grams, and of unseen letters after a history. One slice of a model will do: slices add up."""

    gram: dict[str, float]
    history: dict[str, float]
    last: bool = True

    def word(self, word: str) -> float:
        gram, history, total = self.gram, self.history, 0.0
        for piece in _pieces(word):
            for g in _ngrams(piece):
                r = gram.get(g)
                total += history.get(g[:-1], 0.0) if r is None else r
        return total


class Packed:
    """Values by n-gram of up to ORDER letters in sorted arrays, about a tenth of the memory of a dict.

    The first three letters are a number, whose place among all such numbers and the other two letters are the key.
    """

    def __init__(self, values: dict[str, float]):
        raw = np.array(list(values), dtype=f"U{ORDER}").view(np.uint32).reshape(len(values), ORDER).astype(np.int64)
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        letters = np.where(np.arange(ORDER) < sizes[:, None], raw + 1, 0)
        head, tail = self._halves(letters)
        self.heads = np.unique(head)
        keys = (np.searchsorted(self.heads, head) << 2 * LETTER_BITS) | tail
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(values.values(), np.float64, len(values))[order]

    @staticmethod
    def _halves(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = [letters[:, i] for i in range(ORDER)]
        return (c[0] << 2 * LETTER_BITS) | (c[1] << LETTER_BITS) | c[2], (c[3] << LETTER_BITS) | c[4]

    def get(self, letters: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
        """Values of n-grams given as rows of ORDER letters (code point + 1, then zeros)."""
        if not len(self.keys):
            return np.broadcast_to(missing, len(letters))
        head, tail = self._halves(letters)
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        keys = (at << 2 * LETTER_BITS) | tail
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.heads[at] == head) & (self.keys[place] == keys), self.values[place], missing)


def _word_ratios(words: list[str], gram: Packed, history: Packed) -> np.ndarray:
    """``Ratios.word`` of many words, summed in the same order."""
    pieces, owner = [], []
    for no, word in enumerate(words):
        for piece in _pieces(word):
            pieces.append(f"\x02{piece}\x03")
            owner.append(no)
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = np.arange(len(code))
    inner = end > first
    first, end, owner = first[inner], end[inner], np.repeat(owner, sizes)[inner]
    start = np.maximum(first, end - ORDER + 1)
    place, size = start[:, None] + np.arange(ORDER), (end - start)[:, None]
    letters = np.where(np.arange(ORDER) <= size, code[np.minimum(place, len(code) - 1)], 0)
    unseen = history.get(np.where(np.arange(ORDER) < size, letters, 0), 0.0)
    return np.bincount(owner, gram.get(letters, unseen), minlength=len(words))


def kneser_ney(grams: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Log-likelihood ratios of interpolated Kneser-Ney models per class over a shared continuation model.

    ``grams`` (gram, toxic, ordinary) is a staged table of n-grams of 2 to ORDER letters. Returns (history, gram, ratio);
    a null gram stands for letters not seen after the history.
    """
    history, tail = F.expr("substring(gram, 1, length(gram) - 1)"), F.expr("substring(gram, 2)")
    letters = max(1, grams.agg(F.count_distinct(F.expr("right(gram, 1)"))).first()[0])
    # shared lower orders: how many different letters stand before each shorter n-gram
    shorter: dict[int, DataFrame] = {}
    level = grams.filter(F.length("gram") == ORDER).select("gram")
    for length in range(ORDER, 1, -1):
        shorter[length - 1] = stage(level.groupBy(tail.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "toxic-shorter")
        level = grams.filter(F.length("gram") == length - 1).select("gram").union(shorter[length - 1].select("gram")).distinct()
    shared = None
    for length in range(1, ORDER):
        counted = shorter[length].withColumn("after", history)
        sums = counted.groupBy("after").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        joined = counted.join(sums, "after")
        if shared is None:
            joined = joined.withColumn("below", F.lit(1.0 / letters))
        else:
            joined = joined.join(shared.select(F.col("gram").alias("end"), F.col("p").alias("below")), tail == F.col("end"))
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("below")) / F.col("total")
        here = stage(joined.select("gram", p.alias("p")), "toxic-shared")
        lower = here if shared is None else lower.union(here)
        shared = here
    both = F.col("toxic") + F.col("ordinary")
    classes = {"toxic": F.col("toxic"), "ordinary": F.col("ordinary"), "pooled": both}
    seen = stage(
        grams.groupBy(history.alias("history")).agg(
            *[F.sum(c).alias(f"{name}_sum") for name, c in classes.items()], *[F.count_if(c > 0).alias(f"{name}_kinds") for name, c in classes.items()]
        ),
        "toxic-histories",
    )

    def share(name: str) -> Column:
        return F.when(F.col(f"{name}_sum") > 0, discount * F.col(f"{name}_kinds") / F.col(f"{name}_sum")).otherwise(1.0)

    def seen_part(name: str) -> Column:
        return F.when(F.col(f"{name}_sum") > 0, F.greatest(classes[name] - discount, F.lit(0.0)) / F.col(f"{name}_sum")).otherwise(0.0)

    placed = grams.withColumns({"history": history, "tail": tail}).join(seen, "history").join(lower.select(F.col("gram").alias("tail"), "p"), "tail")
    pooled = seen_part("pooled") + share("pooled") * F.col("p")
    ratio = F.ln(seen_part("toxic") + share("toxic") * pooled) - F.ln(seen_part("ordinary") + share("ordinary") * pooled)
    unseen = seen.select("history", F.lit(None).cast("string").alias("gram"), (F.ln(share("toxic")) - F.ln(share("ordinary"))).alias("ratio"))
    return stage(placed.select("history", "gram", ratio.alias("ratio")).union(unseen), "toxic-model")


def model_slices(model: DataFrame, entries: int = SLICE_ENTRIES) -> Iterator[Ratios]:
    """The model in parts of about ``entries`` rows, an n-gram and its history in the same one."""
    slices = max(1, -(-model.count() // entries))
    for no in range(slices):
        rows = model.filter(F.pmod(F.xxhash64("history"), F.lit(slices)) == no).toArrow().to_pylist()
        yield Ratios(
            {r["gram"]: r["ratio"] for r in rows if r["gram"] is not None}, {r["history"]: r["ratio"] for r in rows if r["gram"] is None}, no == slices - 1
        )


def window_score(values: np.ndarray, window: int = WINDOW_WORDS) -> float:
    """Largest sum of ratios over ``window`` neighbouring words, per window length; 0 without words."""
    if not len(values):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[window:] - sums[:-window]).max() if len(values) > window else sums[-1]) / window


def _score(model, last: bool, carried: list[str]):
    """One pass: the ratios of every word from one slice of the model, added to ``sums``; the last pass makes the two figures."""

    def looked_up(texts: Iterable, cache: dict[str, float]) -> Iterator[np.ndarray]:
        """The ratios of each text's words; words are looked up for several texts at once."""
        gram, history = model.value
        held: list[list[str]] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            if len(cache) > HELD_WORDS:
                cache.clear()
            fresh = list({w for words in held for w in words if w not in cache})
            if fresh:
                cache.update(zip(fresh, _word_ratios(fresh, gram, history).tolist(), strict=True))
            for words in held:
                yield np.fromiter(map(cache.__getitem__, words), float, len(words))
            held.clear()

        for text in texts:
            words = words_of(text.as_py())
            held.append(words)
            size += len(words)
            if size > CHUNK_WORDS:
                yield from flush()
                size = 0
        yield from flush()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            peaks, shares, sums = [], [], []
            for values, so_far in zip(looked_up(batch.column("text"), cache), batch.column("sums"), strict=True):
                if so_far.is_valid:
                    values += np.frombuffer(so_far.as_py())
                if last:
                    peaks.append(window_score(values))
                    shares.append(float(np.sqrt((values > HIGH_RATIO).mean())) if len(values) else 0.0)
                else:
                    sums.append(values.tobytes())
            if last:
                made = {"peak": pa.array(peaks, pa.float64()), "share": pa.array(shares, pa.float64())}
            else:
                made = {"text": batch.column("text"), "sums": pa.array(sums, pa.binary())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *made.values()], [*carried, *made])
        del cache
        give_back()

    return score


def scored(docs: DataFrame, model: DataFrame, entries: int = SLICE_ENTRIES) -> DataFrame:
    """peak and share of ``docs`` (text and other columns, which are carried along) under a model of any size: one pass per slice."""
    spark = docs.sparkSession
    carried = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in carried]
    partial, done = (StructType([*carried, *StructType.fromDDL(ddl)]) for ddl in ("text string, sums binary", "peak double, share double"))
    rows = docs.withColumn("sums", F.lit(None).cast("binary"))
    for part in model_slices(model, entries):
        shipped = spark.sparkContext.broadcast((Packed(part.gram), Packed(part.history)))
        step = rows.mapInArrow(_score(shipped, part.last, names), done if part.last else partial)
        rows = stage(step, "toxic-raw")
        shipped.destroy()  # the staged table does not need it, nor do lost executors
    return rows


def calibrate(cells: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """Weights of peak and share and the intercept of a logistic curve from (peak, share, label, count), by Newton steps.

    Both classes weigh the same in total, so the threshold 0.5 does not drift with the share of toxic rows.
    Without rows of both classes the curve is the plain one.
    """
    totals = {y: sum(n for _, _, label, n in cells if label == y) for y in (0, 1)}
    if not totals[0] or not totals[1]:
        return 1.0, 0.0, 0.0
    design = np.array([(peak, share, 1.0) for peak, share, _, _ in cells])
    y = np.array([label for _, _, label, _ in cells], dtype=float)
    w = np.array([n / totals[label] for _, _, label, n in cells]) * 1000
    beta, prior = np.array([1.0, 0.0, 0.0]), np.diag([0.01, 0.01, 0.01])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - prior @ beta
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + prior, gradient)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 2.0 / size) if size else beta
        if size < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, text_key (tells texts under one doc_id apart).

    Labels are learnt from rows whose fold is not 0: the counts from folds 1 to 3, the curve from fold 4. Only
    texts enter a score. A document with two labels counts as toxic if one says so; null labels are
    left out. Empty and null texts get the score of no evidence. Without labels every score is that.
    """
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    known = stage(
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(fold(F.col("label_id")) != 0)
        .groupBy("label_id")
        .agg(F.max("toxic").alias("toxic")),
        "toxic-labels",
    )
    rows = known.count()
    counting = known.filter(fold(F.col("label_id")) < 4)
    labelled = own.join(sized(counting, rows, 16), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    counts = stage(ngram_counts(labelled), "toxic-counts")
    raw = scored(own, kneser_ney(counts))
    judged = raw.join(sized(known.filter(fold(F.col("label_id")) == 4), rows, 16), F.col("doc_id") == F.col("label_id"))
    peak = F.least(F.greatest(F.round(F.col("peak") / PEAK_STEP), F.lit(-PEAK_CELLS)), F.lit(PEAK_CELLS)) * PEAK_STEP
    share = F.round(F.col("share") / SHARE_STEP) * SHARE_STEP
    cells = judged.groupBy(peak.alias("peak"), share.alias("share"), "toxic").count().orderBy("peak", "share", "toxic")
    on_peak, on_share, level = calibrate([tuple(r) for r in cells.collect()])
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("peak") * on_peak + F.col("share") * on_share + level)))
    return raw.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        "text_key",
    )

"""Mixing sources to target weights, in DataFrame functions only.

Rows get hash-random keys; slices of the key range are sorted by tasks of their own, so a source that
holds a third of all rows is spread. Slice totals are turned into distributed prefix sums, and every
source is cut at its exact budget of words, with whole epochs before the cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.llm.common import SEPARATORS, fresh, sized, stage
from flowguard.operators.ordered import prefix_offsets

#: Fixed values of the mix: weights by source rank, repeating, and the largest number of epochs.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLICE_ROWS = 512  # of a slice, if all rows were one source


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source from (source, source_size): source_no, target and budget (whole words).

    A source is filled at most ``max_epochs`` times. Sources ordered by cap over weight: one is capped
    if an equal share of what the smaller caps leave would exceed its cap; the rest share by weight.
    The table has one row per source, so its windows are over sources, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    listed = sizes.select(
        "source",
        "source_size",
        rank.alias("source_no"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("long").alias("weight"),
    )
    cap = (F.col("source_size") * max_epochs).alias("cap")
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    earlier, later = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    exact = "decimal(38,0)"
    filled = (
        listed.withColumn("cap", cap)
        .withColumns(
            {
                "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)),
                "open_weight": F.sum("weight").over(later),
            }
        )
        .withColumn(
            "capped",
            F.col("left").cast(exact) * F.col("weight").cast("decimal(18,0)")
            >= F.col("cap").cast(exact) * F.col("open_weight").cast("decimal(18,0)"),
        )
        .withColumns(
            {
                "shared": F.sum("source_size").over(everything)
                - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)),
                "weights": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything),
            }
        )
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("shared")).cast("double") / F.col("weights").cast("double")
    )
    return filled.select("source", "source_no", "source_size", target.alias("target"), F.floor(target).cast("long").alias("budget"))


def mix_key(doc_id: Column, text: Column) -> Column:
    """The hash-random key of a document."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs, key.

    size is the number of words (null text: 0). taken counts the words the mix takes, repeats included:
    whole epochs of the source, then the documents in key order up to the exact budget, the last one in
    part. The key is a digest of doc_id and text, so reruns agree; rows equal in both are interchangeable.
    A null source is a source of its own and comes last. Sources without words get nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(f"[^{SEPARATORS}]+")).cast("long").alias("size"),
            mix_key(F.col("doc_id"), F.col("text")).alias("key"),
        ),
        "mix-keys",
    )
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes), "mix-targets").withColumnRenamed("source", "target_source")
    bits = min(30, max(0, math.ceil(math.log2(max(1, keyed.count()) / SLICE_ROWS))))
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = (
        keyed.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("slice", F.shiftright(head, 32 - bits))
        .repartition("source_no", "slice")
    )
    cells = rows.groupBy("source_no", "slice").agg(F.sum("size").alias("words"))
    before = prefix_offsets(cells, ["source_no"], "slice", ["words"])
    within = Window.partitionBy("source_no", "slice").orderBy("key", "size", "doc_id")
    placed = rows.withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("inner") - F.col("words_before")
    return (
        placed.join(before, ["source_no", "slice"])
        .withColumn("epochs", whole)
        .withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest)))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
            "epochs",
            "key",
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document appears once per whole epoch, and once more if the cut takes at least half of it.
    Documents without words come once per whole epoch of their source. Texts under one doc_id count for themselves;
    rows equal in both come as often as the mix takes them together.
    """
    size, taken = F.col("size"), F.col("taken")
    copies = F.when(size == 0, F.col("epochs")).otherwise(F.expr("taken div size") + F.when(2 * F.pmod(taken, size) >= size, 1).otherwise(0))
    per_key = mix(docs).withColumn("copies", copies).groupBy("key").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"))
    wanted = stage(per_key.filter("copies > 0"), "mix-copies")
    mark = fresh("mix_key", docs)
    keyed = docs.withColumn(mark, mix_key(docs["doc_id"], docs["text"]))
    single = keyed.join(sized(wanted, wanted.count(), 64), keyed[mark] == wanted["key"])
    repeated = stage(wanted.filter("rows > 1"), "mix-repeated")
    if repeated.limit(1).count():  # of equal rows one stands for all
        once = single.filter(wanted["rows"] == 1).select(*[keyed[c] for c in keyed.columns], wanted["copies"].alias(f"{mark}_n"))
        some = keyed.join(sized(repeated, repeated.count(), 64), keyed[mark] == repeated["key"])
        some = some.select(*[keyed[c] for c in keyed.columns], repeated["copies"].alias(f"{mark}_n")).dropDuplicates([mark])
        single = once.unionByName(some)
    else:
        single = single.select(*[keyed[c] for c in keyed.columns], wanted["copies"].alias(f"{mark}_n"))
    out = single.withColumn(f"{mark}_at", F.explode(F.sequence(F.lit(1), F.col(f"{mark}_n"))))
    return out.drop(mark, f"{mark}_n", f"{mark}_at")


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
l AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
w AS (SELECT *, [5, 2, 1][((no - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM l),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w),
c AS (SELECT *, rest::HUGEINT * weight >= cap::HUGEINT * open_weight AS capped FROM f),
g AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE
    ELSE (weight * (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE
         / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE END AS target
  FROM c),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""

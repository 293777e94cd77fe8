"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Texts are reduced to a digest at the scan; texts themselves are never shuffled. Pass one counts hits
per filter bit and keeps the bits that were hit more than once (the repeat filter, packed into
bitmaps of 32 768 bits). Pass two probes it: a row with any unset bit is certainly unique and passes
straight through; only the others are grouped by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import lower_ascii, sized, stage

#: Fixed value: bits of one bitmap that ``bitmap_construct_agg`` builds.
BITMAP_BITS = 32_768


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(position, F.lit(8)) + 1)) != 0


def exact_dedup(docs: DataFrame, bits_per_row: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of a group
    the row with the largest doc_id stays; of rows that also share that doc_id exactly one is kept.
    A null doc_id is smaller than any other. An empty table gives an empty result. Other columns are ignored.
    """
    digest = F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256)
    keys = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("text_sha256")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "dedup-keys",
    )
    buckets = max(1, -(-keys.count() * bits_per_row // BITMAP_BITS))
    where, pair = F.xxhash64("text_sha256"), F.xxhash64("text_sha256", F.lit(1))
    keyed = keys.select(
        "*",
        F.pmod(where, F.lit(buckets)).alias("bucket"),
        F.pmod(pair, F.lit(BITMAP_BITS)).cast("int").alias("bit_a"),
        F.pmod(F.shiftright(pair, 20), F.lit(BITMAP_BITS)).cast("int").alias("bit_b"),
    )
    hits = keyed.select("bucket", F.explode(F.array_distinct(F.array("bit_a", "bit_b"))).alias("bit"))
    repeated = hits.groupBy("bucket", "bit").count().filter("count > 1")
    packed = stage(
        repeated.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits")), "dedup-filter"
    )
    probed = keyed.join(sized(packed, buckets, BITMAP_BITS // 8), "bucket", "left").withColumn(
        "maybe", F.coalesce(_bit(F.col("bits"), F.col("bit_a")) & _bit(F.col("bits"), F.col("bit_b")), F.lit(False))
    )
    maybe = probed.filter("maybe").select("doc_id", "text_sha256", "row")
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row"))
    groups = stage(
        maybe.groupBy("text_sha256")
        .agg(top.alias("top"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"),
        "dedup-groups",
    )
    met = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    alone = probed.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(met)


EXACT_DEDUP_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

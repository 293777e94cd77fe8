"""Corpus pipeline: toxicity, near-duplicates, benchmark contamination, mixing, sharding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared folder and
reads it back as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.llm.common import documents, sized, stage, text_key
from flowguard.llm.decontaminate import contamination
from flowguard.llm.mixing import mixed_documents
from flowguard.llm.near_dedup import near_groups
from flowguard.llm.sharding import shard
from flowguard.llm.toxicity import score_toxicity


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is among ``rows`` (by text_key): what a text is does not hang on its doc_id."""
    gone = stage(rows.select("text_key").distinct(), "pipeline-gone")
    return docs.join(sized(gone, gone.count(), 16), text_key(docs["text"]) == gone["text_key"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; empty and null texts stay."""
    scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.filter("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8). Rows that repeat one doc_id and text count once."""
    stays = stage(near_groups(docs).filter("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")), "pipeline-stays")
    marks = sized(stays, stays.count(), 32)
    same = docs["doc_id"].cast("long").eqNullSafe(stays["doc_id"]) & (text_key(docs["text"]) == stays["text_key"])
    kept = docs.join(marks, same)
    once = kept.filter(stays["rows"] == 1).select(*[docs[c] for c in docs.columns])
    if not stays.filter("rows > 1").limit(1).count():
        return once
    return once.union(kept.filter(stays["rows"] > 1).select(*[docs[c] for c in docs.columns]).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Each text is searched under its digest as id."""
    by_text = docs.select(text_key(docs["text"]).alias("doc_id"), docs["text"])
    hits = contamination(by_text, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, hits.select(F.col("doc_id").alias("text_key")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document comes once per epoch, or not at all."""
    return mixed_documents(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left."""
    return shard(docs, shards=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: Model scores, sampled hashes and the capacity search cannot be said in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

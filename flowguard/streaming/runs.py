"""Starting streams: folders, sinks, and drain-to-completion runs."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowguard.session import ensure_checkpoint_dir


def run_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/flowguard-{uuid.uuid4().hex}"


def save_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch to its own folder, over whatever an earlier attempt at the same batch has left there."""
    rows.write.mode("overwrite").partitionBy("is_attack").parquet(f"{path}/batch={batch_id}")


def write_detections_stream(detections: DataFrame, path: str, checkpoint: str, available_now: bool = False, **trigger) -> StreamingQuery:
    """Record every classified flow once, by micro-batch and decision.

    A batch that is run again after a failure replaces its own folder, so each flow is recorded exactly once. The table
    is the folder ``path``, which Spark reads with the partition columns ``batch`` and ``is_attack``.
    """
    writer = detections.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.foreachBatch(lambda rows, batch_id: save_batch(rows, batch_id, path))
    return writer.trigger(**({"availableNow": True} if available_now else trigger or {"processingTime": "10 seconds"})).start()


def read_detections(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """The recorded flows, with the decision as boolean."""
    stored = spark.read.schema(columns).option("basePath", path).parquet(f"{path}/batch=*")
    return stored.withColumn("is_attack", F.col("is_attack").cast("boolean")).select(*columns.fieldNames())


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over everything available into a parquet table and return the table.

    Called again with the same ``folder`` it goes on where it stopped, for what has come since.
    """
    spark = stream.sparkSession
    folder = folder or run_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(f"{folder}/table")
    else:
        # Changed rows per micro-batch; readers take the newest version of a key.
        def save(rows: DataFrame, batch_id: int) -> None:
            rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/table/part={batch_id}")

        query = writer.foreachBatch(save).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", "long") if mode != "append" else stream.schema).parquet(f"{folder}/table")


def drain_to_end(packets: DataFrame, build: Callable[[DataFrame], DataFrame], run: Callable[[DataFrame, str], object] | None = None):
    """Drain ``build`` (packets) over everything available, then end the input and drain what was still open.

    ``run(stream, folder)`` does one pass, by default ``drain``; the result of the second is returned.
    """
    from flowguard.streaming.flows import end_of_input, mark_end

    spark = packets.sparkSession
    folder = run_folder(spark)
    run = run or (lambda stream, at: drain(stream, folder=at))
    marks = f"{folder}/marks"
    spark.createDataFrame([], packets.schema).write.parquet(marks)
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")  # the second pass emits what a batch without data would
    try:
        run(build(end_of_input(packets, marks)), folder)
    finally:
        spark.conf.set(idle, before)
    mark_end(spark, packets.schema, marks)
    return run(build(end_of_input(packets, marks)), folder)

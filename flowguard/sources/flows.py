"""Labelled flow tables and packet streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

# Packet rows: unsigned 8/16/32-bit fields widen to int.
PACKET_SCHEMA = (
    "pkt_id bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
    "payload_len int, header_len int, tcp_flags int, window_size int"
)


#: Files of one micro-batch: bounds what a restart after a pause has to take at once.
MAX_FILES = 64


def read_flows(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Every parquet file of a folder, united by column name; columns missing in a file are null."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{folder}/{pattern}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no parquet files in {folder}") from e


def read_packet_stream(
    spark: SparkSession, path: str | None = None, source: str = "parquet", schema: str = PACKET_SCHEMA, max_files: int | None = MAX_FILES, **options: str
) -> DataFrame:
    """Continuous packet source: a folder that receives parquet files, or any other stream source by options.

    A micro-batch takes ``max_files`` files at most (None: all there are).
    """
    reader = spark.readStream.format(source).options(**options)
    if source == "kafka":
        from pyspark.sql import functions as F

        return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("p")).select("p.*")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(schema).load(path)

"""Helpers shared by the text operators: staged tables in the shared folder, and checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowguard.session import ensure_checkpoint_dir

#: A side of a join is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 64 * 1024 * 1024

#: Fixed value: the word separators of all contracts, tab to carriage return and space.
SEPARATORS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows * row_bytes`` is within the bound; as it is (shuffled) beyond it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or the first longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Digest by which rows of one doc_id are told apart; a null text has one too."""
    return F.xxhash64(text.cast("string"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """At the end of a task: hands freed memory back to the system, since the worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it keep their free memory
        ctypes.CDLL(None).malloc_trim(0)


def worker_kept(name: str, make: Callable[[], object]) -> object:
    """An object kept for the life of a Python worker, which serves many tasks; bounded caches belong here."""
    kept = sys.__dict__.setdefault("_flowguard_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]

"""Streaming versions of the sweep report and of the connection lifetimes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowguard.operators.monitor import SWEEP_SECONDS
from flowguard.operators.ordered import latest
from flowguard.operators.telemetry import CONNECTION_KEY, MAX_TRACKED
from flowguard.streaming.flows import END_US, STATE_PROVIDER


def sweep_summary_stream(detections: DataFrame, seconds: int = SWEEP_SECONDS, watermark: str | None = "0 seconds") -> DataFrame:
    """Per tumbling tick: flows expired, benign, attacks; a tick is appended once the watermark has passed it.

    ``detections`` has ``close_us``, or an event time ``close_ts`` (a chained stateful step brings its own watermark:
    pass ``watermark=None``). The end marker of the input closes the last tick and is not counted.
    """
    timed = detections if "close_ts" in detections.columns else detections.withColumn("close_ts", F.timestamp_micros("close_us"))
    if watermark is not None:
        timed = timed.withWatermark("close_ts", watermark)
    return (
        timed.filter(F.col("close_ts") < F.timestamp_micros(F.lit(END_US)))
        .groupBy(F.window("close_ts", f"{seconds} seconds").alias("tick"))
        .agg(
            F.count(F.lit(1)).alias("expired"),
            F.count_if(~F.col("is_attack")).alias("benign"),
            F.count_if("is_attack").alias("attacks"),
        )
        .select(F.unix_micros("tick.start").alias("tick_us"), "expired", "benign", "attacks")
    )


def lifetime_spans(snapshots: DataFrame, order: str = "snap", tie: str = "event_id") -> DataFrame:
    """First and last sighting, latest state, first process name per connection (update mode on a stream)."""
    at = F.struct(order, tie)
    return snapshots.groupBy("host", *CONNECTION_KEY).agg(
        F.min(order).alias("first_seen"),
        F.max(order).alias("last_seen"),
        F.max(F.struct(at.alias("at"), "state"))["state"].alias("state"),
        F.min(F.struct(at.alias("at"), "process_name"))["process_name"].alias("process_name"),
    )


def lifetimes_from_changes(changes: DataFrame) -> DataFrame:
    """Change log of ``lifetime_spans`` (with ``batch_id``) -> current lifetimes with ``is_active``."""
    now = latest(changes, ["host", *CONNECTION_KEY], ["batch_id"]).drop("batch_id", "part")
    newest = now.groupBy("host").agg(F.max("last_seen").alias("_newest"))
    return now.join(newest, "host").withColumn("is_active", F.col("last_seen") == F.col("_newest")).drop("_newest")


TRACKED = (
    "host string, protocol string, local_addr string, remote_addr string, pid bigint, first_seen bigint, last_seen bigint, "
    "state string, process_name string, is_active boolean"
)
_SPAN = ["first_seen", "last_seen", "state", "process_name"]


def fold_sightings(known: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """Tracked connections after new sightings (``at``, ``tie``): first sighting and its process, latest state."""
    ordered = seen.sort_values(["at", "tie"], kind="stable")
    by = ordered.groupby(CONNECTION_KEY, dropna=False, sort=False)
    fresh = by.agg(first_seen=("at", "min"), last_seen=("at", "max"))
    # the whole first and last row, so that a null there stays null
    fresh["process_name"], fresh["first_tie"] = by["process_name"].nth(0).to_numpy(), by["tie"].nth(0).to_numpy()
    last = ordered[::-1].groupby(CONNECTION_KEY, dropna=False, sort=False)
    newest = last.head(1).set_index(CONNECTION_KEY)[["state", "tie"]].rename(columns={"tie": "last_tie"})
    both = fresh.reset_index().merge(newest.reset_index(), on=CONNECTION_KEY)
    both = pd.concat([known, both], ignore_index=True) if len(known) else both
    oldest = both.sort_values(["first_seen", "first_tie"], kind="stable").drop_duplicates(CONNECTION_KEY)[[*CONNECTION_KEY, "first_seen", "first_tie", "process_name"]]
    latest_rows = both.sort_values(["last_seen", "last_tie"], kind="stable").drop_duplicates(CONNECTION_KEY, keep="last")[[*CONNECTION_KEY, "last_seen", "last_tie", "state"]]
    return oldest.merge(latest_rows, on=CONNECTION_KEY)


class ConnectionTracker(StatefulProcessor):
    """One host: its connections, at most ``limit`` beside the active ones, none older than ``keep_for`` behind the newest snapshot."""

    COLUMNS = [*CONNECTION_KEY, "first_seen", "first_tie", "process_name", "last_seen", "last_tie", "state"]

    def __init__(self, limit: int, keep_for: int | None) -> None:
        self.limit, self.keep_for = limit, keep_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = pa.ipc.open_stream(self.known.get()[0]).read_all().to_pandas(integer_object_nulls=True) if self.known.exists() else pd.DataFrame(columns=self.COLUMNS)
        for part in rows:
            part = part.assign(pid=part["pid"].astype(object).where(part["pid"].notna(), None))
            known = self._kept(fold_sightings(known, part))
        schema = pa.schema([(c, pa.int64() if c in ("pid", "first_seen", "first_tie", "last_seen", "last_tie") else pa.string()) for c in self.COLUMNS])
        table = pa.Table.from_pylist([{c: None if pd.isna(v) else v for c, v in r.items()} for r in known[self.COLUMNS].to_dict("records")], schema=schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.known.update((sink.getvalue().to_pybytes(),))
        out = table.to_pandas(integer_object_nulls=True)
        out.insert(0, "host", key[0])
        out["is_active"] = out["last_seen"] == out["last_seen"].max()
        out["pid"] = out["pid"].astype("Int64")
        yield out[[f.split()[0] for f in TRACKED.split(", ")]]

    def _kept(self, known: pd.DataFrame) -> pd.DataFrame:
        newest = known["last_seen"].max()
        active = known["last_seen"] == newest
        idle = known[~active]
        if self.keep_for is not None:
            idle = idle[idle["last_seen"] >= newest - self.keep_for]
        room = max(self.limit - int(active.sum()), 0)
        if len(idle) > room:  # the oldest sightings go first
            idle = idle.sort_values(["first_seen", *CONNECTION_KEY], ascending=False, kind="stable").head(room)
        return pd.concat([known[active], idle], ignore_index=True)

    def close(self) -> None:
        pass


def tracked_connections_stream(snapshots: DataFrame, limit: int = MAX_TRACKED, keep_for: int | None = None, order: str = "snap", tie: str = "event_id") -> DataFrame:
    """Socket snapshots -> after each micro-batch the whole table of tracked connections of every host that was heard.

    State per host is bounded: active connections, and beside them at most ``limit`` in all, inactive ones evicted by their
    oldest first sighting, or once last seen more than ``keep_for`` before the newest snapshot. An evicted connection that
    comes back starts anew. ``save_tracked`` keeps the table of each host, so what is stored is bounded too.
    """
    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    used = snapshots.select(
        F.col("host").cast("string").alias("host"), *[F.col(c).cast("string").alias(c) for c in CONNECTION_KEY[:3]], F.col("pid").cast("long").alias("pid"),
        F.col(order).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"), F.col("state").cast("string").alias("state"),
        F.col("process_name").cast("string").alias("process_name"),
    )
    return used.groupBy("host").transformWithStateInPandas(ConnectionTracker(limit, keep_for), outputStructType=TRACKED, outputMode="Append", timeMode="None")


def save_tracked(rows: DataFrame, batch_id: int, path: str) -> None:
    """Replace the stored table of each host in ``rows``; a batch that is run again writes the same."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("host").parquet(path)

"""Packets to alerts: flows, features, three scores, one decision, alert lines and sweep reports; batch and online.

Both paths run the same functions: ``detections`` scores a table or a stream of flow features, so a stream that has been
drained to its end holds the rows of the batch. Online the flow steps, the scoring and the sweep window are one chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowguard.operators.flows import FEATURE_NAMES, FLOW_ID_COLUMNS, FLOW_TIMEOUT_S, features_of, flow_table
from flowguard.operators.monitor import SWEEP_SECONDS, format_alert, sweep_summary
from flowguard.plans.training import DetectorModel, score_flows
from flowguard.streaming.flows import flow_table_stream
from flowguard.streaming.reports import sweep_summary_stream

#: What a detection is known by.
IDENTITY = ["ip_protocol" if c == "protocol" else c for c in FLOW_ID_COLUMNS] + ["closed", "packets"]


def detections(flows: DataFrame, model: DetectorModel, keep: list[str] | None = None, mode: str = "full") -> DataFrame:
    """Flow table (or stream of one) -> identity, the three raw and normalised scores, ``prob`` and ``is_attack``."""
    extra = ["packets", *(keep or [])]
    named = features_of(flows, extra)
    missing = [c for c in model.scaler.feature_names if c not in FEATURE_NAMES]
    if missing:
        raise ValueError(f"not flow features: {missing}")
    return score_flows(named, model, [*IDENTITY, *(keep or [])], mode)


def detect_flows(packets: DataFrame, model: DetectorModel, timeout_s: float = FLOW_TIMEOUT_S, mode: str = "full") -> DataFrame:
    """Packets -> one decision per flow."""
    return detections(flow_table(packets, timeout_s), model, mode=mode)


def detect_flows_stream(packets: DataFrame, model: DetectorModel, mode: str = "full", **settings) -> DataFrame:
    """Packet stream -> a decision for every flow as it closes; ``sweep_ts`` is the event time for what follows."""
    return detections(flow_table_stream(packets, **settings), model, ["sweep_ts"], mode)


def with_close(found: DataFrame, timeout_s: float = FLOW_TIMEOUT_S) -> DataFrame:
    """Detections with ``close_us``, when the flow timed out, and the protocol under its plain name."""
    return found.withColumn("close_us", F.col("last_us") + int(timeout_s * 1_000_000)).withColumnRenamed("ip_protocol", "protocol")


def alerts(found: DataFrame, start_us: int = 0, timeout_s: float = FLOW_TIMEOUT_S) -> DataFrame:
    """The attacks among detections, with their alert line in ``message``."""
    return format_alert(with_close(found, timeout_s), start_us)


def sweeps(found: DataFrame, seconds: int = SWEEP_SECONDS, timeout_s: float = FLOW_TIMEOUT_S) -> DataFrame:
    """Flows expired, benign and attack per sweep of a table of detections."""
    return sweep_summary(with_close(found, timeout_s), seconds)


def sweeps_stream(packets: DataFrame, model: DetectorModel, seconds: int = SWEEP_SECONDS, mode: str = "full", **settings) -> DataFrame:
    """Packet stream -> sweep reports: two flow steps, scoring and the sweep window as one chain of stateful steps.

    A flow counts for the sweep in which the stream could be sure that it was over (``sweep_ts``).
    """
    found = detect_flows_stream(packets, model, mode, **settings)
    return sweep_summary_stream(found.select(F.col("sweep_ts").alias("close_ts"), "is_attack"), seconds, watermark=None)

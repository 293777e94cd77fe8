"""Reports over packets and detections: rates, totals, sweeps, alert lines, log views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.net import protocol_name
from flowguard.functions.text import to_fixed
from flowguard.operators.flows import FLOW_TIMEOUT_S, flow_changes
from flowguard.operators.ordered import number_rows, prefix_offsets, ranged, sums_at, time_slice

# Report sizes and intervals.
REPORT_EVERY = 1000
SWEEP_SECONDS = 10
LOG_LINES = 1000
#: A page within so many rows of either end is a top-k.
SHALLOW_ROWS = 10_000


def rate_every_n(packets: DataFrame, n: int = REPORT_EVERY, slice_s: float = 1.0) -> DataFrame:
    """After every ``n`` packets: total so far and packets per second since the previous report.

    Packets are numbered inside time slices with slice offsets, so no task sorts the whole table.
    """
    numbered = number_rows(packets.select("ts_us", "pkt_id"), [], time_slice("ts_us", slice_s), ["ts_us", "pkt_id"])
    at = F.col("row_no")
    marks = F.array(
        F.struct((at / n).cast("long").alias("report_no"), F.when(at % n == 0, F.col("ts_us")).alias("end_us"), F.lit(None).cast("long").alias("start_us")),
        F.struct((F.floor(at / n) + 1).cast("long").alias("report_no"), F.lit(None).cast("long").alias("end_us"), F.col("ts_us").alias("start_us")),
    )
    ends = numbered.filter((at % n == 0) | (at == 1)).select(F.explode(marks).alias("m"))
    spans = ends.groupBy(F.col("m.report_no").alias("report_no")).agg(
        F.max("m.end_us").alias("end_us"), F.min("m.start_us").alias("start_us")
    )
    seconds = (F.col("end_us") - F.col("start_us")).cast("double") / 1_000_000.0
    return spans.filter(F.col("end_us").isNotNull() & (F.col("report_no") > 0)).select(
        "report_no",
        (F.col("report_no") * n).alias("total_packets"),
        "end_us",
        F.when(seconds > 0, F.lit(float(n)) / seconds).otherwise(F.lit(0.0)).alias("packets_per_s"),
    )


def rate_reports(packets: DataFrame, flows: DataFrame, detections: DataFrame, n: int = REPORT_EVERY, timeout_s: float = FLOW_TIMEOUT_S) -> DataFrame:
    """``rate_every_n`` with the state at each report: active flows, flows classified and attacks so far.

    ``flows`` are all flows (min_packets=1); a detection counts once its ``close_us`` has passed.
    """
    reports = rate_every_n(packets, n)
    changes = flow_changes(flows, int(timeout_s * 1_000_000)).withColumns({"classified": F.lit(0), "attacks": F.lit(0)})
    decided = detections.select(
        (F.col("close_us") + 1).alias("at_us"), F.lit(0).alias("active_flows"), F.lit(1).alias("classified"), F.col("is_attack").cast("int").alias("attacks")
    )
    state = sums_at(changes.unionByName(decided), ["active_flows", "classified", "attacks"], reports.select(F.col("end_us").alias("at_us")))
    return reports.join(state.withColumnRenamed("at_us", "end_us"), "end_us")


def running_totals(packets: DataFrame, detections: DataFrame, step_s: float = 60.0) -> DataFrame:
    """Cumulative packets, classified flows and attacks at the end of each step."""
    zero = F.lit(0)
    seen = packets.groupBy(time_slice("ts_us", step_s).alias("step")).agg(F.count(F.lit(1)).alias("packets"))
    closed = detections.groupBy(time_slice("close_us", step_s).alias("step")).agg(
        F.count(F.lit(1)).alias("classified"), F.count_if("is_attack").alias("attacks")
    )
    steps = seen.join(closed, "step", "full").select(
        "step", *[F.coalesce(c, zero).alias(c) for c in ("packets", "classified", "attacks")]
    )
    names = ["packets", "classified", "attacks"]
    before = prefix_offsets(steps, [], "step", names)
    return steps.join(before, "step").select("step", *[(F.col(c) + F.col(f"{c}_before")).alias(f"total_{c}") for c in names])


def sweep_summary(detections: DataFrame, seconds: int = SWEEP_SECONDS) -> DataFrame:
    """Flows expired, benign and attack per tumbling tick; a tick without flows has no row."""
    tick = F.window(F.timestamp_micros("close_us"), f"{seconds} seconds")
    return (
        detections.groupBy(tick.alias("tick"))
        .agg(
            F.count(F.lit(1)).alias("expired"),
            F.count_if(~F.col("is_attack")).alias("benign"),
            F.count_if("is_attack").alias("attacks"),
        )
        .select(F.unix_micros("tick.start").alias("tick_us"), "expired", "benign", "attacks")
    )


def elapsed(us: Column) -> Column:
    """Elapsed time as MM:SS (minutes keep growing past an hour)."""
    s = F.floor(us / 1_000_000)
    minutes = F.floor(s / 60).cast("string")
    padded = F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes)
    return F.concat(padded, F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def _endpoints() -> Column:
    return F.concat(
        "src_ip", F.lit(":"), F.col("src_port").cast("string"), F.lit(" → "),
        "dst_ip", F.lit(":"), F.col("dst_port").cast("string"), F.lit(" "), protocol_name("protocol"),
    )


# Message formats of the log.
def format_alert(detections: DataFrame, start_us: int = 0, prob: str = "prob") -> DataFrame:
    """Attack rows as alert lines."""
    line = F.concat(
        F.lit("["), elapsed(F.col("close_us") - start_us), F.lit("] 🚨 ATTACK  "), _endpoints(),
        F.lit(" | prob="), to_fixed(prob, 3),
    )
    return detections.filter("is_attack").withColumn("message", line)


def format_detection(detections: DataFrame, start_us: int = 0) -> DataFrame:
    """Every classified flow as a detailed log line (needs packets and the three scores)."""
    mark = F.when(F.col("is_attack"), F.lit("🚨 ATTACK")).otherwise(F.lit("✅ BENIGN"))
    line = F.concat(
        F.lit("["), elapsed(F.col("close_us") - start_us), F.lit("] "), mark, F.lit("  "), _endpoints(),
        F.lit(" | "), F.col("packets").cast("string"), F.lit(" pkts | prob="), to_fixed("prob", 3),
        F.lit(" | IF="), to_fixed("if_score", 3), F.lit(" AE="), to_fixed("ae_score", 3), F.lit(" SVM="), to_fixed("svm_score", 3),
    )
    return detections.withColumn("message", line)


def format_report(reports: DataFrame, start_us: int = 0) -> DataFrame:
    """Rate reports as log lines."""
    line = F.concat(
        F.lit("["), elapsed(F.col("end_us") - start_us), F.lit("] 📦 "), F.col("total_packets").cast("string"), F.lit(" pkts ("),
        to_fixed("packets_per_s", 0), F.lit("/s) | "), F.col("active_flows").cast("string"), F.lit(" active flows | "),
        F.col("classified").cast("string"), F.lit(" classified | "), F.col("attacks").cast("string"), F.lit(" attacks"),
    )
    return reports.withColumn("message", line)


def format_sweep(summary: DataFrame, start_us: int = 0, seconds: int = SWEEP_SECONDS) -> DataFrame:
    line = F.concat(
        F.lit("["), elapsed(F.col("tick_us") + seconds * 1_000_000 - start_us), F.lit("] ── Sweep: "),
        F.col("expired").cast("string"), F.lit(" flows expired, "), F.col("benign").cast("string"), F.lit(" benign, "),
        F.col("attacks").cast("string"), F.lit(" attacks ──"),
    )
    return summary.withColumn("message", line)


def classify_log(lines: DataFrame, message: str = "message") -> DataFrame:
    m = F.col(message)
    kind = F.when(m.contains("ATTACK"), "attack").when(m.contains("BENIGN"), "benign").otherwise("aggregate")
    return lines.withColumn("kind", kind)


def latest_n(df: DataFrame, n: int = LOG_LINES, order_by: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows (top-k)."""
    return df.orderBy(*[F.desc(c) for c in (order_by or ["ts_us", "pkt_id"])]).limit(n)


def _turned(order_by: list[str]) -> list[Column]:
    return [F.asc_nulls_first(c[1:]) if c.startswith("-") else F.desc_nulls_last(c) for c in order_by]


def _sorted(order_by: list[str]) -> list[Column]:
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in order_by]


def page(df: DataFrame, order_by: list[str], size: int, start: int = 0, follow: bool = False, shallow: int = SHALLOW_ROWS) -> DataFrame:
    """Rows start .. start+size of an ordered result; the start is clamped, ``follow`` shows the last page.

    ``order_by`` names columns, a leading ``-`` turns one around. A page near either end is a top-k from that end. Any other
    is found by order statistics: the rows are dealt to ranges, ranges are counted, and only those with the page are sorted.
    """
    rows = df.count()
    last = max(0, rows - size)
    at = last if follow else min(max(0, start), last)
    if at + size <= shallow:
        return df.orderBy(*_sorted(order_by)).limit(at + size).offset(at)
    if rows - at <= shallow:
        tail = df.orderBy(*_turned(order_by)).limit(rows - at).offset(max(0, rows - at - size))
        return tail.orderBy(*_sorted(order_by))
    dealt = ranged(df, _sorted(order_by), "_range")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a row per range
    before, held = 0, []
    for no, n in counts:
        if before < at + size and before + n > at:
            held.append((no, before))
        before += n
    part = dealt.filter(F.col("_range").isin([no for no, _ in held])).drop("_range")
    skip = at - held[0][1]
    return part.orderBy(*_sorted(order_by)).limit(skip + size).offset(skip)

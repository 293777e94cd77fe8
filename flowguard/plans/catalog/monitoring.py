"""Detection monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.fixtures import duckdb_view, spark_view
from flowguard.operators import flows as fl, monitor as mo
from flowguard.plans.catalog.flows import FLOWS
from flowguard.plans.registry import query

PACKETS = f"WITH packets AS ({duckdb_view('packets')})"
# Stand-in decision: busy flows are called attacks.
DETECTIONS = FLOWS + ", det AS (SELECT *, last_us + 120000000 AS close_us, least(1, n / 40.0::DOUBLE) AS prob, n / 40.0::DOUBLE >= 0.5 AS is_attack FROM kept)"


def detections(spark, sf):
    flows = fl.flow_table(spark_view(spark, sf, "packets"))
    prob = F.least(F.lit(1.0), F.col("packets") / F.lit(40.0))
    return flows.select(
        *fl.FLOW_ID_COLUMNS, "packets", (F.col("last_us") + 120_000_000).alias("close_us"), prob.alias("prob"),
        (prob >= 0.5).alias("is_attack"),
    )


@query(
    "rate_every_n",
    PACKETS
    + """, r AS (SELECT ts_us, row_number() OVER (ORDER BY ts_us, pkt_id) AS rn FROM packets), m AS (SELECT rn / 1000 AS report_no, ts_us FROM r WHERE rn % 1000 = 0 OR rn = 1),
k AS (SELECT CAST(floor(report_no) AS BIGINT) AS report_no, ts_us, ts_us - lag(ts_us) OVER (ORDER BY report_no) AS g FROM m)
SELECT report_no, report_no * 1000 AS total_packets, ts_us AS end_us, CASE WHEN g > 0 THEN 1000.0::DOUBLE / (g / 1000000.0::DOUBLE) ELSE 0 END AS packets_per_s FROM k WHERE report_no > 0""",
)
def rate_every_n(spark, sf):
    return mo.rate_every_n(spark_view(spark, sf, "packets"))


# Reports with the state of the moment; a flow is active up to its timeout and counts as classified after it.
@query(
    "rate_reports",
    DETECTIONS
    + """, r AS (SELECT ts_us, row_number() OVER (ORDER BY ts_us, pkt_id) AS rn FROM packets), m AS (SELECT rn // 1000 AS report_no, ts_us FROM r WHERE rn % 1000 = 0 OR rn = 1),
k AS (SELECT report_no, ts_us, ts_us - lag(ts_us) OVER (ORDER BY report_no) AS g FROM m),
p AS (SELECT report_no, ts_us AS end_us, CASE WHEN g > 0 THEN 1000.0::DOUBLE / (g / 1000000.0::DOUBLE) ELSE 0 END AS pps FROM k WHERE report_no > 0),
s AS (SELECT p.*, (SELECT count(*) FROM flows f WHERE f.start_us <= end_us AND end_us <= f.last_us + 120000000) AS active,
  (SELECT count(*) FROM det d WHERE d.close_us < end_us) AS classified, (SELECT count(*) FROM det d WHERE d.close_us < end_us AND d.is_attack) AS attacks FROM p)
SELECT report_no, '[' || lpad(CAST(end_us // 60000000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((end_us // 1000000) % 60 AS VARCHAR), 2, '0') || '] 📦 ' || report_no * 1000
  || ' pkts (' || format('{:.0f}', pps) || '/s) | ' || active || ' active flows | ' || classified || ' classified | ' || attacks || ' attacks' AS message FROM s""",
)
def rate_reports(spark, sf):
    packets = spark_view(spark, sf, "packets")
    found = mo.rate_reports(packets, fl.flow_table(packets, min_packets=1), detections(spark, sf))
    return mo.format_report(found).select("report_no", "message")


@query(
    "running_totals",
    DETECTIONS
    + """, e AS (SELECT CAST(floor(ts_us / 60000000) AS BIGINT) AS step, 1 AS p, 0 AS c, 0 AS a FROM packets
UNION ALL SELECT CAST(floor(close_us / 60000000) AS BIGINT), 0, 1, CASE WHEN is_attack THEN 1 ELSE 0 END FROM det),
s AS (SELECT step, sum(p) AS p, sum(c) AS c, sum(a) AS a FROM e GROUP BY step)
SELECT step, CAST(sum(p) OVER w AS BIGINT) AS total_packets, CAST(sum(c) OVER w AS BIGINT) AS total_classified, CAST(sum(a) OVER w AS BIGINT) AS total_attacks FROM s WINDOW w AS (ORDER BY step)""",
)
def running_totals(spark, sf):
    return mo.running_totals(spark_view(spark, sf, "packets"), detections(spark, sf))


@query(
    "sweep_summary",
    DETECTIONS
    + "SELECT CAST(floor(close_us / 10000000) AS BIGINT) * 10000000 AS tick_us, count(*) AS expired, count(*) FILTER (NOT is_attack) AS benign, count(*) FILTER (is_attack) AS attacks FROM det GROUP BY 1",
)
def sweep_summary(spark, sf):
    return mo.sweep_summary(detections(spark, sf))


MMSS = "lpad(CAST(close_us // 60000000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((close_us // 1000000) % 60 AS VARCHAR), 2, '0')"
ALERT = (
    f"'[' || {MMSS} || '] 🚨 ATTACK  ' || src_ip || ':' || src_port || ' → ' || dst_ip || ':' || dst_port || ' ' || "
    "CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE '???' END || format(' | prob={:.3f}', prob)"
)


@query("format_alert", DETECTIONS + f"SELECT flow_id, {ALERT} AS message FROM det WHERE is_attack")
def format_alert(spark, sf):
    return mo.format_alert(detections(spark, sf)).select("flow_id", "message")


LOG = (
    DETECTIONS
    + f", log AS (SELECT flow_id, close_us, CASE WHEN is_attack THEN {ALERT} ELSE '[' || {MMSS} || '] BENIGN flow ' || flow_id END AS message FROM det)"
)


def log_lines(spark, sf):
    d = detections(spark, sf)
    alerts = mo.format_alert(d).select("flow_id", "close_us", "message")
    quiet = d.filter("NOT is_attack").select(
        "flow_id", "close_us", F.concat(F.lit("["), mo.elapsed(F.col("close_us")), F.lit("] BENIGN flow "), F.col("flow_id").cast("string")).alias("message")
    )
    return alerts.unionByName(quiet)


@query("classify_log", LOG + "SELECT CASE WHEN contains(message, 'ATTACK') THEN 'attack' WHEN contains(message, 'BENIGN') THEN 'benign' ELSE 'aggregate' END AS kind, count(*) AS n FROM log GROUP BY 1")
def classify_log(spark, sf):
    return mo.classify_log(log_lines(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("latest_n", PACKETS + "SELECT pkt_id, ts_us FROM packets ORDER BY ts_us DESC, pkt_id DESC LIMIT 1000")
def latest_n(spark, sf):
    return mo.latest_n(spark_view(spark, sf, "packets")).select("pkt_id", "ts_us")


# The start is clamped so that a full page is shown when there are enough rows.
@query(
    "page",
    LOG
    + """, n AS (SELECT *, row_number() OVER (ORDER BY close_us, flow_id) AS rn, count(*) OVER () AS total FROM log)
SELECT flow_id, message FROM n WHERE rn > least(100, greatest(total - 25, 0)) AND rn <= least(100, greatest(total - 25, 0)) + 25""",
)
def page(spark, sf):
    return mo.page(log_lines(spark, sf), ["close_us", "flow_id"], 25, 100).select("flow_id", "message")


@query(
    "page_deep",
    PACKETS
    + """, n AS (SELECT *, row_number() OVER (ORDER BY payload_len DESC, pkt_id) AS rn, count(*) OVER () AS total FROM packets)
SELECT pkt_id, payload_len FROM n WHERE rn > total * 6 // 10 AND rn <= total * 6 // 10 + 40""",
)
def page_deep(spark, sf):
    packets = spark_view(spark, sf, "packets")
    found = mo.page(packets, ["-payload_len", "pkt_id"], 40, packets.count() * 6 // 10, shallow=100)
    return found.select("pkt_id", "payload_len")


@query(
    "page_follow",
    PACKETS + "SELECT pkt_id, payload_len FROM (SELECT * FROM packets ORDER BY payload_len, pkt_id DESC LIMIT 40)",
)
def page_follow(spark, sf):
    """The last page by falling payload."""
    return mo.page(spark_view(spark, sf, "packets"), ["-payload_len", "pkt_id"], 40, follow=True).select("pkt_id", "payload_len")

"""Flow building and flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.fixtures import duckdb_view, spark_view
from flowguard.functions.stats import stats_block
from flowguard.operators import flows as fl
from flowguard.plans.registry import query

# Row-level sessionization in SQL, written independently of the sliced Spark plan.
SESSIONS = f"""
WITH packets AS ({duckdb_view("packets")}),
ends AS (SELECT *, concat(src_ip, ':', src_port) AS src, concat(dst_ip, ':', dst_port) AS dst FROM packets),
conv AS (SELECT *, concat(least(src, dst), '|', greatest(src, dst), '|', protocol) AS conv FROM ends),
raw_gap AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY conv ORDER BY ts_us, pkt_id) AS g FROM conv),
numbered AS (SELECT *, CAST(sum(CASE WHEN g IS NULL OR g > 120000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_no FROM raw_gap),
directed AS (SELECT *,
    first_value(src) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) = src AS is_fwd,
    first_value(pkt_id) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS flow_id,
    first_value(src_ip) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS f_ip,
    first_value(src_port) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS f_port,
    first_value(dst_ip) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS b_ip,
    first_value(dst_port) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS b_port,
    first_value(ts_us) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS flow_start_us FROM numbered),
timed AS (SELECT *,
    ts_us - lag(ts_us) OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id) AS iat,
    ts_us - lag(ts_us) OVER (PARTITION BY conv, flow_no, is_fwd ORDER BY ts_us, pkt_id) AS side_iat FROM directed),
periods AS (SELECT *, CAST(sum(CASE WHEN iat > 5000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv, flow_no ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS period FROM timed)
"""

FLOWS = (
    SESSIONS
    + """,
active AS (SELECT conv, flow_no, period, max(ts_us) - min(ts_us) AS len,
    max(period) OVER (PARTITION BY conv, flow_no) AS last_period FROM periods GROUP BY conv, flow_no, period),
act AS (SELECT conv, flow_no, min(len) AS active_min, max(len) AS active_max, sum(len) AS active_sum, count(*) AS active_n,
    sum(CAST(len AS HUGEINT) * len) AS active_sq FROM active WHERE period < last_period GROUP BY conv, flow_no),
flows AS (SELECT conv, flow_no, any_value(flow_id) AS flow_id, any_value(f_ip) AS src_ip, any_value(f_port) AS src_port,
    any_value(b_ip) AS dst_ip, any_value(b_port) AS dst_port, any_value(protocol) AS protocol,
    min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS n,
    count(*) FILTER (is_fwd) AS fn, count(*) FILTER (NOT is_fwd) AS bn,
    coalesce(sum(payload_len) FILTER (is_fwd), 0) AS fb, coalesce(sum(payload_len) FILTER (NOT is_fwd), 0) AS bb,
    coalesce(sum(CAST(payload_len AS HUGEINT)*payload_len) FILTER (is_fwd), 0) AS fb2,
    coalesce(sum(CAST(payload_len AS HUGEINT)*payload_len) FILTER (NOT is_fwd), 0) AS bb2,
    coalesce(min(payload_len) FILTER (is_fwd), 0) AS fmin, coalesce(max(payload_len) FILTER (is_fwd), 0) AS fmax,
    coalesce(min(payload_len) FILTER (NOT is_fwd), 0) AS bmin, coalesce(max(payload_len) FILTER (NOT is_fwd), 0) AS bmax,
    min(payload_len) AS amin, max(payload_len) AS amax,
    count(iat) AS in_, coalesce(sum(iat), 0) AS is_, coalesce(sum(CAST(iat AS HUGEINT)*iat), 0) AS iq, coalesce(min(iat), 0) AS imin, coalesce(max(iat), 0) AS imax,
    count(side_iat) FILTER (is_fwd) AS fin, coalesce(sum(side_iat) FILTER (is_fwd), 0) AS fis,
    coalesce(sum(CAST(side_iat AS HUGEINT)*side_iat) FILTER (is_fwd), 0) AS fiq,
    coalesce(min(side_iat) FILTER (is_fwd), 0) AS fimin, coalesce(max(side_iat) FILTER (is_fwd), 0) AS fimax,
    count(side_iat) FILTER (NOT is_fwd) AS bin, coalesce(sum(side_iat) FILTER (NOT is_fwd), 0) AS bis,
    coalesce(sum(CAST(side_iat AS HUGEINT)*side_iat) FILTER (NOT is_fwd), 0) AS biq,
    coalesce(min(side_iat) FILTER (NOT is_fwd), 0) AS bimin, coalesce(max(side_iat) FILTER (NOT is_fwd), 0) AS bimax,
    coalesce(sum(header_len) FILTER (is_fwd), 0) AS fh, coalesce(sum(header_len) FILTER (NOT is_fwd), 0) AS bh,
    count(*) FILTER (is_fwd AND payload_len > 0) AS fdata, coalesce(min(header_len) FILTER (is_fwd), 0) AS fhmin,
    count(*) FILTER (tcp_flags & 2 <> 0) AS syn, count(*) FILTER (tcp_flags & 16 <> 0) AS ack,
    count(*) FILTER (tcp_flags & 32 <> 0) AS urg, count(*) FILTER (tcp_flags & 4 <> 0) AS rst,
    count(*) FILTER (is_fwd AND tcp_flags & 8 <> 0) AS psh,
    coalesce(arg_min(window_size, (ts_us, pkt_id)) FILTER (is_fwd), 0) AS fwin,
    coalesce(arg_min(window_size, (ts_us, pkt_id)) FILTER (NOT is_fwd), 0) AS bwin,
    count(*) FILTER (iat > 5000000) AS idle_n, coalesce(min(iat) FILTER (iat > 5000000), 0) AS idle_min,
    coalesce(max(iat) FILTER (iat > 5000000), 0) AS idle_max, coalesce(sum(iat) FILTER (iat > 5000000), 0) AS idle_sum,
    coalesce(sum(CAST(iat AS HUGEINT)*iat) FILTER (iat > 5000000), 0) AS idle_sq
  FROM periods GROUP BY conv, flow_no),
kept AS (SELECT f.*, coalesce(active_min, 0) AS active_min, coalesce(active_max, 0) AS active_max,
    coalesce(active_sum, 0) AS active_sum, coalesce(active_sq, 0) AS active_sq, (last_us - start_us) / 1000000.0::DOUBLE AS s
  FROM flows f LEFT JOIN act a ON f.conv = a.conv AND f.flow_no = a.flow_no WHERE n >= 2)
"""
)

IDENT = "flow_id, src_ip, src_port, dst_ip, dst_port, protocol, start_us, last_us"
FEATURE_IDENT = IDENT.replace("protocol", "protocol AS ip_protocol")


def var(n: str, s: str, q: str) -> str:
    return (
        f"CASE WHEN {n} > 1 THEN CAST({n}*CAST({q} AS HUGEINT) - CAST({s} AS HUGEINT)*{s} AS DOUBLE) "
        f"/ (CAST({n} AS DOUBLE)*(CAST({n} AS DOUBLE)-1)) ELSE 0.0::DOUBLE END"
    )


def std(n: str, s: str, q: str) -> str:
    return f"sqrt({var(n, s, q)})"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE)/CAST({b} AS DOUBLE) ELSE 0.0::DOUBLE END"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


FEATURE_SQL = {
    "Protocol": dbl("protocol"), "Flow Duration": dbl("last_us - start_us"),
    "Total Fwd Packets": dbl("fn"), "Total Backward Packets": dbl("bn"),
    "Fwd Packets Length Total": dbl("fb"), "Bwd Packets Length Total": dbl("bb"),
    "Fwd Packet Length Max": dbl("fmax"), "Fwd Packet Length Min": dbl("fmin"),
    "Fwd Packet Length Mean": ratio("fb", "fn"), "Fwd Packet Length Std": std("fn", "fb", "fb2"),
    "Bwd Packet Length Max": dbl("bmax"), "Bwd Packet Length Min": dbl("bmin"),
    "Bwd Packet Length Mean": ratio("bb", "bn"), "Bwd Packet Length Std": std("bn", "bb", "bb2"),
    "Flow Bytes/s": ratio("(fb + bb)", "s"), "Flow Packets/s": ratio("n", "s"),
    "Flow IAT Mean": ratio("is_", "in_"), "Flow IAT Std": std("in_", "is_", "iq"),
    "Flow IAT Max": dbl("imax"), "Flow IAT Min": dbl("imin"),
    "Fwd IAT Total": dbl("fis"), "Fwd IAT Mean": ratio("fis", "fin"), "Fwd IAT Std": std("fin", "fis", "fiq"),
    "Fwd IAT Max": dbl("fimax"), "Fwd IAT Min": dbl("fimin"),
    "Bwd IAT Total": dbl("bis"), "Bwd IAT Mean": ratio("bis", "bin"), "Bwd IAT Std": std("bin", "bis", "biq"),
    "Bwd IAT Max": dbl("bimax"), "Bwd IAT Min": dbl("bimin"),
    "Fwd Header Length": dbl("fh"), "Bwd Header Length": dbl("bh"),
    "Fwd Packets/s": ratio("fn", "s"), "Bwd Packets/s": ratio("bn", "s"),
    "Packet Length Min": dbl("amin"), "Packet Length Max": dbl("amax"), "Packet Length Mean": ratio("(fb + bb)", "n"),
    "Packet Length Std": std("n", "(fb + bb)", "(fb2 + bb2)"), "Packet Length Variance": var("n", "(fb + bb)", "(fb2 + bb2)"),
    "URG Flag Count": dbl("urg"), "Down/Up Ratio": ratio("bn", "fn"), "Avg Packet Size": ratio("(fb + bb)", "n"),
    "Avg Fwd Segment Size": ratio("fb", "fn"), "Avg Bwd Segment Size": ratio("bb", "bn"),
    "Subflow Fwd Packets": dbl("fn"), "Subflow Fwd Bytes": dbl("fb"),
    "Subflow Bwd Packets": dbl("bn"), "Subflow Bwd Bytes": dbl("bb"),
    "Init Fwd Win Bytes": dbl("fwin"), "Init Bwd Win Bytes": dbl("bwin"),
    "Fwd Act Data Packets": dbl("fdata"), "Fwd Seg Size Min": dbl("fhmin"),
    "Active Min": dbl("active_min"), "Idle Max": dbl("idle_max"),
}


def features_sql() -> str:
    return ", ".join(f'{FEATURE_SQL[name]} AS "{name}"' for name in fl.FEATURE_NAMES)


# A flow is closed if its timeout lies before the newest packet.
IS_CLOSED = "last_us + 120000000 < (SELECT max(ts_us) FROM packets) AS closed"


@query("flow_features", FLOWS + f"SELECT {FEATURE_IDENT}, {IS_CLOSED}, {features_sql()} FROM kept")
def flow_features(spark, sf):
    return fl.flow_features(spark_view(spark, sf, "packets"))


@query(
    "flow_key",
    SESSIONS
    + "SELECT pkt_id, CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_ip ELSE dst_ip END AS ip_a, "
    "CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_port ELSE dst_port END AS port_a, "
    "CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_ip ELSE src_ip END AS ip_b, "
    "CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_port ELSE src_port END AS port_b, protocol FROM conv",
)
def flow_key(spark, sf):
    return fl.flow_key(spark_view(spark, sf, "packets")).select("pkt_id", *fl.KEY)


@query("flow_direction", SESSIONS + "SELECT pkt_id, is_fwd FROM directed")
def flow_direction(spark, sf):
    return fl.direction(spark_view(spark, sf, "packets")).select("pkt_id", "is_fwd")


@query("flow_sessionize", SESSIONS + "SELECT pkt_id, flow_no, flow_start_us FROM directed")
def flow_sessionize(spark, sf):
    return fl.sessionize(spark_view(spark, sf, "packets")).select("pkt_id", "flow_no", "flow_start_us")


@query("flow_min_packets", FLOWS + "SELECT flow_id, n AS packets FROM kept")
def flow_min_packets(spark, sf):
    return fl.flow_table(spark_view(spark, sf, "packets")).select("flow_id", "packets")


@query(
    "flow_iat",
    SESSIONS
    + "SELECT pkt_id, iat AS iat_us, CASE WHEN is_fwd THEN side_iat END AS fwd_iat_us, CASE WHEN NOT is_fwd THEN side_iat END AS bwd_iat_us FROM timed",
)
def flow_iat(spark, sf):
    return fl.inter_arrival(spark_view(spark, sf, "packets")).select("pkt_id", "iat_us", "fwd_iat_us", "bwd_iat_us")


def _iat_sql(p: str, n: str, s: str, q: str, lo: str, hi: str) -> str:
    return (
        f"{n} AS {p}_count, {dbl(s)} AS {p}_total, {ratio(s, n)} AS {p}_mean, {std(n, s, q)} AS {p}_std, "
        f"{dbl(lo)} AS {p}_min, {dbl(hi)} AS {p}_max"
    )


@query(
    "flow_iat_stats",
    FLOWS
    + f"SELECT {IDENT}, {_iat_sql('iat', 'in_', 'is_', 'iq', 'imin', 'imax')}, "
    f"{_iat_sql('fwd_iat', 'fin', 'fis', 'fiq', 'fimin', 'fimax')}, {_iat_sql('bwd_iat', 'bin', 'bis', 'biq', 'bimin', 'bimax')} FROM kept",
)
def flow_iat_stats(spark, sf):
    return fl.iat_stats(fl.flow_table(spark_view(spark, sf, "packets")))


@query(
    "running_stats",
    f"WITH packets AS ({duckdb_view('packets')}) SELECT src_ip, count(payload_len) AS payload_count, "
    "CAST(sum(payload_len) AS DOUBLE) AS payload_sum, CAST(min(payload_len) AS DOUBLE) AS payload_min, CAST(max(payload_len) AS DOUBLE) AS payload_max, "
    "round(avg(payload_len), 4) AS payload_mean, round(coalesce(var_samp(payload_len), 0), 4) AS payload_var, "
    "round(coalesce(stddev_samp(payload_len), 0), 4) AS payload_std FROM packets GROUP BY src_ip",
)
def running_stats(spark, sf):
    out = spark_view(spark, sf, "packets").groupBy("src_ip").agg(*stats_block("payload", "payload_len"))
    return out.withColumns({f"payload_{s}": F.round(f"payload_{s}", 4) for s in ("mean", "var", "std")})


@query(
    "flow_active_idle",
    FLOWS
    + f"SELECT {IDENT}, idle_n AS idle_count, {dbl('active_min')} AS active_min, {dbl('active_max')} AS active_max, "
    f"{ratio('active_sum', 'idle_n')} AS active_mean, {std('idle_n', 'active_sum', 'active_sq')} AS active_std, "
    f"{dbl('idle_min')} AS idle_min, {dbl('idle_max')} AS idle_max, {ratio('idle_sum', 'idle_n')} AS idle_mean, "
    f"{std('idle_n', 'idle_sum', 'idle_sq')} AS idle_std FROM kept",
)
def flow_active_idle(spark, sf):
    return fl.active_idle(fl.flow_table(spark_view(spark, sf, "packets")))


@query(
    "flow_flag_counts",
    FLOWS + f"SELECT {IDENT}, syn AS syn_count, ack AS ack_count, urg AS urg_count, rst AS rst_count, psh AS psh_fwd_count FROM kept",
)
def flow_flag_counts(spark, sf):
    return fl.flag_counts(fl.flow_table(spark_view(spark, sf, "packets")))


@query("flow_init_windows", FLOWS + f"SELECT {IDENT}, fwin AS init_fwd_win, bwin AS init_bwd_win FROM kept")
def flow_init_windows(spark, sf):
    return fl.init_windows(fl.flow_table(spark_view(spark, sf, "packets")))


@query(
    "flow_byte_totals",
    FLOWS
    + f"SELECT {IDENT}, {big('fb', 'fwd_bytes')}, {big('bb', 'bwd_bytes')}, {big('fh', 'fwd_header_bytes')}, {big('bh', 'bwd_header_bytes')}, "
    f"fdata AS fwd_data_packets, {big('fhmin', 'fwd_header_min')} FROM kept",
)
def flow_byte_totals(spark, sf):
    return fl.byte_totals(fl.flow_table(spark_view(spark, sf, "packets")))


@query("flow_duration", FLOWS + f"SELECT {IDENT}, last_us - start_us AS duration_us, n AS packets FROM kept")
def flow_duration(spark, sf):
    return fl.duration(fl.flow_table(spark_view(spark, sf, "packets")))


@query(
    "active_flows",
    FLOWS
    + "SELECT m.at_us, count(*) FILTER (start_us <= m.at_us AND m.at_us <= last_us + 120000000) AS active_flows "
    "FROM flows, (SELECT unnest([CAST(600000000 AS BIGINT), 1200000000, 1800000000, 2400000000]) AS at_us) m GROUP BY m.at_us",
)
def active_flows(spark, sf):
    flows = fl.flow_table(spark_view(spark, sf, "packets"), min_packets=1)
    return fl.active_flows(flows, [600_000_000, 1_200_000_000, 1_800_000_000, 2_400_000_000])


@query(
    "flow_safe_rates",
    FLOWS
    + f"SELECT {IDENT}, {ratio('n', 's')} AS packets_per_s, {ratio('fn', 's')} AS fwd_packets_per_s, {ratio('bn', 's')} AS bwd_packets_per_s, "
    f"{ratio('(fb + bb)', 's')} AS bytes_per_s, {ratio('bn', 'fn')} AS down_up_ratio, {ratio('(fb + bb)', 'n')} AS avg_packet_size FROM kept",
)
def flow_safe_rates(spark, sf):
    return fl.safe_rates(fl.flow_table(spark_view(spark, sf, "packets")))

"""Fixed projections of the given tables used as packet, flow and telemetry inputs.

One SQL text serves Spark and DuckDB. ``{events}`` / ``{lineitem}`` name the table and
``{US}`` is the engine's microseconds-since-epoch expression for the column ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS = """
SELECT event_id AS pkt_id,
  CAST(floor(({US} - 1704067200000000) / 1000.0) AS BIGINT) AS ts_us,
  CASE WHEN rev THEN srv ELSE cli END AS src_ip, CASE WHEN rev THEN cli ELSE srv END AS dst_ip,
  CASE WHEN rev THEN sport ELSE cport END AS src_port, CASE WHEN rev THEN cport ELSE sport END AS dst_port,
  protocol,
  CASE WHEN event_type='view' THEN 0 ELSE CAST(round(value*10) AS INT) END AS payload_len,
  CASE WHEN protocol=17 THEN 8 ELSE CAST(20 + 4*(event_id % 4) AS INT) END AS header_len,
  CASE WHEN protocol=17 THEN 0 WHEN event_type='click' THEN 16 WHEN event_type='error' THEN 4
       WHEN event_type='purchase' THEN 24 WHEN event_type='signup' THEN 2 ELSE 48 END AS tcp_flags,
  CASE WHEN protocol=17 THEN 0 ELSE CAST(1024*(event_id % 64) AS INT) END AS window_size
FROM (SELECT *, (event_id*7919 + user_id) % 3 = 0 AS rev,
   concat('10.0.', CAST(floor(user_id/256) AS INT), '.', user_id % 256) AS cli,
   concat('203.0.113.', user_id % 4) AS srv,
   CAST(1024 + user_id AS INT) AS cport, CASE WHEN user_id % 2 = 0 THEN 80 ELSE 443 END AS sport,
   CASE WHEN user_id % 3 = 0 THEN 17 ELSE 6 END AS protocol FROM {events}) e
"""

FLOW_TABLE = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
  CASE WHEN l_returnflag='R' THEN ' Benign ' WHEN l_returnflag='A' THEN 'Syn' ELSE 'DrDoS_DNS' END AS Label,
  l_quantity AS f_quantity, l_extendedprice AS f_price,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_discount END AS f_nullable,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 50 = 0 THEN 1e9 ELSE l_tax END AS f_skewed,
  CAST(0.0 AS DOUBLE) AS f_constant
FROM {lineitem}
"""

# The six leading columns identify a row; written as one text id.
ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(CAST(l_shipdate AS DATE) AS STRING))"

LABELLED = f"""
SELECT {ROW_ID} AS row_id, Label, f_quantity, f_price, f_nullable, f_skewed, f_constant FROM ({FLOW_TABLE}) t
"""

# Labels with stand-in detector scores.
SCORED = f"""
SELECT *, (if_score + ae_score + svm_score) / 3e0 AS prob,
  CASE WHEN (if_score + ae_score + svm_score) / 3e0 >= 0.5e0 THEN 1 ELSE 0 END AS pred
FROM (SELECT {ROW_ID} AS row_id, CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END AS label,
  CASE WHEN l_returnflag='R' THEN 'Benign' WHEN l_returnflag='A' THEN 'Syn' ELSE 'DrDoS_DNS' END AS attack_type,
  CASE WHEN l_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS split,
  least(1e0, l_quantity / 50e0) AS if_score, l_discount * 10e0 AS ae_score, least(1e0, l_extendedprice / 100000e0) AS svm_score
  FROM {{lineitem}}) s
"""

SOCKETS = """
SELECT CAST(floor(({US} - 1704067200000000) / 3600000000.0) AS BIGINT) AS snap, concat('host-', user_id % 5) AS host,
  CASE WHEN user_id % 3 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
  concat('10.0.0.', user_id % 5, ':', 1024 + user_id) AS local_addr,
  CASE WHEN user_id % 11 = 0 THEN '*:*' WHEN user_id % 13 = 0 THEN '[2001:db8::1]:443'
       WHEN user_id % 7 = 0 THEN concat('192.168.1.', user_id % 20, ':53') ELSE concat('198.51.100.', user_id % 40, ':443') END AS remote_addr,
  CASE event_type WHEN 'click' THEN 'ESTABLISHED' WHEN 'view' THEN 'LISTEN' WHEN 'error' THEN 'CLOSE_WAIT' WHEN 'signup' THEN 'SYN_SENT' ELSE 'TIME_WAIT' END AS state,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS pid,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('proc', user_id % 8) END AS process_name,
  event_id
FROM {events}
"""

COUNTERS = """
SELECT concat('host-', user_id % 5) AS host, concat('eth', user_id % 3) AS iface, event_id AS sample_id,
  {US} AS ts_us,
  SUM(CAST(round(value*1000) AS BIGINT)) OVER (PARTITION BY user_id % 5, user_id % 3 ORDER BY ts, event_id) AS rx_bytes,
  SUM(CAST(round(value*100) AS BIGINT)) OVER (PARTITION BY user_id % 5, user_id % 3 ORDER BY ts, event_id) AS tx_bytes,
  CASE WHEN event_type='error' THEN 1 ELSE 0 END AS rx_errors,
  CASE WHEN event_type='signup' THEN 1 ELSE 0 END AS tx_errors,
  CASE WHEN event_type='click' THEN 1 ELSE 0 END AS rx_drops,
  0 AS tx_drops
FROM {events}
"""

# Interface dimension derived from the same table: eth2 is down on odd hosts, host-4/eth1 has no record.
IFACE_INFO = """
SELECT host, iface,
  CASE WHEN h % 2 = 1 AND i = 1 THEN NULL ELSE concat('10.1.', h, '.', i + 1) END AS ipv4,
  CASE WHEN i = 0 THEN concat('fe80::', h) ELSE NULL END AS ipv6,
  concat('02:00:00:00:0', h, ':0', i) AS mac,
  1500 AS mtu, NOT (h % 2 = 1 AND i = 2) AS is_up
FROM (SELECT DISTINCT user_id % 5 AS h, user_id % 3 AS i, concat('host-', user_id % 5) AS host,
        concat('eth', user_id % 3) AS iface FROM {events}) d
WHERE NOT (h = 4 AND i = 1)
"""

PROBES = """
SELECT concat('host-', user_id % 5) AS host, CASE WHEN user_id % 2 = 0 THEN 'gateway' ELSE 'dns' END AS target,
  event_id AS probe_id, {US} AS ts_us,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS rtt_ms,
  CASE WHEN event_type = 'error' THEN 100.0 WHEN event_type = 'signup' THEN 33.3 WHEN event_type = 'purchase' THEN 0.5 ELSE 0.0 END AS loss_pct
FROM {events}
"""

# Geo dimension: one record per distinct public-looking remote, with failed lookups, blank cities and a fallback org.
GEO = """
SELECT ip, CASE WHEN k % 9 = 4 THEN 'fail' ELSE 'success' END AS status,
  CASE WHEN k % 11 = 5 THEN NULL WHEN k % 2 = 0 THEN 'DE' ELSE 'US' END AS countryCode,
  CASE WHEN k % 5 = 0 THEN NULL ELSE concat('City', k % 6) END AS city,
  CASE WHEN k % 4 = 1 THEN NULL ELSE concat('Org', k % 7) END AS org,
  CASE WHEN k % 8 = 1 THEN NULL ELSE concat('AS', 64500 + k) END AS as_name
FROM (SELECT DISTINCT concat('198.51.100.', user_id % 40) AS ip, user_id % 40 AS k FROM {events}) d
"""

VIEWS = {
    "packets": PACKETS,
    "flow_table": FLOW_TABLE,
    "labelled": LABELLED,
    "scored": SCORED,
    "sockets": SOCKETS,
    "counters": COUNTERS,
    "iface_info": IFACE_INFO,
    "probes": PROBES,
    "geo": GEO,
}

SPARK_US = "unix_micros(cast(ts as timestamp))"
DUCK_US = "epoch_us(ts)"


def duckdb_view(name: str) -> str:
    """The view text for DuckDB, ready to be used as a CTE body."""
    return VIEWS[name].format(US=DUCK_US, events="events", lineitem="lineitem")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the parquet tables in ``sf_dir``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # {US} reads ts as UTC wall time
    text = VIEWS[name].replace("{US}", SPARK_US)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem") if f"{{{t}}}" in text}
    return spark.sql(text, **tables)

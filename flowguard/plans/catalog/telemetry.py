"""Interface, link-health and connection telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.fixtures import duckdb_view, spark_view
from flowguard.functions import net, text
from flowguard.operators import telemetry as tm
from flowguard.plans.registry import query

# In SQL, the greedy 10 ms rule reduces to "gap to the previous sample" on these tables: no burst exists in them.
RATES = f"""
WITH counters AS ({duckdb_view("counters")}),
steps AS (SELECT *, ts_us - lag(ts_us) OVER s AS g, rx_bytes - lag(rx_bytes) OVER s AS drx, tx_bytes - lag(tx_bytes) OVER s AS dtx
  FROM counters WINDOW s AS (PARTITION BY host, iface ORDER BY ts_us, sample_id)),
rates AS (SELECT host, iface, sample_id, ts_us, CAST(rx_bytes AS BIGINT) AS rx_bytes, CAST(tx_bytes AS BIGINT) AS tx_bytes,
  rx_errors, tx_errors, rx_drops, tx_drops,
  CASE WHEN g IS NULL THEN 0.0::DOUBLE ELSE CAST(greatest(drx, 0) AS DOUBLE) / (g / 1000000.0::DOUBLE) END AS rx_rate,
  CASE WHEN g IS NULL THEN 0.0::DOUBLE ELSE CAST(greatest(dtx, 0) AS DOUBLE) / (g / 1000000.0::DOUBLE) END AS tx_rate
  FROM steps WHERE g IS NULL OR g >= 10000)
"""

NOW_RATES = (
    RATES
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY host, iface ORDER BY ts_us DESC, sample_id DESC) AS rn FROM rates),
newest AS (SELECT * FROM ranked WHERE rn = 1)"""
)
INFO = f"info AS ({duckdb_view('iface_info')}), live AS (SELECT * FROM info WHERE is_up AND iface NOT IN ('lo', 'lo0'))"

FMT_RATE = (
    "CASE WHEN {0} >= 1000000000 THEN format('{{:.1f}} GB/s', {0}/1000000000.0::DOUBLE) WHEN {0} >= 1000000 THEN format('{{:.1f}} MB/s', {0}/1000000.0::DOUBLE) "
    "WHEN {0} >= 1000 THEN format('{{:.1f}} KB/s', {0}/1000.0::DOUBLE) ELSE format('{{:.0f}}  B/s', {0}) END"
)
FMT_BYTES = (
    "CASE WHEN {0} >= 1000000000 THEN format('{{:.1f}} GB', {0}/1000000000.0::DOUBLE) WHEN {0} >= 1000000 THEN format('{{:.1f}} MB', {0}/1000000.0::DOUBLE) "
    "WHEN {0} >= 1000 THEN format('{{:.1f}} KB', {0}/1000.0::DOUBLE) ELSE concat({0}, ' B') END"
)


def rates(spark, sf):
    return tm.counter_rates(spark_view(spark, sf, "counters"))


@query("counter_rates", RATES + "SELECT host, iface, sample_id, ts_us, rx_rate, tx_rate FROM rates")
def counter_rates(spark, sf):
    return rates(spark, sf).select("host", "iface", "sample_id", "ts_us", "rx_rate", "tx_rate")


# The same counters a million times faster: chains of hundreds of samples less than 10 ms apart.
FAST = "SELECT * REPLACE (ts_us // 1000000 AS ts_us)"
GREEDY = f"""
WITH RECURSIVE counters AS ({FAST} FROM ({duckdb_view("counters")})),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY host, iface ORDER BY ts_us, sample_id) AS rn FROM counters),
firsts AS (SELECT host, iface, ts_us, min(rn) AS rn FROM n GROUP BY ALL),
jumps AS MATERIALIZED (SELECT a.host, a.iface, a.rn, b.rn AS next_rn FROM n a ASOF JOIN firsts b ON a.host = b.host AND a.iface = b.iface AND a.ts_us + 10000 <= b.ts_us),
taken AS (SELECT host, iface, rn FROM n WHERE rn = 1 UNION ALL SELECT t.host, t.iface, j.next_rn FROM taken t JOIN jumps j ON t.host = j.host AND t.iface = j.iface AND t.rn = j.rn),
kept AS (SELECT n.* FROM n JOIN taken USING (host, iface, rn)),
steps AS (SELECT *, ts_us - lag(ts_us) OVER s AS g, rx_bytes - lag(rx_bytes) OVER s AS drx FROM kept WINDOW s AS (PARTITION BY host, iface ORDER BY ts_us, sample_id))
SELECT host, iface, sample_id, ts_us, CASE WHEN g IS NULL THEN 0.0::DOUBLE ELSE CAST(greatest(drx, 0) AS DOUBLE) / (g / 1000000.0::DOUBLE) END AS rx_rate FROM steps
"""


@query("counter_rates_bursts", GREEDY)
def counter_rates_bursts(spark, sf):
    fast = spark_view(spark, sf, "counters").withColumn("ts_us", F.floor(F.col("ts_us") / 1_000_000).cast("long"))
    return tm.counter_rates(fast).select("host", "iface", "sample_id", "ts_us", "rx_rate")


# An hour's samples are one reading of the host.
@query(
    "tick_rates",
    f"""WITH counters AS ({duckdb_view("counters")}), ticked AS (SELECT *, ts_us // 3600000000 AS tick FROM counters),
newest AS (SELECT * FROM ticked QUALIFY row_number() OVER (PARTITION BY host, iface, tick ORDER BY ts_us DESC, sample_id DESC) = 1),
readings AS (SELECT host, tick, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS before FROM (SELECT DISTINCT host, tick FROM newest)),
paced AS (SELECT *, lag(tick) OVER s AS prev_tick, ts_us - lag(ts_us) OVER s AS g, rx_bytes - lag(rx_bytes) OVER s AS drx FROM newest WINDOW s AS (PARTITION BY host, iface ORDER BY tick))
SELECT p.host, iface, sample_id, p.tick, CASE WHEN prev_tick = before AND g > 0 THEN CAST(greatest(drx, 0) AS DOUBLE) / (g / 1000000.0::DOUBLE) ELSE 0.0::DOUBLE END AS rx_rate
FROM paced p JOIN readings r ON p.host = r.host AND p.tick = r.tick""",
)
def tick_rates(spark, sf):
    ticked = spark_view(spark, sf, "counters").withColumn("tick", F.floor(F.col("ts_us") / 3_600_000_000).cast("long"))
    return tm.tick_rates(ticked).select("host", "iface", "sample_id", "tick", "rx_rate")


@query(
    "rate_history",
    RATES
    + """SELECT host, iface, sample_id,
  array_to_string(list(CAST(trunc(rx_rate) AS BIGINT)) OVER h, ',') AS rx_history,
  array_to_string(list(CAST(trunc(tx_rate) AS BIGINT)) OVER h, ',') AS tx_history
FROM rates WINDOW h AS (PARTITION BY host, iface ORDER BY ts_us, sample_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def rate_history(spark, sf):
    h = tm.rate_history(rates(spark, sf))
    return h.select(
        "host", "iface", "sample_id",
        F.array_join(F.col("rx_history").cast("array<string>"), ",").alias("rx_history"),
        F.array_join(F.col("tx_history").cast("array<string>"), ",").alias("tx_history"),
    )


@query(
    "bandwidth_total",
    NOW_RATES
    + f", {INFO} SELECT n.host, round(sum(rx_rate), 6) AS total_rx, round(sum(tx_rate), 6) AS total_tx, string_agg(n.iface, '+' ORDER BY n.iface) AS interfaces "
    "FROM newest n JOIN live l ON n.host = l.host AND n.iface = l.iface GROUP BY n.host",
)
def bandwidth_total(spark, sf):
    out = tm.bandwidth_total(tm.latest_samples(rates(spark, sf)), spark_view(spark, sf, "iface_info"))
    return out.withColumns({c: F.round(c, 6) for c in ("total_rx", "total_tx")})


@query(
    "bandwidth_history",
    RATES
    + f""", {INFO}, back AS (SELECT *, row_number() OVER (PARTITION BY host, iface ORDER BY ts_us DESC, sample_id DESC) AS b,
  count(*) OVER (PARTITION BY host, iface) AS n FROM rates),
slots AS (SELECT host, iface, CAST(least(n, 60) - b AS INTEGER) AS slot, CAST(trunc(rx_rate) AS BIGINT) AS rx, CAST(trunc(tx_rate) AS BIGINT) AS tx FROM back WHERE b <= 60)
SELECT s.host, slot, CAST(sum(rx) AS BIGINT) AS rx, CAST(sum(tx) AS BIGINT) AS tx FROM slots s JOIN live l ON s.host = l.host AND s.iface = l.iface GROUP BY s.host, slot""",
)
def bandwidth_history(spark, sf):
    newest = tm.latest_samples(tm.rate_history(rates(spark, sf)))
    return tm.bandwidth_history(newest, spark_view(spark, sf, "iface_info"))


@query(
    "interface_table",
    NOW_RATES
    + f""", {INFO} SELECT n.host, n.iface, coalesce(ipv4, '—') AS ipv4, coalesce(ipv6, '—') AS ipv6, coalesce(mac, '—') AS mac,
  coalesce(CAST(mtu AS VARCHAR), '—') AS mtu, {FMT_RATE.format("rx_rate")} AS rx_rate, {FMT_RATE.format("tx_rate")} AS tx_rate,
  {FMT_BYTES.format("rx_bytes")} AS rx_total, {FMT_BYTES.format("tx_bytes")} AS tx_total,
  CAST(rx_errors + tx_errors AS BIGINT) AS errors, CAST(rx_drops + tx_drops AS BIGINT) AS drops,
  CASE WHEN coalesce(is_up, false) THEN 'UP' ELSE 'DOWN' END AS status
FROM newest n LEFT JOIN info i ON n.host = i.host AND n.iface = i.iface""",
)
def interface_table(spark, sf):
    return tm.interface_table(tm.latest_samples(rates(spark, sf)), spark_view(spark, sf, "iface_info"))


@query("total_errors", NOW_RATES + "SELECT host, CAST(sum(rx_errors + tx_errors) AS BIGINT) AS errors FROM newest GROUP BY host")
def total_errors(spark, sf):
    return tm.total_errors(tm.latest_samples(rates(spark, sf)))


@query(
    "host_summary",
    f"WITH {INFO} SELECT host, coalesce(arg_min(ipv4, iface) FILTER (ipv4 IS NOT NULL), '—') AS primary_ip, "
    "CASE WHEN count(*) <= 2 THEN string_agg(iface, ' / ' ORDER BY iface) ELSE concat(min(iface), ' +', count(*) - 1) END AS caption FROM live GROUP BY host",
)
def host_summary(spark, sf):
    return tm.host_summary(spark_view(spark, sf, "iface_info"))


@query(
    "health_level",
    f"WITH probes AS ({duckdb_view('probes')}) SELECT probe_id, CASE WHEN loss_pct < 1 THEN 'good' WHEN loss_pct < 50 THEN 'degraded' ELSE 'bad' END AS severity, "
    "CASE WHEN rtt_ms IS NULL THEN 'none' WHEN loss_pct = 0 AND rtt_ms < 10 THEN 'good' WHEN loss_pct < 50 AND rtt_ms < 100 THEN 'degraded' ELSE 'bad' END AS link FROM probes",
)
def health_level(spark, sf):
    return tm.health_level(spark_view(spark, sf, "probes")).select("probe_id", "severity", "link")


@query(
    "rtt_heat",
    f"""WITH probes AS ({duckdb_view("probes")}), scaled AS (SELECT *, greatest(coalesce(max(rtt_ms) OVER (PARTITION BY host, target ORDER BY ts_us, probe_id
  ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0), 1.0) AS max_rtt FROM probes), r AS (SELECT *, CASE WHEN rtt_ms IS NOT NULL THEN least(rtt_ms / max_rtt, 1.0) END AS ratio FROM scaled)
SELECT probe_id, CAST(max_rtt AS DOUBLE) AS max_rtt, CASE WHEN ratio IS NOT NULL THEN CAST(least(floor(ratio * 7), 7) AS INTEGER) END AS level,
  CASE WHEN ratio IS NULL THEN 'gap' WHEN ratio < 0.3 THEN 'low' WHEN ratio < 0.6 THEN 'medium' WHEN ratio < 0.85 THEN 'high' ELSE 'critical' END AS band FROM r""",
)
def rtt_heat(spark, sf):
    out = tm.rtt_heat(spark_view(spark, sf, "probes"))
    return out.select("probe_id", "max_rtt", "level", "band")


SOCKETS = f"""
WITH sockets AS ({duckdb_view("sockets")}),
ends AS (SELECT *,
  CASE WHEN remote_addr = '*:*' OR remote_addr = '' THEN NULL WHEN contains(remote_addr, ']:') THEN substr(remote_addr, 2, instr(remote_addr, ']:') - 2)
       WHEN contains(remote_addr, ':') THEN nullif(split_part(remote_addr, ':', 1), '*') ELSE remote_addr END AS rip,
  CASE WHEN remote_addr = '*:*' OR remote_addr = '' THEN NULL WHEN contains(remote_addr, ']:') THEN substr(remote_addr, instr(remote_addr, ']:') + 2)
       WHEN contains(remote_addr, ':') THEN nullif(split_part(remote_addr, ':', 2), '*') ELSE NULL END AS rport FROM sockets),
priv AS (SELECT *, coalesce(starts_with(rip, '10.') OR starts_with(rip, '192.168.') OR starts_with(rip, '127.') OR starts_with(rip, '169.254.')
  OR starts_with(rip, 'fe80:') OR starts_with(rip, 'fc') OR starts_with(rip, 'fd') OR starts_with(rip, 'ff') OR starts_with(rip, '224.') OR starts_with(rip, '239.')
  OR (starts_with(rip, '172.') AND try_cast(split_part(rip, '.', 2) AS INT) BETWEEN 16 AND 31) OR rip IN ('0.0.0.0', '::', '::1'), false) AS is_private FROM ends)
"""


def sockets(spark, sf):
    return spark_view(spark, sf, "sockets")


@query("split_endpoint", SOCKETS + "SELECT event_id, rip AS ip, rport AS port FROM ends")
def split_endpoint(spark, sf):
    e = sockets(spark, sf).withColumn("e", net.split_endpoint("remote_addr"))
    return e.select("event_id", "e.ip", "e.port")


@query("is_private_ip", SOCKETS + "SELECT event_id, is_private FROM priv WHERE rip IS NOT NULL")
def is_private_ip(spark, sf):
    e = sockets(spark, sf).withColumn("ip", net.remote_ip("remote_addr")).filter("ip IS NOT NULL")
    return e.select("event_id", net.is_private_ip("ip").alias("is_private"))


def geo_table(spark, sf):
    raw = spark_view(spark, sf, "geo").withColumnRenamed("as_name", "as")
    from flowguard.sources.text import valid_geo

    return valid_geo(raw)


@query(
    "enrich_geo",
    SOCKETS
    + f""", geo AS ({duckdb_view("geo")}), ok AS (SELECT ip, countryCode AS cc, coalesce(city, '') AS city, coalesce(org, as_name, '') AS org FROM geo WHERE status = 'success' AND countryCode IS NOT NULL)
SELECT event_id, CASE WHEN cc IS NULL THEN '' WHEN city = '' THEN concat(cc, ' ', org) ELSE concat(cc, ' ', city, ', ', org) END AS geo_label
FROM priv p LEFT JOIN ok ON ok.ip = p.rip AND NOT p.is_private""",
)
def enrich_geo(spark, sf):
    return tm.enrich_geo(sockets(spark, sf), geo_table(spark, sf)).select("event_id", "geo_label")


@query(
    "remote_hosts",
    SOCKETS
    + """SELECT rip AS remote_ip, count(*) AS connections, bool_or(state = 'ESTABLISHED') AS has_established,
  coalesce(string_agg(DISTINCT process_name, ',' ORDER BY process_name), '') AS processes, string_agg(DISTINCT upper(protocol), ',' ORDER BY upper(protocol)) AS protocols
FROM ends WHERE rip IS NOT NULL AND rip NOT IN ('', '*') GROUP BY rip""",
)
def remote_hosts(spark, sf):
    return tm.remote_hosts(sockets(spark, sf))


@query(
    "remote_hosts_located",
    SOCKETS
    + f""", geo AS ({duckdb_view("geo")}), ok AS (SELECT ip, countryCode AS cc, coalesce(city, '') AS city, coalesce(org, as_name, '') AS org FROM geo WHERE status = 'success' AND countryCode IS NOT NULL),
hosts AS (SELECT rip, count(*) AS connections, bool_or(is_private) AS is_private FROM priv WHERE rip IS NOT NULL AND rip NOT IN ('', '*') GROUP BY rip)
SELECT rip AS remote_ip, connections, CASE WHEN cc IS NULL THEN '' WHEN city = '' THEN concat(cc, ' ', org) ELSE concat(cc, ' ', city, ', ', org) END AS geo_label
FROM hosts p LEFT JOIN ok ON ok.ip = p.rip AND NOT p.is_private""",
)
def remote_hosts_located(spark, sf):
    return tm.remote_hosts(sockets(spark, sf), geo_table(spark, sf)).select("remote_ip", "connections", "geo_label")


@query(
    "topology_summary",
    SOCKETS + "SELECT count(*) AS connections, count(DISTINCT rip) AS remotes, count(DISTINCT rip) + 4 AS nodes FROM ends",
)
def topology_summary(spark, sf):
    return tm.topology_summary(sockets(spark, sf), infrastructure_nodes=3)


@query(
    "top_established",
    SOCKETS
    + "SELECT coalesce(process_name, '—') AS process_name, protocol, state, local_addr, remote_addr FROM sockets WHERE state = 'ESTABLISHED' ORDER BY snap, event_id LIMIT 5",
)
def top_established(spark, sf):
    return tm.top_established(sockets(spark, sf), 5, ["snap", "event_id"])


@query("sort_connections", SOCKETS + "SELECT event_id, process_name, pid, protocol, state FROM sockets ORDER BY coalesce(process_name, ''), event_id")
def sort_connections(spark, sf):
    out = tm.sort_connections(sockets(spark, sf), "process_name", ["event_id"])
    return out.select("event_id", "process_name", "pid", "protocol", "state")


LIFETIMES = (
    SOCKETS
    + """, spans AS (SELECT host, protocol, local_addr, remote_addr, pid, min(snap) AS first_seen, max(snap) AS last_seen,
  arg_max(state, (snap, event_id)) AS state, arg_min(process_name, (snap, event_id)) AS process_name FROM sockets GROUP BY ALL),
newest AS (SELECT host, max(snap) AS m FROM sockets GROUP BY host),
lifetimes AS (SELECT s.*, last_seen = m AS is_active FROM spans s JOIN newest n ON s.host = n.host)
"""
)
LIFE_COLS = "host, protocol, local_addr, remote_addr, pid, first_seen, last_seen, state, process_name, is_active"


def lifetimes(spark, sf):
    return tm.connection_lifetimes(sockets(spark, sf), "snap", "event_id")


@query("connection_lifetimes", LIFETIMES + f"SELECT {LIFE_COLS} FROM lifetimes")
def connection_lifetimes(spark, sf):
    return lifetimes(spark, sf)


@query(
    "evict_inactive",
    LIFETIMES
    + f""", n AS (SELECT *, count(*) OVER (PARTITION BY host) AS total, row_number() OVER (PARTITION BY host, is_active
  ORDER BY first_seen, protocol, local_addr, remote_addr, pid NULLS FIRST) AS age FROM lifetimes)
SELECT {LIFE_COLS} FROM n WHERE is_active OR age > greatest(total - 20, 0)""",
)
def evict_inactive(spark, sf):
    return tm.evict_inactive(lifetimes(spark, sf), limit=20)


@query("timeline", LIFETIMES + f"SELECT {LIFE_COLS} FROM lifetimes WHERE last_seen >= (SELECT max(snap) FROM sockets) - 24")
def timeline(spark, sf):
    now = sockets(spark, sf).agg(F.max("snap")).first()[0]
    return tm.timeline(lifetimes(spark, sf), now, 24)


# A snapshot counts as a minute here.
@query("timeline_named", LIFETIMES + f"SELECT {LIFE_COLS} FROM lifetimes WHERE last_seen >= (SELECT max(snap) FROM sockets) - 15")
def timeline_named(spark, sf):
    now = sockets(spark, sf).agg(F.max("snap")).first()[0]
    return tm.timeline(lifetimes(spark, sf), now, "15m", per_second=1 / 60)


@query(
    "timeline_cells",
    LIFETIMES
    + """, b AS (SELECT *, (SELECT max(snap) FROM sockets) AS now FROM lifetimes), c AS (SELECT *, greatest(first_seen, now - 24) AS f, least(last_seen, now) AS l FROM b WHERE last_seen >= now - 24),
d AS (SELECT *, CAST(least(floor((now - l) / 24.0::DOUBLE * 40), 40) AS INTEGER) AS start_cell, CAST(ceil((now - f) / 24.0::DOUBLE * 40) AS INTEGER) AS e FROM c WHERE f <= l)
SELECT host, protocol, local_addr, remote_addr, pid, start_cell, least(greatest(e, start_cell + 1), 40) AS end_cell FROM d""",
)
def timeline_cells(spark, sf):
    now = sockets(spark, sf).agg(F.max("snap")).first()[0]
    out = tm.timeline_cells(lifetimes(spark, sf), now, 24, 40)
    return out.select("host", "protocol", "local_addr", "remote_addr", "pid", "start_cell", "end_cell")


@query(
    "state_class",
    SOCKETS
    + """SELECT state, CASE state WHEN 'ESTABLISHED' THEN 'established' WHEN 'LISTEN' THEN 'listen' WHEN 'SYN_SENT' THEN 'connecting'
  WHEN 'CLOSE_WAIT' THEN 'closing' WHEN 'TIME_WAIT' THEN 'closing' ELSE 'other' END AS state_class, count(*) AS n FROM sockets GROUP BY ALL""",
)
def state_class(spark, sf):
    s = sockets(spark, sf)
    return s.groupBy("state", net.state_class("state").alias("state_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lifetime_summary",
    LIFETIMES + "SELECT count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS closed, count(*) AS total FROM lifetimes",
)
def lifetime_summary(spark, sf):
    return tm.lifetime_summary(lifetimes(spark, sf))


@query(
    "format_bytes",
    RATES + f"SELECT sample_id, {FMT_BYTES.format('rx_bytes')} AS shown_bytes, {FMT_RATE.format('rx_rate')} AS shown_rate FROM rates",
)
def format_bytes(spark, sf):
    return rates(spark, sf).select(
        "sample_id", text.format_bytes("rx_bytes").alias("shown_bytes"), text.format_rate("rx_rate").alias("shown_rate")
    )

"""Streaming queries, drained over the whole table and compared with the batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard import fixtures
from flowguard.operators.flows import FLOW_TIMEOUT_S, IDLE_THRESHOLD_S, KEY
from flowguard.plans.catalog.flows import FEATURE_IDENT, FLOWS, IS_CLOSED, SESSIONS, features_sql
from flowguard.plans.catalog.telemetry import LIFE_COLS, LIFETIMES
from flowguard.plans.registry import query
from flowguard.sources.flows import read_packet_stream
from flowguard.streaming import reports as rp
from flowguard.streaming.flows import flow_events_stream, flow_features_stream, flow_table_stream, late_of, number_of
from flowguard.streaming.runs import drain, drain_to_end, run_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_view(spark, sf, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = read_packet_stream(spark, sf, schema=EVENTS, pathGlobFilter="events.parquet")
    return spark.sql(fixtures.VIEWS[name].replace("{US}", fixtures.SPARK_US), events=events)


def capture_end(spark, sf):
    """The time of the newest packet, which is when this capture ended."""
    return fixtures.spark_view(spark, sf, "packets").agg(F.max("ts_us")).first()[0]


@query("flow_features_stream", FLOWS + f"SELECT {FEATURE_IDENT}, {IS_CLOSED}, {features_sql()} FROM kept")
def flow_features_streamed(spark, sf):
    end = capture_end(spark, sf)
    return drain_to_end(stream_view(spark, sf, "packets"), lambda p: flow_features_stream(p, watermark="0 seconds", end_us=end))


@query("read_packet_stream", FLOWS + "SELECT flow_id, n AS packets FROM kept")
def packet_stream(spark, sf):
    packets = stream_view(spark, sf, "packets")
    return drain_to_end(packets, lambda p: flow_table_stream(p, watermark="0 seconds").select("flow_id", "packets"))


# Packets in the order of their arrival: files of 300 s, into which every 37th packet comes 450 s late.
ARRIVAL = "CAST(floor((ts_us + CASE WHEN pkt_id % 37 = 5 THEN 450000000 ELSE 0 END) / 300000000) AS BIGINT)"
_WIDTH = int(min(FLOW_TIMEOUT_S, IDLE_THRESHOLD_S) * 1_000_000)
_DELAY_MS = 20_000
# A packet is late if its slice had ended, by the whole milliseconds of the packets in earlier files less the delay.
JUDGED = f"""
WITH packets AS ({fixtures.duckdb_view("packets")}),
arrived AS (SELECT *, {ARRIVAL} AS arrival FROM packets),
newest AS (SELECT arrival, max(max(ts_us)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_us FROM arrived GROUP BY arrival),
lines AS (SELECT arrival, greatest(COALESCE(newest_us // 1000 - {_DELAY_MS}, 0), 0) AS line_ms FROM newest),
judged AS (SELECT a.*, line_ms, (ts_us // {_WIDTH} + 1) * {_WIDTH} // 1000 <= line_ms AS late FROM arrived a JOIN lines USING (arrival)),
keyed AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS from_a FROM judged),
conversations AS (SELECT *, CASE WHEN from_a THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN from_a THEN src_port ELSE dst_port END AS port_a,
  CASE WHEN from_a THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN from_a THEN dst_port ELSE src_port END AS port_b FROM keyed)
"""


def arriving(spark, sf):
    """The packets as a folder that receives one file after another, in order of arrival.

    One pass deals them to their arrivals. Packets without a time have none.
    """
    packets = fixtures.spark_view(spark, sf, "packets").withColumn("arrival", F.expr(ARRIVAL)).filter("arrival IS NOT NULL")
    schema = packets.drop("arrival").schema
    folder = run_folder(spark)
    packets.write.partitionBy("arrival").parquet(f"{folder}/dealt")
    arrivals = [r[0] for r in packets.select("arrival").distinct().orderBy("arrival").collect()]
    for no in arrivals:  # one file per 300 s, oldest first, in row groups that several tasks can read
        one = spark.read.schema(schema).parquet(f"{folder}/dealt/arrival={no}").coalesce(1)
        one.write.option("parquet.block.size", 8 * 1024 * 1024).parquet(f"{folder}/in/{no:06d}")
    return read_packet_stream(spark, f"{folder}/in/*", schema=schema, max_files=1)


def arrived_events(spark, sf):
    return drain_to_end(arriving(spark, sf), lambda p: flow_events_stream(p, min_packets=1, watermark=f"{_DELAY_MS} milliseconds"))


@query(
    "late_packets",
    JUDGED + f"SELECT {', '.join(KEY)}, count(*) FILTER (NOT late) AS accepted, count(*) FILTER (late) AS late FROM conversations GROUP BY ALL",
)
def late_packets(spark, sf):
    """Packets of each conversation that went into its flows, and those that came too late for them."""
    events = arrived_events(spark, sf).withColumn("packets", number_of("packets"))
    from_a = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    ends = {"ip_a": ("src_ip", "dst_ip"), "port_a": ("src_port", "dst_port"), "ip_b": ("dst_ip", "src_ip"), "port_b": ("dst_port", "src_port")}
    keys = [F.when(from_a, F.col(x)).otherwise(F.col(y)).alias(k) for k, (x, y) in ends.items()]
    return events.groupBy(*keys, "protocol").agg(
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("packets"))), F.lit(0)).alias("accepted"), F.count_if("late").alias("late")
    )


@query("late_ledger", JUDGED + "SELECT pkt_id, ts_us, line_ms * 1000 AS line_us FROM judged WHERE late")
def late_ledger(spark, sf):
    """Every late packet, with the line it missed."""
    return late_of(arrived_events(spark, sf)).select("pkt_id", "ts_us", "line_us")


ON_TIME = SESSIONS.replace(f"WITH packets AS ({fixtures.duckdb_view('packets')})", JUDGED.strip() + ", ontime AS (SELECT * EXCLUDE (arrival, line_ms, late) FROM judged WHERE NOT late)")


@query("late_flow_features", FLOWS.replace(SESSIONS, ON_TIME.replace("FROM packets),\nconv", "FROM ontime),\nconv")) + f"SELECT {FEATURE_IDENT}, {features_sql()} FROM kept")
def late_flow_features(spark, sf):
    """Features of the flows of all packets that were on time, whatever their order inside the delay."""
    packets = arriving(spark, sf)
    return drain_to_end(packets, lambda p: flow_features_stream(p, watermark=f"{_DELAY_MS} milliseconds").drop("closed"))


# Every packet stands for one closed flow here.
TICKS = f"""
WITH packets AS ({fixtures.duckdb_view("packets")})
SELECT CAST(floor(ts_us / 10000000) AS BIGINT) * 10000000 AS tick_us, count(*) AS expired, count(*) FILTER (payload_len < 500) AS benign,
  count(*) FILTER (payload_len >= 500) AS attacks FROM packets GROUP BY 1
"""


@query("sweep_summary_stream", TICKS)
def sweep_summary_streamed(spark, sf):
    def summary(p):
        return rp.sweep_summary_stream(p.select(F.timestamp_micros("ts_us").alias("close_ts"), (F.col("payload_len") >= 500).alias("is_attack")))

    return drain_to_end(stream_view(spark, sf, "packets"), summary)


@query("connection_lifetimes_stream", LIFETIMES + f"SELECT {LIFE_COLS} FROM lifetimes")
def connection_lifetimes_streamed(spark, sf):
    changes = drain(rp.lifetime_spans(stream_view(spark, sf, "sockets")), mode="update")
    return rp.lifetimes_from_changes(changes)


@query("tracked_connections_stream", LIFETIMES + f"SELECT {LIFE_COLS} FROM lifetimes")
def tracked_connections_streamed(spark, sf):
    """The stored tables of all hosts, snapshots arriving in ten files; below the retention limit they equal the lifetimes."""
    sockets = fixtures.spark_view(spark, sf, "sockets")
    folder = run_folder(spark)
    tenth = F.floor(F.col("snap") / 72).cast("long")
    for no in [r[0] for r in sockets.select(tenth.alias("no")).distinct().orderBy("no").collect()]:
        sockets.filter(tenth == no).coalesce(1).write.parquet(f"{folder}/in/{no:06d}")
    arriving_sockets = read_packet_stream(spark, f"{folder}/in/*", schema=sockets.schema, max_files=1)
    tracked = rp.tracked_connections_stream(arriving_sockets)
    writer = tracked.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch_id: rp.save_tracked(rows, batch_id, f"{folder}/table")).start().awaitTermination()
    return spark.read.schema(rp.TRACKED).parquet(f"{folder}/table")

"""Packets -> bidirectional flows -> 54-column feature rows.

Plan shape. A single five-tuple may carry a large share of all packets, so no operator here sorts a
whole conversation in one task. Packets are first grouped by (conversation, time slice), where a slice
is never longer than the idle threshold or the timeout: no gap inside a slice can end a flow or an
active period. Each slice is reduced to ONE row of integer moments for both endpoints ("cells"). Only
the cells, at most span/slice rows per conversation, are ordered per conversation to find flow
boundaries, directions and gaps between slices, and are then summed into flows. Packet-level answers
(direction, flow number, inter-arrival times) join the cells back on the same (conversation, slice).

All sums are integers, so results do not depend on partitioning or on the order of merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.functions.stats import moments_variance, safe_ratio
from flowguard.operators.ordered import sums_at

# Defaults of the online agent.
FLOW_TIMEOUT_S = 120
IDLE_THRESHOLD_S = 5
MIN_PACKETS = 2

# TCP flag bit masks.
TCP_SYN = 0x02
TCP_RST = 0x04
TCP_PSH = 0x08
TCP_ACK = 0x10
TCP_URG = 0x20

# Feature names in vector order.
FEATURE_NAMES = [
    "Protocol", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Fwd Packets Length Total", "Bwd Packets Length Total",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "URG Flag Count", "Down/Up Ratio", "Avg Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init Fwd Win Bytes", "Init Bwd Win Bytes", "Fwd Act Data Packets", "Fwd Seg Size Min",
    "Active Min", "Idle Max",
]

KEY = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
SIDES = ("a", "b")
DEC = "decimal(38,0)"


def with_micros(packets: DataFrame) -> DataFrame:
    """Packet time as whole microseconds in ``ts_us`` (kept when already present)."""
    if "ts_us" in packets.columns:
        return packets
    return packets.withColumn("ts_us", F.unix_micros("ts"))


def flow_key(packets: DataFrame) -> DataFrame:
    """Canonical conversation key: endpoint a sorts before endpoint b; ``from_a`` tells the sender."""
    src_ip, dst_ip = F.col("src_ip"), F.col("dst_ip")
    src_port, dst_port = F.col("src_port"), F.col("dst_port")
    from_a = (src_ip < dst_ip) | ((src_ip == dst_ip) & (src_port <= dst_port))
    return packets.withColumn("from_a", from_a).withColumns(
        {
            "ip_a": F.when(F.col("from_a"), src_ip).otherwise(dst_ip),
            "port_a": F.when(F.col("from_a"), src_port).otherwise(dst_port),
            "ip_b": F.when(F.col("from_a"), dst_ip).otherwise(src_ip),
            "port_b": F.when(F.col("from_a"), dst_port).otherwise(src_port),
        }
    )


def slice_width_us(timeout_s: float, idle_s: float, slice_s: float | None) -> int:
    limits = [timeout_s, idle_s] + ([slice_s] if slice_s is not None else [])
    return max(1, int(min(limits) * 1_000_000))


def _sliced(packets: DataFrame, width_us: int) -> DataFrame:
    keyed = flow_key(with_micros(packets))
    return keyed.withColumn("slice_us", F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(width_us)))


def _slice_window():
    return Window.partitionBy(*KEY, "slice_us").orderBy("ts_us", "pkt_id")


def _with_inner_gaps(sliced: DataFrame) -> DataFrame:
    """Gaps to the previous packet of the slice: any sender, endpoint a, endpoint b (one sort for all three)."""
    w = _slice_window()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ts, from_a = F.col("ts_us"), F.col("from_a")
    return sliced.withColumns(
        {
            "gap": ts - F.lag(ts).over(w),
            "gap_a": F.when(from_a, ts - F.last(F.when(from_a, ts), ignorenulls=True).over(before)),
            "gap_b": F.when(~from_a, ts - F.last(F.when(~from_a, ts), ignorenulls=True).over(before)),
        }
    )


def _exprs(texts: list[str]) -> list[Column]:
    # SQL text keeps plan building to one gateway call per column.
    return [F.expr(t) for t in texts]


def _cell_aggregates() -> list[Column]:
    out = [
        "min(ts_us) AS first_us",
        "max(ts_us) AS last_us",
        "min(struct(ts_us, pkt_id, from_a)) AS opening",
    ]
    for side, mine in (("a", "from_a"), ("b", "NOT from_a")):
        length, header = "CAST(payload_len AS BIGINT)", "CAST(header_len AS BIGINT)"
        out += [
            f"count_if({mine}) AS n_{side}",
            f"sum({length}) FILTER (WHERE {mine}) AS bytes_{side}",
            f"sum({length} * {length}) FILTER (WHERE {mine}) AS bytes_sq_{side}",
            f"min({length}) FILTER (WHERE {mine}) AS len_min_{side}",
            f"max({length}) FILTER (WHERE {mine}) AS len_max_{side}",
            f"sum({header}) FILTER (WHERE {mine}) AS header_{side}",
            f"min({header}) FILTER (WHERE {mine}) AS header_min_{side}",
            f"count_if({mine} AND payload_len > 0) AS data_{side}",
            f"count_if({mine} AND (tcp_flags & {TCP_PSH}) <> 0) AS psh_{side}",
            f"min(ts_us) FILTER (WHERE {mine}) AS first_us_{side}",
            f"max(ts_us) FILTER (WHERE {mine}) AS last_us_{side}",
            f"min(struct(ts_us, pkt_id, window_size)) FILTER (WHERE {mine}) AS win_{side}",
        ]
    for gap in ("gap", "gap_a", "gap_b"):
        out += [
            f"count({gap}) AS {gap}_n",
            f"sum({gap}) AS {gap}_sum",
            f"sum({gap} * {gap}) AS {gap}_sq",  # <= width^2, fits a long
            f"min({gap}) AS {gap}_min",
            f"max({gap}) AS {gap}_max",
        ]
    for name, mask in (("syn", TCP_SYN), ("ack", TCP_ACK), ("urg", TCP_URG), ("rst", TCP_RST)):
        out.append(f"count_if((tcp_flags & {mask}) <> 0) AS {name}")
    return _exprs(out)


def flow_cells(
    packets: DataFrame,
    timeout_s: float = FLOW_TIMEOUT_S,
    idle_s: float = IDLE_THRESHOLD_S,
    slice_s: float | None = None,
) -> DataFrame:
    """One row per (conversation, slice) with its flow number and what precedes it in the flow."""
    width = slice_width_us(timeout_s, idle_s, slice_s)
    cells = _with_inner_gaps(_sliced(packets, width)).groupBy(*KEY, "slice_us").agg(*_cell_aggregates())
    return _link_cells(cells, int(timeout_s * 1_000_000), int(idle_s * 1_000_000))


def _link_cells(cells: DataFrame, timeout_us: int, idle_us: int) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("slice_us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def previous(c: str) -> Column:
        return F.last(c, ignorenulls=True).over(before)

    step = F.col("first_us") - F.col("prev_us")
    linked = cells.withColumns(
        {"prev_us": F.lag("last_us").over(w), "prev_a_us": previous("last_us_a"), "prev_b_us": previous("last_us_b")}
    ).withColumns(
        {
            "opens_flow": F.col("prev_us").isNull() | (step > timeout_us),
            "opens_active": F.col("prev_us").isNull() | (step > min(idle_us, timeout_us)),
        }
    )
    linked = linked.withColumns(
        {
            "flow_no": F.sum(F.col("opens_flow").cast("long")).over(upto),
            "flow_start_us": F.last(F.when(F.col("opens_flow"), F.col("first_us")), ignorenulls=True).over(upto),
            "flow_opening": F.last(F.when(F.col("opens_flow"), F.col("opening")), ignorenulls=True).over(upto),
            "active_start_us": F.last(F.when(F.col("opens_active"), F.col("first_us")), ignorenulls=True).over(before),
        }
    )
    start = F.col("flow_start_us")
    inside = ~F.col("opens_flow")
    idle = inside & (step > idle_us)
    return linked.withColumns(
        {
            "fwd_is_a": F.col("flow_opening.from_a"),
            "link": F.when(inside, step),
            "link_a": F.when(F.col("prev_a_us") >= start, F.col("first_us_a") - F.col("prev_a_us")),
            "link_b": F.when(F.col("prev_b_us") >= start, F.col("first_us_b") - F.col("prev_b_us")),
            "idle_us": F.when(idle, step),
            "active_us": F.when(idle, F.col("prev_us") - F.col("active_start_us")),
        }
    )


def sessionize(
    packets: DataFrame, timeout_s: float = FLOW_TIMEOUT_S, idle_s: float = IDLE_THRESHOLD_S, slice_s: float | None = None
) -> DataFrame:
    """Packets with ``flow_no`` (per conversation), ``flow_start_us``, ``is_fwd`` and inter-arrival times."""
    width = slice_width_us(timeout_s, idle_s, slice_s)
    # The explicit exchange serves the reduced rows and the packets: one scan.
    gaps = _with_inner_gaps(_sliced(packets, width).repartition(*KEY, "slice_us"))
    cells = _link_cells(
        gaps.groupBy(*KEY, "slice_us").agg(*_cell_aggregates()), int(timeout_s * 1_000_000), int(idle_s * 1_000_000)
    ).select(
        *KEY, "slice_us", "flow_no", "flow_start_us", "fwd_is_a", "first_us_a", "first_us_b", "link", "link_a", "link_b",
        F.col("opening.pkt_id").alias("opening_pkt"), F.col("win_a.pkt_id").alias("first_pkt_a"),
        F.col("win_b.pkt_id").alias("first_pkt_b"),
    )
    joined = gaps.join(cells, [*KEY, "slice_us"])
    is_fwd = F.col("from_a") == F.col("fwd_is_a")
    side_gap = F.when(
        F.col("from_a"), F.coalesce("gap_a", F.when(F.col("pkt_id") == F.col("first_pkt_a"), F.col("link_a")))
    ).otherwise(F.coalesce("gap_b", F.when(F.col("pkt_id") == F.col("first_pkt_b"), F.col("link_b"))))
    return joined.select(
        *packets.columns,
        *[c for c in ("ts_us",) if c not in packets.columns],
        *[c for c in KEY if c not in packets.columns],
        "flow_no",
        "flow_start_us",
        is_fwd.alias("is_fwd"),
        F.coalesce("gap", F.when(F.col("pkt_id") == F.col("opening_pkt"), F.col("link"))).alias("iat_us"),
        F.when(is_fwd, side_gap).alias("fwd_iat_us"),
        F.when(~is_fwd, side_gap).alias("bwd_iat_us"),
    )


def direction(packets: DataFrame, timeout_s: float = FLOW_TIMEOUT_S) -> DataFrame:
    """Packets with ``is_fwd``: sent by the endpoint that opened the flow."""
    return sessionize(packets, timeout_s).drop("iat_us", "fwd_iat_us", "bwd_iat_us")


def inter_arrival(packets: DataFrame, timeout_s: float = FLOW_TIMEOUT_S) -> DataFrame:
    """Packets with the time since the previous packet of the flow and of the flow's direction."""
    return sessionize(packets, timeout_s)


def _squares(step: str) -> str:
    return f"coalesce(sum(CAST(CAST({step} AS DECIMAL(18,0)) * CAST({step} AS DECIMAL(18,0)) AS {DEC})), 0)"


def _flow_aggregates() -> list[Column]:
    out = [
        "min(first_us) AS start_us",
        "max(last_us) AS last_us",
        "first(fwd_is_a) AS fwd_is_a",
        "first(flow_opening.pkt_id) AS flow_id",
        "count(idle_us) AS idle_count",
    ]
    for period in ("active", "idle"):
        step = f"{period}_us"
        out += [
            f"min({step}) AS {period}_min",
            f"max({step}) AS {period}_max",
            f"sum({step}) AS {period}_sum",
            f"{_squares(step)} AS {period}_sq",
        ]
    for side in SIDES:
        out += [f"coalesce(sum({n}_{side}), 0) AS {n}_{side}" for n in ("n", "bytes", "header", "data", "psh")]
        out += [
            f"coalesce(sum(CAST(bytes_sq_{side} AS {DEC})), 0) AS bytes_sq_{side}",
            f"min(len_min_{side}) AS len_min_{side}",
            f"max(len_max_{side}) AS len_max_{side}",
            f"min(header_min_{side}) AS header_min_{side}",
            f"min(win_{side}) AS win_{side}",
        ]
    for gap, link in (("gap", "link"), ("gap_a", "link_a"), ("gap_b", "link_b")):
        out += [
            f"sum({gap}_n) + count({link}) AS {gap}_n",
            f"coalesce(sum({gap}_sum), 0) + coalesce(sum({link}), 0) AS {gap}_sum",
            f"CAST(coalesce(sum(CAST({gap}_sq AS {DEC})), 0) + {_squares(link)} AS {DEC}) AS {gap}_sq",
            f"least(min({gap}_min), min({link})) AS {gap}_min",
            f"greatest(max({gap}_max), max({link})) AS {gap}_max",
        ]
    out += [f"sum({n}) AS {n}" for n in ("syn", "ack", "urg", "rst")]
    return _exprs(out)


def flow_table(
    packets: DataFrame,
    timeout_s: float = FLOW_TIMEOUT_S,
    idle_s: float = IDLE_THRESHOLD_S,
    slice_s: float | None = None,
    min_packets: int = MIN_PACKETS,
    end_us: int | None = None,
) -> DataFrame:
    """One row per flow with oriented integer accumulators (counts, sums, moments, extremes).

    ``closed`` tells whether the flow had timed out when the capture ended, at ``end_us`` or with the newest packet.
    """
    flows = flow_cells(packets, timeout_s, idle_s, slice_s).groupBy(*KEY, "flow_no").agg(*_flow_aggregates())
    end = F.lit(end_us) if end_us is not None else with_micros(packets).agg(F.max("ts_us")).scalar()
    timed = _oriented(flows).withColumn("closed", F.col("last_us") + int(timeout_s * 1_000_000) < end)
    return timed.filter(F.col("packets") >= min_packets)


def _oriented(flows: DataFrame) -> DataFrame:
    out = ["flow_id"]
    for d, near, far in (("src", "a", "b"), ("dst", "b", "a")):
        out += [f"if(fwd_is_a, {n}_{near}, {n}_{far}) AS {d}_{n}" for n in ("ip", "port")]
    out += ["protocol", "start_us", "last_us", "n_a + n_b AS packets"]
    for d, near, far in (("fwd", "a", "b"), ("bwd", "b", "a")):
        names = ("n", "bytes", "bytes_sq", "len_min", "len_max", "header", "header_min", "data", "psh")
        out += [f"if(fwd_is_a, {n}_{near}, {n}_{far}) AS {d}_{n}" for n in names]
        out.append(f"coalesce(if(fwd_is_a, win_{near}, win_{far}).window_size, 0) AS {d}_win")
        out += [f"if(fwd_is_a, gap_{near}_{m}, gap_{far}_{m}) AS {d}_iat_{m}" for m in ("n", "sum", "sq", "min", "max")]
    out += [f"gap_{m} AS iat_{m}" for m in ("n", "sum", "sq", "min", "max")]
    out += ["syn", "ack", "urg", "rst", "idle_count"]
    out += [f"{p}_{m}" for p in ("active", "idle") for m in ("min", "max", "sum", "sq")]
    return flows.selectExpr(*out)


def _feature_texts() -> dict[str, str]:
    def dbl(name: str) -> str:
        return f"coalesce(CAST({name} AS DOUBLE), 0D)"

    seconds = "(CAST(last_us - start_us AS DOUBLE) / 1000000D)"
    total_bytes, total_sq = "(fwd_bytes + bwd_bytes)", "(fwd_bytes_sq + bwd_bytes_sq)"
    length_var = moments_variance("packets", total_bytes, total_sq)
    f = {"Protocol": dbl("protocol"), "Flow Duration": dbl("last_us - start_us")}
    f["Total Fwd Packets"] = f["Subflow Fwd Packets"] = dbl("fwd_n")
    f["Total Backward Packets"] = f["Subflow Bwd Packets"] = dbl("bwd_n")
    f["Fwd Packets Length Total"] = f["Subflow Fwd Bytes"] = dbl("fwd_bytes")
    f["Bwd Packets Length Total"] = f["Subflow Bwd Bytes"] = dbl("bwd_bytes")
    for label, d in (("Fwd", "fwd"), ("Bwd", "bwd")):
        f[f"{label} Packet Length Max"] = dbl(f"{d}_len_max")
        f[f"{label} Packet Length Min"] = dbl(f"{d}_len_min")
        f[f"{label} Packet Length Mean"] = f[f"Avg {label} Segment Size"] = safe_ratio(f"{d}_bytes", f"{d}_n")
        f[f"{label} Packet Length Std"] = f"sqrt({moments_variance(f'{d}_n', f'{d}_bytes', f'{d}_bytes_sq')})"
        f[f"{label} IAT Total"] = dbl(f"{d}_iat_sum")
        f[f"{label} Header Length"] = dbl(f"{d}_header")
        f[f"{label} Packets/s"] = safe_ratio(f"{d}_n", seconds)
        f[f"Init {label} Win Bytes"] = dbl(f"{d}_win")
    for label, p in (("Flow", "iat"), ("Fwd", "fwd_iat"), ("Bwd", "bwd_iat")):
        f[f"{label} IAT Mean"] = safe_ratio(f"{p}_sum", f"{p}_n")
        f[f"{label} IAT Std"] = f"sqrt({moments_variance(f'{p}_n', f'{p}_sum', f'{p}_sq')})"
        f[f"{label} IAT Max"] = dbl(f"{p}_max")
        f[f"{label} IAT Min"] = dbl(f"{p}_min")
    f["Flow Bytes/s"] = safe_ratio(total_bytes, seconds)
    f["Flow Packets/s"] = safe_ratio("packets", seconds)
    f["Packet Length Min"] = "CAST(least(fwd_len_min, bwd_len_min) AS DOUBLE)"
    f["Packet Length Max"] = "CAST(greatest(fwd_len_max, bwd_len_max) AS DOUBLE)"
    f["Packet Length Mean"] = f["Avg Packet Size"] = safe_ratio(total_bytes, "packets")
    f["Packet Length Std"] = f"sqrt({length_var})"
    f["Packet Length Variance"] = length_var
    f["URG Flag Count"] = dbl("urg")
    f["Down/Up Ratio"] = safe_ratio("bwd_n", "fwd_n")
    f["Fwd Act Data Packets"] = dbl("fwd_data")
    f["Fwd Seg Size Min"] = dbl("fwd_header_min")
    f["Active Min"] = dbl("active_min")
    f["Idle Max"] = dbl("idle_max")
    return f


FLOW_ID_COLUMNS = ["flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us", "last_us"]


def features_of(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 54 feature columns, in order, beside the flow's identity, ``closed`` and columns to keep (names differ by more than case)."""
    texts = _feature_texts()
    identity = ["protocol AS ip_protocol" if c == "protocol" else c for c in [*FLOW_ID_COLUMNS, "closed", *(keep or [])]]
    return flows.selectExpr(*identity, *[f"{texts[name]} AS `{name}`" for name in FEATURE_NAMES])


def flow_features(
    packets: DataFrame,
    timeout_s: float = FLOW_TIMEOUT_S,
    idle_s: float = IDLE_THRESHOLD_S,
    slice_s: float | None = None,
    min_packets: int = MIN_PACKETS,
    end_us: int | None = None,
) -> DataFrame:
    """Packets -> one row per flow: identity, ``closed`` and 54 features."""
    return features_of(flow_table(packets, timeout_s, idle_s, slice_s, min_packets, end_us))


def safe_rates(flows: DataFrame) -> DataFrame:
    """Rates and ratios of a flow table, 0.0 for zero durations or counts."""
    texts = _feature_texts()
    names = {
        "Flow Packets/s": "packets_per_s", "Fwd Packets/s": "fwd_packets_per_s", "Bwd Packets/s": "bwd_packets_per_s",
        "Flow Bytes/s": "bytes_per_s", "Down/Up Ratio": "down_up_ratio", "Avg Packet Size": "avg_packet_size",
    }
    return flows.selectExpr(*FLOW_ID_COLUMNS, *[f"{texts[k]} AS {v}" for k, v in names.items()])


def active_idle(flows: DataFrame) -> DataFrame:
    """Active and idle period statistics of a flow table; a flow without idle gaps has zeros."""
    out = ["idle_count"]
    for p in ("active", "idle"):
        total = f"coalesce({p}_sum, 0)"
        out += [f"CAST(coalesce({p}_{m}, 0) AS DOUBLE) AS {p}_{m}" for m in ("min", "max")]
        out.append(f"{safe_ratio(total, 'idle_count')} AS {p}_mean")
        out.append(f"sqrt({moments_variance('idle_count', total, f'{p}_sq')}) AS {p}_std")
    return flows.selectExpr(*FLOW_ID_COLUMNS, *out)


def flag_counts(flows: DataFrame) -> DataFrame:
    """SYN, ACK, URG, RST counts of both directions and PSH of the forward direction."""
    return flows.select(
        *FLOW_ID_COLUMNS,
        *[F.col(n).alias(f"{n}_count") for n in ("syn", "ack", "urg", "rst")],
        F.col("fwd_psh").alias("psh_fwd_count"),
    )


def init_windows(flows: DataFrame) -> DataFrame:
    """First advertised window per direction, 0 when the direction is silent."""
    return flows.select(*FLOW_ID_COLUMNS, F.col("fwd_win").alias("init_fwd_win"), F.col("bwd_win").alias("init_bwd_win"))


def byte_totals(flows: DataFrame) -> DataFrame:
    """Payload and header totals, forward data packets and smallest forward header."""
    return flows.select(
        *FLOW_ID_COLUMNS,
        F.coalesce("fwd_bytes", F.lit(0)).alias("fwd_bytes"),
        F.coalesce("bwd_bytes", F.lit(0)).alias("bwd_bytes"),
        F.col("fwd_header").alias("fwd_header_bytes"),
        F.col("bwd_header").alias("bwd_header_bytes"),
        F.col("fwd_data").alias("fwd_data_packets"),
        F.coalesce("fwd_header_min", F.lit(0)).alias("fwd_header_min"),
    )


def duration(flows: DataFrame) -> DataFrame:
    """Flow duration in microseconds and packet count."""
    return flows.select(*FLOW_ID_COLUMNS, (F.col("last_us") - F.col("start_us")).alias("duration_us"), "packets")


def iat_stats(flows: DataFrame) -> DataFrame:
    """Inter-arrival statistics of the flow and of each direction."""
    out = []
    for p in ("iat", "fwd_iat", "bwd_iat"):
        out += [
            f"{p}_n AS {p}_count",
            f"CAST({p}_sum AS DOUBLE) AS {p}_total",
            f"{safe_ratio(f'{p}_sum', f'{p}_n')} AS {p}_mean",
            f"sqrt({moments_variance(f'{p}_n', f'{p}_sum', f'{p}_sq')}) AS {p}_std",
            f"CAST(coalesce({p}_min, 0) AS DOUBLE) AS {p}_min",
            f"CAST(coalesce({p}_max, 0) AS DOUBLE) AS {p}_max",
        ]
    return flows.selectExpr(*FLOW_ID_COLUMNS, *out)


def active_flows(flows: DataFrame, at_us: list[int] | DataFrame, timeout_s: float = FLOW_TIMEOUT_S, slice_s: float = 1.0) -> DataFrame:
    """Open flows at given moments: first packet <= at <= last packet + timeout (pass flows with min_packets=1).

    A sweep over events: a flow adds 1 at its first packet and takes 1 away just after its timeout; a moment reads the sum so
    far. Events are summed inside time slices and slices by prefix sums, so the cost is that of flows plus moments.
    ``at_us`` is a list, or a table with the column ``at_us``.
    """
    spark, timeout_us = flows.sparkSession, int(timeout_s * 1_000_000)
    moments = at_us if isinstance(at_us, DataFrame) else spark.createDataFrame([(int(m),) for m in at_us], "at_us long")
    return sums_at(flow_changes(flows, timeout_us), ["active_flows"], moments, slice_s)


def flow_changes(flows: DataFrame, timeout_us: int) -> DataFrame:
    """(at_us, active_flows): plus one at each flow's first packet, minus one just after its timeout."""
    opened = F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("active_flows"))
    closed = F.struct((F.col("last_us") + timeout_us + 1).alias("at_us"), F.lit(-1).alias("active_flows"))
    return flows.select(F.explode(F.array(opened, closed)).alias("e")).select("e.*")

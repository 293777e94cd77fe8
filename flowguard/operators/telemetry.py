"""Interface rates, link health, connection lifetimes and remote-host rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowguard.functions.net import geo_label, is_private_ip, remote_ip
from flowguard.functions.text import format_bytes, format_rate
from flowguard.operators.bursts import accepted_rows
from flowguard.operators.ordered import last_marked, latest, rolling, time_slice, with_neighbours
from flowguard.session import materialise

# Sampling and retention limits.
MIN_SAMPLE_GAP_US = 10_000
HISTORY = 60
MAX_TRACKED = 2000
LOOPBACK = ["lo", "lo0"]
TIMELINE_WINDOWS_S = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600}
MISSING = "—"

IFACE = ["host", "iface"]
SLICE_S = 3600


# ---- interface counters -------------------------------------------------------------------------


def accepted_samples(counters: DataFrame, min_gap_us: int = MIN_SAMPLE_GAP_US) -> DataFrame:
    """Drop samples closer than ``min_gap_us`` to the last accepted one.

    A sample that follows its predecessor by at least the gap is accepted and starts a burst, a chain of closer samples.
    Nothing else within the gap of a burst's start is accepted. Only bursts that last longer, by their start and the
    samples beyond its gap, go through ``bursts.accepted_rows``.
    """
    order, at = ["ts_us", "sample_id"], time_slice("ts_us", SLICE_S)
    near = with_neighbours(counters, IFACE, at, order, [], "_prev", "_next")
    starts = F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev.ts_us") >= min_gap_us)
    followed = F.coalesce(F.col("_next.ts_us") - F.col("ts_us") < min_gap_us, F.lit(False))
    # After samples without a time, only one that is followed closely starts anew.
    known = near.filter(starts.isNotNull() | followed).withColumn("_starts", F.coalesce(starts, F.lit(True))).drop("_prev", "_next")
    begun = last_marked(known, IFACE, at, "ts_us", F.col("_starts"), "_start")
    left = begun.filter(F.col("_starts") | (F.col("ts_us") - F.col("_start") >= min_gap_us)).drop("_start")
    onward = with_neighbours(left, IFACE, at, order, ["_starts"], None, "_next")
    lone = F.col("_starts") & F.coalesce("_next._starts", F.lit(True))
    marked = materialise(onward.withColumn("_lone", lone).drop("_starts", "_next"))
    burst = marked.filter(~F.col("_lone")).select(*counters.columns)
    return marked.filter("_lone").select(*counters.columns).unionByName(accepted_rows(burst, IFACE, order, min_gap_us))


def counter_rates(counters: DataFrame, min_gap_us: int = MIN_SAMPLE_GAP_US) -> DataFrame:
    """Cumulative counters -> rates per second; a falling counter gives 0, the first sample 0."""
    kept = accepted_samples(counters, min_gap_us)
    prev = with_neighbours(
        kept, IFACE, time_slice("ts_us", SLICE_S), ["ts_us", "sample_id"], ["rx_bytes", "tx_bytes"], "_prev"
    )
    seconds = (F.col("ts_us") - F.col("_prev.ts_us")).cast("double") / 1_000_000.0

    def rate(c: str) -> Column:
        delta = F.greatest(F.col(c) - F.col(f"_prev.{c}"), F.lit(0)).cast("double")
        return F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.try_divide(delta, seconds))

    return prev.withColumns({"rx_rate": rate("rx_bytes"), "tx_rate": rate("tx_bytes")}).drop("_prev")


def tick_rates(counters: DataFrame, tick: str = "tick", slice_ticks: int = 4096) -> DataFrame:
    """Rates between consecutive readings of a host; ``tick`` numbers the reading a sample belongs to.

    An interface that the host's previous reading did not have starts again at 0. Of several samples of an interface in
    one reading the newest counts.
    """
    rest = [c for c in counters.columns if c not in (*IFACE, tick, "ts_us", "sample_id")]
    newest = counters.groupBy(*IFACE, tick).agg(F.max(F.struct("ts_us", "sample_id", *rest)).alias("_s")).select(*IFACE, tick, "_s.*")
    at = F.floor(F.col(tick) / slice_ticks).cast("long")
    readings = with_neighbours(newest.select("host", tick).distinct(), ["host"], at, [tick], [], "_before")
    paced = with_neighbours(newest, IFACE, at, [tick], ["ts_us", "rx_bytes", "tx_bytes"], "_prev").join(readings, ["host", tick])
    seconds = (F.col("ts_us") - F.col("_prev.ts_us")).cast("double") / 1_000_000.0
    follows = (F.col(f"_prev.{tick}") == F.col(f"_before.{tick}")) & (seconds > 0)

    def rate(c: str) -> Column:
        return F.when(follows, F.greatest(F.col(c) - F.col(f"_prev.{c}"), F.lit(0)).cast("double") / seconds).otherwise(F.lit(0.0))

    return paced.select(*counters.columns, rate("rx_bytes").alias("rx_rate"), rate("tx_bytes").alias("tx_rate"))


def rate_history(rates: DataFrame, size: int = HISTORY) -> DataFrame:
    """The last ``size`` whole-number rates up to each sample, oldest first."""
    return rolling(
        rates,
        IFACE,
        time_slice("ts_us", SLICE_S),
        ["ts_us", "sample_id"],
        size,
        {
            "rx_history": lambda w: F.collect_list(F.col("rx_rate").cast("long")).over(w),
            "tx_history": lambda w: F.collect_list(F.col("tx_rate").cast("long")).over(w),
        },
    )


def latest_samples(samples: DataFrame) -> DataFrame:
    return latest(samples, IFACE, ["ts_us", "sample_id"])


def _live(info: DataFrame) -> DataFrame:
    return info.filter(F.col("is_up") & ~F.col("iface").isin(LOOPBACK)).select(*IFACE)


def bandwidth_total(current: DataFrame, info: DataFrame) -> DataFrame:
    """Current rates summed over interfaces that are up and not loopback; names joined by ``+``."""
    return (
        current.join(_live(info), IFACE)
        .groupBy("host")
        .agg(
            F.sum("rx_rate").alias("total_rx"),
            F.sum("tx_rate").alias("total_tx"),
            F.array_join(F.array_sort(F.collect_list("iface")), "+").alias("interfaces"),
        )
    )


def bandwidth_history(current: DataFrame, info: DataFrame) -> DataFrame:
    """Rates per history slot (0 = oldest) summed over live interfaces; ``current`` carries the histories."""
    slots = current.join(_live(info), IFACE).select(
        "host", F.posexplode(F.arrays_zip("rx_history", "tx_history")).alias("slot", "v")
    )
    return slots.groupBy("host", "slot").agg(F.sum("v.rx_history").alias("rx"), F.sum("v.tx_history").alias("tx"))


def interface_table(current: DataFrame, info: DataFrame) -> DataFrame:
    """Counters left-joined to the interface dimension; unknown -> placeholder and DOWN."""
    up = F.coalesce("is_up", F.lit(False))

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c)

    return (
        current.join(info, IFACE, "left")
        .select(
            *IFACE, shown("ipv4"), shown("ipv6"), shown("mac"), shown("mtu"),
            format_rate("rx_rate").alias("rx_rate"), format_rate("tx_rate").alias("tx_rate"),
            format_bytes("rx_bytes").alias("rx_total"), format_bytes("tx_bytes").alias("tx_total"),
            (F.col("rx_errors") + F.col("tx_errors")).cast("long").alias("errors"),
            (F.col("rx_drops") + F.col("tx_drops")).cast("long").alias("drops"),
            F.when(up, F.lit("UP")).otherwise(F.lit("DOWN")).alias("status"),
        )
        .orderBy(*IFACE)
    )


def total_errors(current: DataFrame) -> DataFrame:
    return current.groupBy("host").agg(F.sum((F.col("rx_errors") + F.col("tx_errors")).cast("long")).alias("errors"))


def host_summary(info: DataFrame) -> DataFrame:
    """Primary address (first live interface with one) and interface caption (``a / b`` or ``a +n``)."""
    live = info.filter(F.col("is_up") & ~F.col("iface").isin(LOOPBACK))
    named = live.groupBy("host").agg(
        F.min_by("ipv4", F.when(F.col("ipv4").isNotNull(), F.col("iface"))).alias("primary_ip"),
        F.array_sort(F.collect_list("iface")).alias("names"),
    )
    n = F.size("names")
    caption = F.when(n <= 2, F.array_join("names", " / ")).otherwise(
        F.concat(F.col("names")[0], F.lit(" +"), (n - 1).cast("string"))
    )
    return named.select("host", F.coalesce("primary_ip", F.lit(MISSING)).alias("primary_ip"), caption.alias("caption"))


# ---- link health --------------------------------------------------------------------------------


def health_level(probes: DataFrame) -> DataFrame:
    """``severity`` by loss and ``link`` indicator by loss and round-trip time."""
    loss, rtt = F.col("loss_pct"), F.col("rtt_ms")
    return probes.withColumns(
        {
            "severity": F.when(loss < 1, "good").when(loss < 50, "degraded").otherwise("bad"),
            "link": F.when(rtt.isNull(), "none")
            .when((loss == 0) & (rtt < 10), "good")
            .when((loss < 50) & (rtt < 100), "degraded")
            .otherwise("bad"),
        }
    )


def rtt_heat(probes: DataFrame, size: int = HISTORY) -> DataFrame:
    """Round-trip time relative to the maximum of the last ``size`` probes (at least 1 ms): 8 levels, 4 bands."""
    scaled = rolling(
        probes,
        ["host", "target"],
        time_slice("ts_us", SLICE_S),
        ["ts_us", "probe_id"],
        size,
        {"max_rtt": lambda w: F.greatest(F.coalesce(F.max("rtt_ms").over(w), F.lit(0.0)), F.lit(1.0))},
    )
    rtt = F.col("rtt_ms")
    ratio = F.when(rtt.isNotNull(), F.least(rtt / F.col("max_rtt"), F.lit(1.0)))
    return scaled.withColumns(
        {
            "level": F.when(rtt.isNotNull(), F.least(F.floor(ratio * 7).cast("int"), F.lit(7))),
            "band": F.when(ratio.isNull(), "gap")
            .when(ratio < 0.3, "low")
            .when(ratio < 0.6, "medium")
            .when(ratio < 0.85, "high")
            .otherwise("critical"),
        }
    )


# ---- connections --------------------------------------------------------------------------------


def enrich_geo(connections: DataFrame, geo: DataFrame) -> DataFrame:
    """Geo label of public remotes; private, blank and unresolved remotes keep a blank label."""
    ip = F.col("remote_ip")
    looked_up = connections.withColumn("remote_ip", remote_ip("remote_addr")).withColumn(
        "_geo_ip", F.when(~is_private_ip(ip), ip)
    )
    places = geo.select(F.col("ip").alias("_geo_ip"), "country_code", "city", "org")
    joined = looked_up.join(places, "_geo_ip", "left")
    return joined.withColumn("geo_label", geo_label(F.col("country_code"), F.col("city"), F.col("org"))).drop("_geo_ip")


def remote_hosts(connections: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Per remote host: connections, any established, distinct processes and protocols; busiest first.

    With ``geo`` also the geo label, looked up once per host.
    """
    hosts = _remote_rollup(connections)
    if geo is not None:
        labels = geo.select(F.col("ip").alias("_geo_ip"), geo_label(F.col("country_code"), F.col("city"), F.col("org")).alias("_label"))
        public = F.when(~is_private_ip(F.col("remote_ip")), F.col("remote_ip"))
        hosts = hosts.withColumn("_geo_ip", public).join(labels, "_geo_ip", "left").withColumn("geo_label", F.coalesce("_label", F.lit(""))).drop("_geo_ip", "_label")
    return hosts.orderBy(F.desc("connections"), "remote_ip")


def _remote_rollup(connections: DataFrame) -> DataFrame:
    named = connections.withColumn("remote_ip", remote_ip("remote_addr")).filter(F.col("remote_ip").isNotNull())
    return (
        named.groupBy("remote_ip")
        .agg(
            F.count(F.lit(1)).alias("connections"),
            F.coalesce(F.bool_or(F.col("state") == "ESTABLISHED"), F.lit(False)).alias("has_established"),
            F.array_join(F.array_sort(F.collect_set("process_name")), ",").alias("processes"),
            F.array_join(F.array_sort(F.collect_set(F.upper("protocol"))), ",").alias("protocols"),
        )
    )


def topology_summary(connections: DataFrame, infrastructure_nodes: int) -> DataFrame:
    """Connections, distinct remotes and nodes (local host + gateway and name servers + remotes)."""
    remotes = F.count_distinct(remote_ip("remote_addr"))
    return connections.agg(
        F.count(F.lit(1)).alias("connections"), remotes.alias("remotes"), (remotes + 1 + infrastructure_nodes).alias("nodes")
    )


def top_established(connections: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` established connections in a stated order."""
    order = order_by or ["local_addr", "remote_addr"]
    shown = F.coalesce("process_name", F.lit(MISSING))
    return (
        connections.filter(F.col("state") == "ESTABLISHED")
        .orderBy(*order)
        .limit(n)
        .select(shown.alias("process_name"), "protocol", "state", "local_addr", "remote_addr")
    )


SORT_COLUMNS = ["process_name", "pid", "protocol", "state", "local_addr", "remote_addr"]


def sort_connections(connections: DataFrame, column: str, ties: list[str] | None = None) -> DataFrame:
    """Order by one listing column: missing process sorts as blank, missing pid first."""
    if column not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {column}")
    first = {"process_name": F.coalesce("process_name", F.lit("")), "pid": F.asc_nulls_first("pid")}
    return connections.orderBy(first.get(column, F.col(column)), *(ties or []))


CONNECTION_KEY = ["protocol", "local_addr", "remote_addr", "pid"]


def connection_lifetimes(snapshots: DataFrame, order: str = "snap", tie: str | None = None) -> DataFrame:
    """First and last sighting, latest state, first process name; active = seen in the host's latest snapshot."""
    at = F.struct(order, tie) if tie else F.struct(order)
    spans = snapshots.groupBy("host", *CONNECTION_KEY).agg(
        F.min(order).alias("first_seen"),
        F.max(order).alias("last_seen"),
        F.max(F.struct(at.alias("at"), "state"))["state"].alias("state"),
        F.min(F.struct(at.alias("at"), "process_name"))["process_name"].alias("process_name"),
    )
    newest = snapshots.groupBy("host").agg(F.max(order).alias("_newest"))
    return (
        spans.join(newest, "host")
        .withColumn("is_active", F.col("last_seen") == F.col("_newest"))
        .drop("_newest")
    )


def evict_inactive(lifetimes: DataFrame, limit: int = MAX_TRACKED, salts: int = 64) -> DataFrame:
    """Keep at most ``limit`` connections per host by evicting inactive ones, oldest first sighting first.

    Equivalent to keeping the newest inactive rows that still fit beside the active ones. The newest
    are found per (host, salt) first, so no task ranks all rows of a host.
    """
    newest_first = [F.desc("first_seen"), *[F.desc_nulls_last(c) for c in CONNECTION_KEY]]
    active = lifetimes.filter("is_active")
    room = lifetimes.groupBy("host").agg(
        F.greatest(F.lit(limit) - F.count_if("is_active"), F.lit(0)).alias("_room")
    )
    salted = lifetimes.filter(~F.col("is_active")).withColumn("_salt", F.pmod(F.xxhash64(*CONNECTION_KEY), F.lit(salts)))
    rank_salt = F.row_number().over(Window.partitionBy("host", "_salt").orderBy(*newest_first))
    rank_host = F.row_number().over(Window.partitionBy("host").orderBy(*newest_first))
    candidates = salted.withColumn("_r", rank_salt).filter(F.col("_r") <= limit).drop("_r", "_salt")
    ranked = candidates.withColumn("_r", rank_host).filter(F.col("_r") <= limit)
    kept = ranked.join(room, "host").filter(F.col("_r") <= F.col("_room")).drop("_r", "_room")
    return active.unionByName(kept.select(*active.columns))


def window_length(window: int | str, per_second: float = 1.0) -> int:
    """A window's length in the units of its times, or that of a named one (1m, 5m, 15m, 30m, 1h)."""
    return window if isinstance(window, int) else round(TIMELINE_WINDOWS_S[window] * per_second)


def timeline(lifetimes: DataFrame, now: int, window: int | str, ties: list[str] | None = None, per_second: float = 1.0) -> DataFrame:
    """Connections last seen inside the window before ``now``: active first, then oldest first.

    ``window`` is a length or a name; ``per_second`` tells how many units of time a second has.
    """
    window = window_length(window, per_second)
    return lifetimes.filter(F.col("last_seen") >= now - window).orderBy(
        F.desc("is_active"), "first_seen", *(ties or ["host", *CONNECTION_KEY])
    )


def timeline_cells(lifetimes: DataFrame, now: int, window: int, width: int) -> DataFrame:
    """Cells [start_cell, end_cell) of ``width`` equal cells; cell 0 touches ``now``, at least one cell each."""
    shown = lifetimes.filter(F.col("last_seen") >= now - window)
    first = F.greatest("first_seen", F.lit(now - window))
    last = F.least("last_seen", F.lit(now))
    start = F.least(F.floor((F.lit(now) - last).cast("double") / float(window) * width), F.lit(width))
    end = F.ceil((F.lit(now) - first).cast("double") / float(window) * width)
    drawn = shown.filter(first <= last).withColumn("start_cell", start.cast("int"))
    return drawn.withColumn("end_cell", F.least(F.greatest(end, F.col("start_cell") + 1), F.lit(width)).cast("int"))


def lifetime_summary(lifetimes: DataFrame) -> DataFrame:
    return lifetimes.agg(
        F.count_if("is_active").alias("active"),
        F.count_if(~F.col("is_active")).alias("closed"),
        F.count(F.lit(1)).alias("total"),
    )
